"""Collocations against a brute-force form and the registered SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from offerlab.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a string, score string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", "w") for i, t, lang in rows], SCHEMA)


def brute(rows, least, percent, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i:i + len(w)] == w for i in range(len(v))) for (x, v), b in cand.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    seen, ranked = Counter(), []
    for lang, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], *rest))
    return ranked


def got(df):
    return sorted(((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["Aa", "bb", "cc", "dd", "é", "ff", "G-g", "\U0001f600"]
    fixed = ["one two three four five six", "alpha Beta gamma", "bb cc"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < .3 else rng.choice(words))
            parts.append(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\x0b", "\r\n"]))
        rows.append((rng.choice([i, None]), "".join(parts), rng.choice(["en", "en", None, "und", "fr", ""])))
    return rows + [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "same same same same same same same", "en"), (4, "same same same same same same same", "en"), (5, "word " * 20_000, "xx")]


@pytest.mark.parametrize("bits", [64, 8])
def test_collocations_match_brute_force(spark, bits):
    """With fingerprints of 8 bits nearly all collide and are counted again by text."""
    rows = corpus(bits)
    assert got(collocations.collocations(frame(spark, rows).repartition(4), least=6, covered_percent=80, top=25, bits=bits)) == sorted(brute(rows, 6, 80, 25))


def test_sql_agrees(spark):
    rows = corpus(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    sql = con.execute(collocations.ORACLE.format(least=6, covered=100, top=2000)).df()
    want = sorted(sql[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False, name=None))
    assert want == sorted(brute(rows, 6, 100, 2000))
    assert got(collocations.collocations(frame(spark, rows), least=6)) == want


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 40)
    import pyarrow as pa
    rng = random.Random(2)
    text = "".join(rng.choice(["a ", "bb ", "c. ", "dd\t", "e"]) for _ in range(400)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["en"]), pa.array([text])], ["text_key", "lang", "bytes"])
    whole = collocations.Piecewise([text], ["en"], [0])
    for n in range(1, 6):
        fp, one = whole.fingerprints(n, 64)
        pieces = [collocations.chosen(p, n, [np.full(1, ~np.uint64(0))] * 5, 64)[1] for p, _ in collocations.runs([batch])]
        assert Counter(np.concatenate(pieces).tolist()) == Counter(fp[one].tolist())


def test_last_pass_holds_little_at_once():
    """A task's frequent phrases are combined and given out in parts, so that its memory stays far below a worker's share."""
    import tracemalloc

    import pyarrow as pa
    from types import SimpleNamespace

    rng = np.random.default_rng(4)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 5_000)).encode() for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["en"] * 60), pa.array(texts)], ["text_key", "lang", "bytes"])
    every = SimpleNamespace(value=np.full(1, ~np.uint64(0)))
    tracemalloc.start()
    rows, n, largest = 0, 0, 0
    for out in collocations.pointer_task([every] * 5, 64)([batch, batch]):
        rows, n, largest = rows + out.num_rows, n + sum(out.column(3).to_pylist()), max(largest, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * 60 * (5_000 + 5_000 + 4_999 + 4_998 + 4_997 + 4_996) and largest <= 50_000 and peak < 120e6


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(spark.range(2))
