"""Repeated passages against a brute-force form."""

import random

import numpy as np
import pyarrow as pa
import pytest

from offerlab.llm import passages

SCHEMA = "doc_id long, text string, spans string, doc string, own string, start string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


def brute(rows, span):
    place = {}
    for i, t in rows:
        b, k = (t or "").encode(), passages.LAST if i is None else i
        for p in range(len(b) - span + 1):
            s = b[p:p + span]
            place[s] = min(k, place.get(s, passages.LAST))
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), passages.LAST if i is None else i
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            if place[b[p:p + span]] < k:
                gone[p:p + span] = [True] * span
        n_spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out.append((-1 if i is None else i, n_spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, len(r.spans), bytes(r.kept)) for r in df.collect())


def corpus(seed, letters, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [word(rng.randint(30, 140)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [word(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, 8)
            parts += [s[a:len(s) - rng.randint(0, 8)], word(rng.choice([0, 1, 2, 30]))]
        rows.append((rng.randint(0, n), "".join(parts)))
    return rows


EDGE = [(None, "no id " * 30), (None, "no id " * 30), (3, "no id " * 20), (4, None), (5, ""), (6, "short"), (7, "x" * 50), (8, "x" * 49), (9, "y" + "x" * 49 + "é" * 40),
        (10, "é" * 45), (11, "word " * 3000), (12, "word " * 2000 + "end"), (12, "word " * 2000 + "end"), (1, "word " * 11)]


@pytest.mark.parametrize("seed,letters,span,hot", [(1, "abcdefghij ", 50, 64), (2, "ab", 50, 64), (3, "abcdefgh", 30, 64), (4, "abcdef ", 50, 2), (3, "abcdefgh", 30, 4)])
def test_matches_brute_force(spark, monkeypatch, seed, letters, span, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rows = corpus(seed, letters) + EDGE
    random.Random(seed).shuffle(rows)
    assert got(passages.repeated_passages(frame(spark, rows).repartition(5), span=span)) == brute(rows, span)


def test_small_pieces_and_runs(spark, monkeypatch):
    """Many runs and a full bitmap change nothing; a long text in pieces has the same anchors."""
    for name, value in (("STEP", 200), ("RUN_ROWS", 40), ("FILTER_BITS", 7)):
        monkeypatch.setattr(passages, name, value)
    rows = corpus(5, "abcdef ", 40) + EDGE[:10]
    assert got(passages.repeated_passages(frame(spark, rows).repartition(3))) == brute(rows, 50)
    text = " ".join(t for _, t in rows if t).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["d", "o", "b"])
    pieces = [(a + before[0] - starts[0]) for data, starts, ends, before, _, _ in passages.slices([batch], 50) for a in passages.anchors(data, starts, ends, 50)[0]]
    whole = passages.anchors(np.frombuffer(text, dtype=np.uint8), np.array([0]), np.array([len(text)]), 50)[0]
    assert sorted(set(pieces)) == whole.tolist()


def test_one_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT", 3)
    rng = random.Random(9)
    hot = "".join(rng.choice("abcdefghijkl ") for _ in range(120))
    rows = [(i, "".join(rng.choice("mnopqrst") for _ in range(rng.randint(5, 40))) + hot + "".join(rng.choice("mnopqrst") for _ in range(20))) for i in range(200)]
    assert got(passages.repeated_passages(frame(spark, rows))) == brute(rows, 50)


def test_merge_of_front_coded_runs():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 7):
        coded, all_rows = [], []
        for _ in range(k):
            rows = rng.integers(97, 99, (rng.integers(1, 40), 12)).astype(np.uint8)
            rows = rows[np.lexsort(rows.T[::-1])]
            all_rows.append(rows)
            share = passages.shared_prefix(rows)
            coded.append((share, rows[np.arange(12)[None, :] >= share[:, None]].tobytes()))
        run, at, shared, merged = passages.merge_runs(coded, 12)
        want = sorted(bytes(r) for rows in all_rows for r in rows)
        assert [bytes(r) for r in merged] == want
        assert shared.tolist() == passages.shared_prefix(merged).tolist()
        assert all(bytes(all_rows[r][i]) == bytes(m) for r, i, m in zip(run, at, merged))


def test_empty_table(spark):
    assert passages.repeated_passages(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        passages.repeated_passages(frame(spark, []), span=10)
