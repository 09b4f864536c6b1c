"""Spelling variants against a brute-force form."""

import random
import re
import zlib
from collections import Counter

import pytest

from offerlab.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, node string, near string, form string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def brute(rows, every, min_chars=7, min_count=2, ratio=10):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % every == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    form, count = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        count[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], count[w], n.get(form[w], 0)) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    chain = ["chained-word".replace("-", "")[:k] for k in (8, 9, 10, 11)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + "\n" + "Ab" * 40 + " " + "Ab" * 40 + "c") for i in range(30)]
    rows += [(100 + i, " ".join([w] * 2 * 10 ** i)) for i, w in enumerate(chain)]
    long_ = "x" + "Yz" * 12
    rows += [(200, f"{long_} {long_} {long_[:-1]} {long_[:-1]} {long_[:11]}{long_[12:]} {long_[:11]}{long_[12:]} {long_[:11]}q{long_[12:]} {long_[:11]}q{long_[12:]} "
              + "o" * 5000 + " " + "o" * 5000 + " " + "o" * 4999 + " " + "o" * 4999)]
    return rows + [(None, "no_id_word idword1 idwords idwords ×÷abcdefg ×÷abcdefg"), (5, None), (6, ""), (7, "\U0001f600abcdefgh abcdefgh"), (7, "\U0001f600abcdefgh abcdefgh")]


@pytest.mark.parametrize("every", [None, 3])
def test_spelling_matches_brute_force(spark, every):
    rows = corpus(every or 1)
    assert got(spelling.spelling_variants(frame(spark, rows), every=every)) == brute(rows, every)


def test_roots_follow_chains(spark):
    rows = corpus(1)
    out = {r.word: r.root for r in spelling.spelling_variants(frame(spark, rows), ratio=10).collect()}
    assert out["chainedw"] == out["chainedwo"] == "chainedword"


def test_short_words_and_other_limits(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(50))) for i in range(20)]
    for least in (1,):
        got_ = got(spelling.spelling_variants(frame(spark, rows), min_chars=least, min_count=1, ratio=2))
        assert got_ == brute(rows, None, least, 1, 2)


def test_empty_table(spark):
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.range(3))
