"""Classifier, rules, line dedup, SimHash, embeddings, language model and pipeline against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from offerlab.llm import embedding_dedup, graph, line_dedup, lm_scores, quality, rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _doc string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y", "z") for i, t, lang in rows], SCHEMA)


EDGE = [(None, "no id at all", "en"), (1, None, "en"), (2, "", None), (3, " \n\t\n ", "en"), (4, "same text here", "en"), (4, "same text here", "en"), (5, "word " * 30_000, "en")]


# --- connected components

def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- quality classifier

def test_pairwise_ranking_finds_the_direction(spark):
    rng = np.random.default_rng(1)
    w = quality.fit_pairs(rng.normal([1, 0], 1, (400, 2)), rng.normal([-1, 0], 1, (400, 2)))
    assert w[0] > 1 and abs(w[1]) < w[0] / 5
    assert quality.quantile_cut(spark.createDataFrame([(x,) for x in (3.0, 0.0, 2.0, 1.0)], "s double"), 1) == 0.5


def test_quality_edges(spark):
    good = [(100 + i, f"A plain sentence number {i} about the weather, and some more of it.", "en") for i in range(40)]
    bad = [(200 + i, f"X*** Y### | {i} | $$$ !! !!", "en") for i in range(40)]
    docs = frame(spark, EDGE + good + bad)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(None, 1), (7, None), (999, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(EDGE) + 80 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == int(r.doc_id < 200) for r in got if r.doc_id and r.doc_id >= 100)
    same = [r.score for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda y: " ".join(rng.choice(["word", "other", "thing", f"n{rng.randrange(50)}"] + ["**|", "!!"] * (1 - y)) + "." * rng.randrange(2) for _ in range(30))
    known = {i: int(rng.random() < 0.7) for i in range(200)}
    docs = [(i, text(y), "en") for i, y in known.items()] + [(300 + i, text(i % 2), "en") for i in range(20)]
    # 400 labels have no document: they neither count nor take a place in the sample
    labels = spark.createDataFrame([*known.items(), *[(10_000 + i, 0) for i in range(400)]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(frame(spark, docs), labels, per_class=60).collect()}
    picked = [r.i for y in (0, 1) for r in spark.createDataFrame([(i,) for i, z in known.items() if z == y], "i long").orderBy(rules.F.xxhash64("i"), "i").limit(60).collect()]
    x = {i: np.array(quality.features(t)) for i, t, _ in docs}
    w = quality.fit_pairs(*[np.array([x[i] for i in sorted(picked) if known[i] == y]) for y in (1, 0)])
    s = np.sort([x[i] @ w for i in known])
    lesser = sum(y == 0 for y in known.values())
    cut = (s[lesser - 1] + s[lesser]) / 2
    for i, _, _ in docs:
        want = 1 / (1 + math.exp(-(x[i] @ w - cut + math.log(0.3 / 0.7))))
        assert abs(got[i].score - want) < 1e-9 and (abs(want - 0.3) < 1e-9 or got[i].predicted == int(want >= 0.3))


def test_quality_held_out(spark):
    from offerlab.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_quality_shuffles_no_text(spark):
    """Features are taken below the join with the labels, also where the labels are too many to broadcast."""
    docs = frame(spark, EDGE).select(rules.F.col("doc_id").alias("_id"), "text")
    known = spark.createDataFrame([(1, 0), (4, 1), (999, 1)], "_id long, _y int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taught = quality.labelled_features(docs, known)
        plan = taught._jdf.queryExecution().executedPlan().toString()
        assert {(r._id, r._y) for r in taught.collect()} == {(1, 0), (4, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and plan.rindex("Exchange", 0, plan.index("ArrowEvalPython")) > plan.index("SortMergeJoin")


# --- quality rules

def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def brute_estimate(x, support, steps):
    """The same concentration steps on one group, in numpy."""
    floors = np.array(list(rules.STATS.values()))
    factor = support / rules.chi2_share(rules.chi2_quantile(support, rules.DIM), rules.DIM + 2)
    at = lambda v, p: np.sort(v)[max(0, math.ceil(p * len(v)) - 1)]
    floor = np.diag(floors ** 2)
    middle = np.array([at(c, 0.5) for c in x.T])
    width = (1.4826 * np.array([at(np.abs(c - m), 0.5) for c, m in zip(x.T, middle)])) ** 2 + floors ** 2
    away = x - middle
    reach = (away * away / width).sum(axis=1)
    signs = away[reach > 0] / np.sqrt(reach[reach > 0])[:, None]
    ends = []
    for mean, cov in ((middle, np.diag(width)), (x.mean(axis=0), np.cov(x.T, bias=True)), (middle, rules.DIM * signs.T @ signs / len(signs))):
        cov = cov + floor
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[d <= at(d, support)]
            mean = near.mean(axis=0)
            cov = factor * (near.T @ near / len(near) - np.outer(mean, mean)) + floor
        ends.append((np.linalg.det(cov), mean, cov))
    return min(ends, key=lambda e: e[0])[1:]


def brute_pool(n, mean, cov, above, prior):
    """As if ``prior`` more rows came from the distribution above: mean and covariance of the mixture."""
    p, q = n / (n + prior), prior / (n + prior)
    centre = p * mean + q * above[0]
    second = p * (cov + np.outer(mean, mean)) + q * (above[1] + np.outer(above[0], above[0]))
    return centre, second - np.outer(centre, centre)


def test_rules_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(1000 + i, " ".join(word() for _ in range(rng.randrange(12, 90))), "en" if i < 130 else "fr") for i in range(150)]
    rows += [(500 + i, " ".join(word() + "###" * 4 for _ in range(40)), "en") for i in range(12)]
    rows += [(600 + i, " ".join([word()] * 20), "en") for i in range(5)] + EDGE
    got = {(r.doc_id, r.n): r for r in rules.apply_rules(frame(spark, rows)).withColumn("n", rules.F.lit(0)).collect()}
    kept = {}
    for i, t, _ in rows:
        r = got[(i, 0)]
        c = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        assert r.base_failed == failed
        if not failed:
            kept[i] = [math.log(c[1] / c[0]), math.log1p(100 * c[2] / c[1]), math.log1p(100 * c[3] / c[0]), math.log1p(100 * c[4] / c[0]), math.log(c[0])]
        else:
            assert not r.kept
    lang = {i: g for i, _, g in rows}
    x = np.array(list(kept.values()))
    mean, cov = brute_estimate(x, 0.75, 5)
    corpus = mean, cov * (1 + 100 / len(x))
    for g in ("en", "fr"):
        ids = [i for i in kept if lang[i] == g]
        x = np.array([kept[i] for i in ids])
        own = brute_estimate(x, 0.75, 5)  # language and group have the same rows here
        mean, cov = brute_pool(len(x), *own, brute_pool(len(x), *own, corpus, 100), 100)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        assert [got[(i, 0)].kept for i in ids] == (d <= rules.chi2_quantile(0.99999, rules.DIM)).tolist()
    assert not any(got[(500 + i, 0)].kept for i in range(12)) and sum(got[(1000 + i, 0)].kept for i in range(150)) == 150
    assert rules.apply_rules(frame(spark, []), keep=["doc_id"]).count() == 0


def test_chi_square():
    assert abs(rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(rules.chi2_share(6.626, 5) - 0.75) < 1e-3


# --- line dedup

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        s[i:i + rng.randrange(2)] = rng.choice(["", "a", "é"])
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(800)]
    b = [mutate(rng, x, rng.randrange(6)) for x in a]
    width = max(map(len, a + b))
    x, y = (np.array([[ord(c) for c in s] + [0] * (width - len(s)) for s in side], dtype=np.uint32) for side in (a, b))
    got = line_dedup.within_edits(x, y, np.array(list(map(len, a))), np.array(list(map(len, b))), edits)
    assert got.tolist() == [distance(s, t) <= edits for s, t in zip(a, b)]


def brute_lines(docs, edits, near):
    first, order, dropped = {}, [], set()
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            s = line.strip(line_dedup.WHITE)
            if s and s not in first:
                first[s] = (d, k)
                order.append(s)
    for n, s in enumerate(order):
        if len(s) >= near and any(len(r) >= near and abs(len(r) - len(s)) <= edits and distance(r, s) <= edits for r in order[:n]):
            dropped.add(s)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) for s in [x.strip(line_dedup.WHITE)]
                                              if not s or (s not in dropped and first[s] == (d, k))) for d, t in docs}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 50))).strip() for _ in range(30)]
    docs = [(i, "\n".join(mutate(rng, rng.choice(pool), rng.randrange(4)) if rng.random() < 0.6 else rng.choice([" short ", "", rng.choice(pool) + " "])
                          for _ in range(rng.randrange(6)))) for i in range(150)]
    crowd = "".join(rng.choice("abcdefghij") for _ in range(60))
    docs += [(1000 + i, mutate(rng, crowd, rng.randrange(5))) for i in range(160)]  # one crowded group
    docs += [(1500 + i, "".join(rng.sample(crowd, 60))) for i in range(5)]  # equal letter counts, far apart
    docs += [(d, t) for d, t, _ in EDGE[:4]] + [(5, None)]
    docs = list(dict(docs).items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(docs, 2, 20)


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(frame(spark, EDGE))
    rows = out.collect()
    assert len(rows) == len(EDGE) and [r.text for r in rows if r.doc_id == 4] == ["same text here"] * 2
    assert [(r.text, r.n_lines) for r in rows if r.doc_id == 1] == [(None, 0)] and len([r for r in rows if r.doc_id == 5][0].text) == 150_000
    assert set(out.columns) >= {"score", "_doc", "n_words"}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.place(1 << 42, 0)


def test_line_dedup_keeps_unique_lines_under_shared_missing_and_large_ids(spark):
    """Different texts under one id or none, ids of any size, and documents of more than 2^20 lines lose repeated lines only."""
    rows = [(7, "first\nkeep one\nx"), (7, "unique\nfirst\ny"), (7, "unique third\nkeep two\nz"), (None, "alpha\nfirst"), (None, "beta\nbeta"), (None, "beta\nbeta"),
            (1 << 50, "big\nfirst"), ((1 << 62) + 1, "big\nonly here"), (-(1 << 60), "first of all\nbig")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    # the order: null ids by hash of the text, then by id; equal rows share their lines
    got = sorted((r.text for r in out))
    kept = [x for r in out for x in r.text.split("\n") if x]
    assert len(out) == len(rows) and sorted(set(kept)) == sorted({x for _, t in rows for x in t.split("\n")})
    twice = [r.text for r in out if r.text == "beta"]
    assert len(twice) == 2 and len(kept) == len(set(kept)) + 1
    assert "first of all\nbig" in got and "only here" in got and "alpha\nfirst" in got
    many = "\n".join(f"line {i}" for i in range((1 << 20) + 5)) + "\nline 3\nend\nline 1048578"
    long_ = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, many), (2, "line 1048577\nend\nnew")], "doc_id long, text string")).collect()}
    assert long_[1].n_dropped == 2 and long_[1].text == "\n".join(f"line {i}" for i in range((1 << 20) + 5)) + "\nend" and long_[2].text == "new"


def test_line_dedup_of_template_lines_writes_no_pairs(spark, monkeypatch):
    rng = random.Random(31)
    head, tail = "template of one line ", "".join(rng.choice("0123456789") for _ in range(40))
    lines = [head + "".join(rng.sample(tail, 40)) for _ in range(110)]  # equal letter counts, far apart
    lines += [mutate(rng, rng.choice(lines), 2) for _ in range(15)]
    docs = list(enumerate(lines))
    sizes = []

    def counted(df, name, *rest):
        out = written(df, name, *rest)
        sizes.append(out.count())
        return out

    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", counted)
    monkeypatch.setattr(line_dedup, "BLOCK", 24, raising=False)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(docs, 2, 20)
    assert max(sizes) < 20 * len(lines) < len(lines) * (len(lines) - 1) // 3


# --- SimHash

def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.choice(["alpha", "Beta", "gamma", "delta", "Ä"]) + str(rng.randrange(50)) for _ in range(900)]
    docs = list(EDGE)
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "other" + str(rng.randrange(9))
        docs.append((100 + i, " ".join(w), "en"))
    docs += [(400 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12))), "en") for i in range(60)]
    got = simhash.simhash_groups(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    prints = [brute_fingerprint(t, 4) for _, t, _ in docs]
    part = list(range(len(docs)))
    for _ in range(12):
        part = [min([part[i]] + [part[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 4]) for i in range(len(docs))]
    least = {}
    for (i, _, _), p in zip(docs, part):
        least[p] = min([x for x in (least.get(p), i) if x is not None], default=None)
    want = Counter((i, f, least[p]) for (i, _, _), f, p in zip(docs, prints, part))
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == want
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_simhash_crowded_keys_lose_no_link():
    rng = np.random.default_rng(1)
    n = 300
    fp = rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64((1 << 14) - 1)
    a, b = simhash.spanning_links(n, lambda i, rest: np.bitwise_count(fp[rest] ^ fp[i]) <= 2)
    part = {i: i for i in range(n)}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for x, y in zip(a, b):
        x, y = sorted((find(x), find(y)))
        part[y] = x
    for i in range(n):
        for j in range(i):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2:
                assert find(i) == find(j)


# --- embeddings

def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for centre in rng.normal(size=(40, 16)):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((n, (centre + rng.normal(scale=0.25, size=16)).tolist(), n % 3 if n % 7 else None))
            n += 1
    rows += [(n, rows[1][1], rows[1][2]), (n + 1, (np.array(rows[1][1]) * 7).tolist(), rows[1][2]), (n + 2, None, 1), (n + 3, [0.0] * 16, 1),
             (n + 4, [float("nan")] * 16, 1), (n + 5, [None] * 16, 1), (n + 6, [], 1), (n + 7, [1.0, 0.0], 1), (n + 8, [1e200] * 16, 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r.vec_id: r for r in embedding_dedup.dedup_embeddings(df, cell_rows=20, block=15).collect()}
    assert len(got) == len(rows)
    ok = [i for i, (v, x, lab) in enumerate(rows) if v is not None and lab is not None and x and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93] for i in ok}
    part = {i: i for i in ok}
    for _ in range(20):
        part = {i: min([part[i]] + [part[j] for j in near[i]]) for i in ok}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            r = got[v]
            assert (r.n_links, r.component_id, r.kept) == ((len(near[i]), part[i], part[i] == i) if i in part else (0, v, True))
    assert got[None].n_links == 0 and got[None].kept is False
    assert embedding_dedup.dedup_embeddings(df.limit(0)).count() == 0


def test_embeddings_under_repeated_ids(spark):
    near = [1.0, 0.02, 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, near, 0), (1, [0.0, 1.0, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (4, [0.0, 1.0, 0.02], 1),
            (9, [0.0, 0.0, 1.0], 2), (9, [0.0, 0.01, 1.0], 2)]
    got = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True)]


# --- language model

def test_lm_scores_against_sql(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["the", "The", "of", "a", "cat", "dog", "x" * 300, "é" + str(rng.randrange(30))]) for _ in range(rng.randrange(40))), "en") for i in range(80)]
    docs += [(100, None, "en"), (101, "", "en"), (102, "one", "en"), (103, "\n the\tof ", "en")]
    for vocabulary, frequent in ((12, 3), (65_535, 256)):
        got = {r.doc_id: r for r in lm_scores.lm_scores(frame(spark, docs), vocabulary=vocabulary, frequent=frequent).collect()}
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in docs])
        for doc_id, n, s, _ in con.execute(lm_scores.ORACLE.format(vocabulary=vocabulary, backoff=0.4)).fetchall():
            assert got[doc_id].n_words == n and abs(got[doc_id].logprob - s) < 0.01
    assert {r.doc_id for r in lm_scores.lm_scores(frame(spark, EDGE)).collect()} == {None, 1, 2, 3, 4, 5}
    assert lm_scores.lm_scores(frame(spark, [])).count() == 0


def test_lm_scores_of_every_word(spark):
    rng = random.Random(12)
    docs = [(i, " ".join(["The", f"Only{i}"] * (i % 2) + [f"w{rng.randrange(90_000)}" if rng.random() < 0.9 else rng.choice(["the", "of", "rare pair"]) for _ in range(1500)]), "en") for i in range(100)]
    docs += [(200 + i, f"alone{i % 2} pair{i % 2} of alone{i % 2} pair{i % 2} once{i}", "en") for i in range(4)] + [(300, "", "en"), (301, None, "en")]
    words = Counter(w for _, t, _ in docs for w in (t or "").lower().split())
    assert len(words) > 65_535
    got = {r.doc_id: r for r in lm_scores.lm_scores(frame(spark, docs).repartition(3)).collect()}
    pairs = Counter(p for _, t, _ in docs for w in [(t or "").lower().split()] for p in zip(w, w[1:]))
    total = sum(words.values())
    for i, t, _ in docs:
        w = (t or "").lower().split()
        mine = Counter(zip(w, w[1:]))
        want = sum(math.log(words[x] / total) for x in w[:1])
        for (a, b), n in mine.items():
            rest = pairs[a, b] - n
            want += n * (math.log(rest / words[a]) if rest else math.log(0.4 * words[b] / total))
        assert got[i].n_words == len(w) and abs(got[i].logprob - want) < 1e-6 * max(1, abs(want))
    assert len(got) == len(docs)


def test_lm_scores_where_no_first_word_has_a_number(spark, monkeypatch):
    """A stretch of texts in which every first word is a rare one has no numbered beginning, yet frequent pairs."""
    monkeypatch.setattr(lm_scores, "NUMBERED", 2)
    docs = [(i, f"rare{i} the of the of{' the' * i}", "en") for i in range(6)] + [(9, "rare9", "en")]
    words = Counter(w for _, t, _ in docs for w in t.split())
    pairs = Counter(p for _, t, _ in docs for p in zip(t.split(), t.split()[1:]))
    total = sum(words.values())
    got = {r.doc_id: r for r in lm_scores.lm_scores(frame(spark, docs).repartition(2)).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        w = t.split()
        want = math.log(words[w[0]] / total)
        for (a, b), n in Counter(zip(w, w[1:])).items():
            rest = pairs[a, b] - n
            want += n * (math.log(rest / words[a]) if rest else math.log(0.4 * words[b] / total))
        assert got[i].n_words == len(w) and abs(got[i].logprob - want) < 1e-9


def test_keyed_lines_hold_little_and_send_wanted_keys_only():
    """A task works on a batch in steps, which bound its memory; the second round's pass gives rows of the keys asked for."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(6)
    texts = [None, "", *["\n".join("".join(rng.choices("abcdefgh é😀", k=90)) for _ in range(40)) for _ in range(2_000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_002)), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    n = sum(out.num_rows for out in line_dedup.keyed_lines([batch], 2, 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 12 * 79_000 and peak < 60e6
    small = [batch.slice(0, 30)]
    every = [r for out in line_dedup.keyed_lines(small, 2, 20) for r in zip(*(out.column(i).to_pylist() for i in range(5)))]
    bitmap = np.zeros(1 << 19, dtype=np.uint64)
    keys = {r[0] for r in every[::100]}
    for k in keys:
        slot = k & ((1 << 25) - 1)
        bitmap[slot >> 6] |= np.uint64(1 << (slot & 63))
    some = [r for out in line_dedup.keyed_lines(small, 2, 20, bitmap) for r in zip(*(out.column(i).to_pylist() for i in range(5)))]
    assert set(some) <= set(every) and {r for r in every if r[0] in keys} <= set(some) and len(some) < len(every) / 10


def test_crowded_keys_give_their_lines_for_the_second_round(spark, monkeypatch):
    """The lines of a key in which a line has more candidates are written once each, so the second round reads no text for its keys."""
    import pyarrow as pa

    def table(*groups):  # (key, lines, letters of the line): equal letters pass the bound
        rows = [(key, 1000 * key + i, 5000 - i, letters(i), i % 3 > 0) for key, n, letters in groups for i in range(n)]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "line", "place", "letters", "is_index"])

    far = random.Random(5).sample(range(1 << 62), 100)  # no two of these pass it
    out = [r for b in line_dedup.candidates(table((1, 100, lambda i: 0), (2, 40, lambda i: 0), (3, 100, lambda i: far[i])), 2) for r in b.to_pylist()]
    lines = [r for r in out if r["key"] is not None]
    assert sorted(r["b"] for r in lines) == list(range(1000, 1100)) and {r["key"] for r in lines} == {1} and all(r["a"] is None for r in lines)
    pairs = [r for r in out if r["key"] is None]
    assert {r["b"] for r in lines if r["more"]} == {r["b"] for r in pairs if r["more"]} != set()
    assert [(r["b_place"], r["is_index"]) for r in sorted(lines, key=lambda r: r["b"])] == [(5000 - i, i % 3 > 0) for i in range(100)]
    # a whole run: the open lines are found and the texts are cut into keys once
    rng = random.Random(32)
    tail = "".join(rng.choice("0123456789") for _ in range(40))
    texts = ["template of one line " + "".join(rng.sample(tail, 40)) for _ in range(90)]
    passes = []
    map_in_arrow = type(spark.range(1)).mapInArrow

    def counted(self, run, schema, *rest):
        if schema == line_dedup.KEYED:
            passes.append(schema)
        return map_in_arrow(self, run, schema, *rest)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    opened, open_linked = [], line_dedup.open_linked
    monkeypatch.setattr(line_dedup, "open_linked", lambda *a: opened.append(1) or open_linked(*a))
    docs = list(enumerate([*texts, *[mutate(rng, rng.choice(texts), 2) for _ in range(10)]]))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_lines(docs, 2, 20) and opened and len(passes) == 1


def test_lm_scores_hold_little_of_a_batch():
    """A task works on a batch in steps, which bound its memory; an empty or missing text has no words."""
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", *["One two  three\nfour " * 5_000] * 200, "tail"]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(202)]), pa.array(texts)], ["id", "text"]).slice(1)
    tracemalloc.start()
    words, rows = lm_scores.Words(), []
    for ids, h, of in lm_scores._runs(batch, words):
        rows += [(i, len(set(h[of == k].tolist())), (of == k).sum()) for k, i in enumerate(ids.tolist())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(0, 0, 0), *[(i, 4, 20_000) for i in range(1, 201)], (201, 1, 1)] and peak < 80e6


def test_lm_scores_shuffle_rare_pairs_once(spark):
    """Rows of pairs are dealt by a word that has no number once, which serves the pairs' sums and the words' counts."""
    entries = spark.createDataFrame([(1, 900, 5, 2, 7), (2, 900, 5, 1, 7), (1, 900, None, 1, 0), (2, 900, 6, -1, 9)], "id long, word long, other long, times long, n long")
    rows = lm_scores.rare_scores(entries, 50, 0.4, 4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(word") == 1 and plan.count("Exchange") == 2 and plan.count(" Sort [") == 2  # logical and physical
    c = 2 + 1 + 1
    want = {1: 2 * math.log(1 / 7) + math.log(c / 50), 2: math.log(2 / 7) + math.log(0.4 * 9 / 50)}
    assert {r.id: round(r.logprob, 9) for r in rows.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_tasks_on_groups_give_back_freed_memory(monkeypatch):
    """A worker that has compared groups returns its freed memory when the task ends, not before."""
    from types import SimpleNamespace

    import pyarrow as pa

    from offerlab.llm import blocks

    done = []
    monkeypatch.setattr(blocks, "give_back", lambda: done.append(1), raising=False)
    df = SimpleNamespace(columns=["key"], repartition=lambda *a: df, sortWithinPartitions=lambda *a: df, mapInArrow=lambda task, schema: task)
    task = blocks.grouped(df, "key", lambda t: iter(t.to_batches()), "key long", 2)
    out = task(iter([pa.RecordBatch.from_arrays([pa.array([1, 1, 2])], ["key"])]))
    assert next(out).column(0).to_pylist() == [1, 1] and not done
    assert [b.column(0).to_pylist() for b in out] == [[2]] and done == [1]


# --- pipeline

def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline
    from offerlab.llm.common import written

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, kept, sf_small), name)
        assert out.columns == docs.columns and set(r[0] for r in out.select("doc_id").collect()) <= set(r[0] for r in kept.select("doc_id").collect())
        if name == "line_dedup":
            before = [(r.doc_id, r.text) for r in kept.collect()]
            assert {r.doc_id: r.text for r in out.collect()} == brute_lines(before, 2, 20)
        if name == "simhash_near_dedup":
            groups = {r.component_id for r in simhash.simhash_groups(kept).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(groups)
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_small).toPandas()
    assert set(packed.doc_id) == {r[0] for r in kept.select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(200)) for _ in range(9)]
    assert all((brute_fingerprint(a, 4) ^ brute_fingerprint(b, 4)).bit_count() > 4 for i, a in enumerate(texts) for b in texts[:i])
    alone = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])]  # no id, and one id twice
    copies = [(None, texts[4])] * 3 + [(8, texts[5])] * 2 + [(None, texts[6]), (9, texts[6]), (7, texts[6]), (None, texts[7].upper()), (None, texts[7])]
    docs = frame(spark, [(i, t, "en") for i, t in alone + copies] + [(1, None, "en"), (None, "", "en")]).repartition(5)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = Counter((r.doc_id, (r.text or "").lower()) for r in out.collect())
    assert got == Counter(alone + [(None, texts[4]), (8, texts[5]), (7, texts[6]), (None, texts[7]), (1, "")])
    assert out.columns == docs.columns and corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    rows = EDGE + [(100 + i, f"A plain sentence number {i} about the weather today, and then some more of it.", "en") for i in range(20)]
    frame(spark, rows).write.parquet(str(tmp_path / "a/documents.parquet"))
    frame(spark, []).write.parquet(str(tmp_path / "b/documents.parquet"))
    for d in "ab":
        spark.createDataFrame([(100, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / d / "labels.parquet"))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()}
    assert ids <= {r[0] for r in rows} and ids
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_written_holds_arrow_batches_to_a_few_megabytes(spark):
    """Texts come to a Python worker in batches of bounded bytes; a lower limit of the session stays."""
    import pyarrow as pa

    from offerlab.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id", "repeat('some text ', 600) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    try:
        for was, now in ((before, str(common.BATCH_BYTES)), ("64m", str(common.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(name, was)
            got = [r.bytes for r in common.written(docs.mapInArrow(sizes, "bytes long"), "sizes").collect()]
            assert spark.conf.get(name) == now and len(got) > 3 and max(got) < 1.1 * common.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
