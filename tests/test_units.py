"""Hand fixtures for the traps and the non-SQL operators."""

import hashlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlab.config import DEFAULT_PARAMS as P, POLICY_ORDER
from offerlab.functions import vectors as V
from offerlab.functions.hashing import stable_index
from offerlab.functions.stats import exact_median, kth_smallest
from offerlab.operators import feedback_fold as FF
from offerlab.operators import offers as G
from offerlab.operators import retrieval as H


def test_whole_days_floor(spark):
    from offerlab.operators.rfm import whole_days

    df = spark.createDataFrame([(datetime(2020, 1, 1, 12), datetime(2020, 1, 3, 0))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(whole_days(F.col("a"), F.col("b")).alias("d")).first()["d"] == 1


def test_vector_helpers(spark):
    df = spark.createDataFrame([(1.0, 3.0, 3.0, 0.0), (2.0, 2.0, 2.0, 2.0), (-1.0, -2.0, 0.0, -3.0)],
                               "v0 double, v1 double, v2 double, v3 double")
    v = V.cols("v", 4)
    out = df.select(F.expr(V.argmax(v)).alias("am"), F.expr(V.top_indices(v, 3)).alias("top"),
                    *[F.expr(x).alias(f"d{i}") for i, x in enumerate(V.to_distribution(v))],
                    *[F.expr(x).alias(f"m{i}") for i, x in enumerate(V.minmax(v))]).collect()
    assert [r["am"] for r in out] == [1, 0, 2]          # first maximum wins
    assert out[0]["top"] == [2, 1, 0]                    # ties: higher index first
    assert [out[2][f"d{i}"] for i in range(4)] == [0.25] * 4   # zero total -> uniform
    assert [out[1][f"m{i}"] for i in range(4)] == [0.0] * 4    # constant row -> zeros


def test_stable_index_matches_md5(spark):
    keys = ["3|17|abc|uplift|loyal", "0|0||", "4|9|客户-ü|fusion|new"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r["i"] for r in df.select(stable_index(F.col("k"), 7).alias("i")).collect()]
    want = [int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % 7 for k in keys]
    assert got == want


@pytest.mark.parametrize("vals", [[5.0, 1.0, 3.0], [4.0, 1.0, 3.0, 2.0], [7.0, 7.0, 7.0, 1.0, 9.0, 7.0]])
def test_exact_median(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    assert exact_median(df, "x") == float(np.median(vals))


def test_kth_smallest_refinement_path(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    srt = np.sort(vals)
    for k in (0, 1234, 2600, 4999):
        assert kth_smallest(df, "x", k) == srt[k]


def model_chunks(text, size=512, overlap=100):
    """Chunks by exhaustive search over piece ranges, written apart from the fold."""
    sep = next((x for x in ["\n\n", "\n", "。", "！", "？", "；", ".", " "] if x in text), " ")
    pieces = [p for p in (x.strip() for x in text.split(sep)) if p]
    total = lambda a, b: sum(map(len, pieces[a:b]))
    out, first, n = [], 0, len(pieces)
    while n:
        end = next((e for e in range(first + 1, n + 1) if e == n or total(first, e + 1) > size and e >= done(out, first)), n)
        out.append((first, end))
        if end == n:
            break
        first = next(t for t in range(first, end + 1) if total(t, end) <= overlap)
    return [sep.join(pieces[a:b]) for a, b in out]


def done(out, first):
    """A chunk that begins with repeated pieces holds at least the first new one."""
    return out[-1][1] + 1 if out and out[-1][1] > first else first + 1


def test_chunks_against_a_separate_model(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdé")) for _ in range(int(rng.integers(1, 160))))
    texts = ["a.b.c", "  \n  ", "", "x" * 600, "q" * 600 + " tail", "\n".join(["x" * 300, "y" * 150, "z" * 90, "w" * 200]), "　wide\n　space　", None]
    texts += [sep.join(word() for _ in range(int(rng.integers(1, 25)))) for sep in ("\n\n", "\n", "。", "！", "？", "；", ".", " ") for _ in range(6)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {}
    for r in H.chunk_corpus(df).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: c for i, t in enumerate(texts) if t is not None for c in [model_chunks(t)] if c}


def test_knowledge_is_read_from_any_path(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("  one\n")
    (tmp_path / "b.md").write_text("two")
    (tmp_path / "c.csv").write_text("three")
    (tmp_path / "d.txt").write_text(" \n ")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert sorted(map(tuple, H.load_knowledge(spark, path).collect())) == [("a.TXT", "one"), ("b.md", "two")]
    assert H.load_knowledge(spark, f"{tmp_path}/none").count() == 0


def test_model_output_parsing(spark):
    rows = [('{"offer": "x", "tone": "y"}', ("x", "y")), ("{}", None), ("", None), (None, None), ('```json\n{"offer": "x"}\n```', None), ("{broken", None), ('{"other": 1}', (None, None))]
    df = spark.createDataFrame([(r,) for r, _ in rows], "raw string").select("raw", G.parse_strategy(F.col("raw")).alias("p"))
    assert [None if r.p is None else (r.p.offer, r.p.tone) for r in df.collect()] == [w for _, w in rows]


def test_fallback_offer(spark):
    req = spark.createDataFrame([(None, 1, "c", "uplift", "new"), (7, 2, "c", None, None)],
                                "action_id int, round_id long, customer_unique_id string, routed_tool string, user_segment string")
    a, b = G.resolve_offers(req, G.catalog_df(spark)).orderBy("round_id").collect()
    assert (a.offer_id, a.template_id, a.offer_text, a.total_cost) == ("fallback_action_0", "fallback", G.FALLBACK_TEXTS[0], 0.0)
    assert b.offer_id.startswith("action_2_tpl_")
    empty = G.resolve_offers(req, G.catalog_df(spark, [])).orderBy("round_id").collect()
    assert [r.offer_id for r in empty] == ["fallback_action_0", "fallback_action_7"]


def test_dense_index(spark):
    from offerlab.operators.feedback import with_dense_index

    ids = [int(x) for x in np.random.default_rng(3).permutation(500) * 7]
    got = {r.round_id: r.round_idx for r in with_dense_index(spark.createDataFrame([(i,) for i in ids], "round_id long")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_discount_amount(spark):
    rows = [("满100减20 + 包邮", 100.0, 20.0), ("新人立减30元", 100.0, 30.0), ("限时9折", 200.0, 20.0),
            ("0.05折", 100.0, 99.0), ("12折", 100.0, 0.0), ("no discount", 100.0, 5.0), ("", 100.0, 5.0),
            ("满100减20", 0.0, 5.0)]
    df = spark.createDataFrame(rows, "t string, aov double, want double")
    got = df.select(G.discount_amount(F.col("t"), F.col("aov")).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]


def _events(n=300, keys=4, seed=3):
    rng = np.random.default_rng(seed)
    pols = POLICY_ORDER + ["auto", "Bandit", "unknown"]
    return pd.DataFrame({
        "router_key": [f"k{i}" for i in rng.integers(0, keys, n)],
        "event_time": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10_000, n), unit="m"),
        "event_id": rng.permutation(n).astype("int64"),
        "policy": [pols[i] for i in rng.integers(0, len(pols), n)],
        "metric_value": rng.normal(0.4, 0.3, n),
        "baseline": np.full(n, 0.35),
    })


FEEDBACK = "router_key string, event_time timestamp, event_id long, policy string, metric_value double, baseline double"


def plain_fold(pdf, p=P):
    """One event after the other, with the bound and the mean written out."""
    state, out = {}, {}
    names = {"bandit": "contextual_bandit", "unknown": "rule_engine"}
    for r in pdf.sort_values(["event_time", "event_id"]).itertuples(index=False):
        bias, count, em = state.setdefault(r.router_key, ([0.0] * 5, [0] * 5, [0.0] * 5))
        name = names.get(r.policy.lower(), r.policy)
        ok = name in POLICY_ORDER
        if ok:
            i = POLICY_ORDER.index(name)
            metric = 0.0 if r.metric_value is None or np.isnan(r.metric_value) else r.metric_value
            push = p.feedback_lr * min(max(metric - r.baseline, -p.feedback_clip), p.feedback_clip)
            moved = [b * (1 - p.feedback_decay) + (push if j == i else 0) for j, b in enumerate(bias)]
            bias[:] = [min(max(b - sum(moved) / 5, -1.5), 1.5) for b in moved]
            count[i] += 1
            em[i] = (1 - p.feedback_ema) * em[i] + p.feedback_ema * metric
        out[r.event_id] = (ok, tuple(bias), count[i] if ok else None, em[i] if ok else None)
    return out


def same_fold(rows, want):
    assert {r.event_id for r in rows} == set(want)
    for r in rows:
        ok, bias, count, em = want[r.event_id]
        assert r.enabled == ok
        np.testing.assert_allclose([r[f"bias_{p}"] for p in POLICY_ORDER], bias, atol=1e-11)
        if ok:
            assert r.feedback_count == count and r.ema_metric == pytest.approx(em, abs=1e-11)
        else:
            assert r.metric_value is None and r.reason == "invalid_policy"


@pytest.mark.parametrize("params", [P, P.with_(feedback_lr=3.0, feedback_clip=2.0), P.with_(feedback_decay=0.9), P.with_(feedback_ema=1.0)])
def test_feedback_fold_matches_sequential(spark, params):
    pdf = _events(n=600, keys=2)
    pdf.loc[::17, "metric_value"] = np.nan
    got = FF.fold_feedback(spark.createDataFrame(pdf, FEEDBACK), params, partitions=5).collect()
    same_fold(got, plain_fold(pdf, params))


def test_snapshot_takes_the_last_event_in_time(spark):
    rows = [("k", datetime(2024, 1, 1, 0, 0), 9, "uplift", 0.5, 0.3), ("k", datetime(2024, 1, 1, 0, 1), 2, "fusion", None, 0.3)]
    folded = FF.fold_feedback(spark.createDataFrame(rows, FEEDBACK))
    last = folded.where("event_id = 2").first()
    snap = FF.bias_snapshot(folded).first()
    assert snap.events == 2 and snap.bias_fusion == round(last.bias_fusion, 6) and last.metric_value == 0.0 and last.bias_fusion < 0


def test_disabled_feedback_changes_nothing(spark):
    rows = FF.fold_feedback(spark.createDataFrame(_events(30), FEEDBACK), P.with_(feedback_enabled=False)).collect()
    assert len(rows) == 30 and all(r.reason == "disabled" and r.bias_uplift == 0.0 for r in rows)


def test_feedback_stream_equals_batch_for_shuffled_and_late_rows(spark, tmp_path):
    from offerlab.streaming.feedback_stream import run_feedback_stream

    pdf = _events(n=200, keys=3, seed=5)  # seven days, in files by hash
    src, ck, sink = (str(tmp_path / x) for x in ("src", "ck", "sink"))
    spark.createDataFrame(pdf, FEEDBACK).repartition(6, "event_id").write.parquet(src)
    run_feedback_stream(spark, src, ck, sink, P, max_files=2, watermark="8 days")
    end = pdf["event_time"].max()
    more = [(k, (end + pd.Timedelta(days=20)).to_pydatetime(), -1, "auto", 0.0, 0.0) for k in sorted(set(pdf["router_key"]))]
    spark.createDataFrame(more, FEEDBACK).coalesce(1).write.mode("append").parquet(src)
    out = run_feedback_stream(spark, src, ck, sink, P, max_files=2, watermark="8 days")
    same_fold(out.collect(), plain_fold(pdf))
    late = [("k0", datetime(2024, 1, 1), -2, "uplift", 9.0, 0.0)]  # long before the watermark
    spark.createDataFrame(late, FEEDBACK).coalesce(1).write.mode("append").parquet(src)
    out = run_feedback_stream(spark, src, ck, sink, P, max_files=2, watermark="8 days").collect()
    same_fold([r for r in out if r.event_id != -2], plain_fold(pdf))
    assert all(r.reason == "late" for r in out if r.event_id == -2)


def test_reward_model_ridge_matches_numpy(spark):
    from offerlab.operators.reward_model import fit_reward_model

    rng = np.random.default_rng(0)
    rows = []
    for a, n in enumerate([60, 19, 20, 0, 40]):
        for i in range(n):
            x = rng.normal(size=7)
            rows.append((a, float(rng.integers(0, 2)), float(rng.uniform(0.01, 0.9)), *map(float, x)))
    df = spark.createDataFrame(rows, "action int, reward double, pscore double, " +
                               ", ".join(f"x{i} double" for i in range(7)))
    m = fit_reward_model(df, P)
    pdf = df.toPandas()
    for a in range(5):
        sub = pdf[pdf.action == a]
        if len(sub) < 20:
            assert np.allclose(m.thetas[a], 0) and np.allclose(m.a_invs[a], np.eye(7))
            continue
        X = sub[[f"x{i}" for i in range(7)]].to_numpy()
        w = np.clip(1 / np.clip(sub.pscore.to_numpy(), 1e-6, None), 1, 50)
        A = (X * w[:, None]).T @ X + np.eye(7)
        b = (X * w[:, None]).T @ sub.reward.to_numpy()
        np.testing.assert_allclose(m.thetas[a], np.linalg.solve(A, b), rtol=1e-9, atol=1e-12)
    assert m.counts[3] == 0 and m.means[3] == pytest.approx(pdf.reward.mean())


def test_stored_buckets_give_k_and_good_recall(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = H.label_centroid_queries(vectors, 64)
    H.build_buckets(vectors, str(tmp_path / "index"), P.with_(nlist=20))
    exact = {(r.query_id, r.vec_id) for r in H.exact_topk(vectors, queries, 10).collect()}
    near = H.bucketed_topk(spark, str(tmp_path / "index"), queries, 10, P.with_(nprobe=16)).collect()
    assert len(near) == len(exact) == 10 * len(queries)
    assert len(exact & {(r.query_id, r.vec_id) for r in near}) >= 0.9 * len(exact)
    few = H.bucketed_topk(spark, str(tmp_path / "index"), queries, 90, P.with_(nprobe=1)).collect()
    assert len(few) == 90 * len(queries)  # buckets are added until they hold k vectors


# --- as-of join, decisions as a stream

def test_asof_join_is_strictly_before_and_splits_hot_keys(spark):
    import random

    from offerlab.operators.asof import asof_join

    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(key(), rng.randrange(60), i, "x") for i in range(150)]
    right = [(key(), rng.randrange(60), 1000 + i if rng.random() < .5 else i, float(i)) for i in range(120)]
    at = lambda s: f"timestamp_seconds({s})"
    ldf = spark.createDataFrame(left, "k string, s long, id long, v string").selectExpr("k", f"{at('s')} t", "id", "v", "s")
    rdf = spark.createDataFrame(right, "k string, s long, id long, v double").selectExpr("k", f"{at('s')} t", "id", "v")
    got = {(r.id): r.v for r in asof_join(ldf, rdf, ("k", "t", "id"), ("k", "t", "id"), ["v"], 7).collect()}
    for k, s, i, _ in left:
        before = [(rs, ri, v) for rk, rs, ri, v in right if rk == k and (rs, ri) < (s, i)]
        assert got[i] == (max(before)[2] if before else None)
    assert len(got) == 150
    assert asof_join(ldf.where("false"), rdf, ("k", "t", "id"), ("k", "t", "id"), ["v"]).count() == 0
    assert {r.v for r in asof_join(ldf, rdf.where("false"), ("k", "t", "id"), ("k", "t", "id"), ["v"]).collect()} == {None}


def _arrivals(spark, path, files):
    """Files of (customer, key, second, id, policy, metric), each a list of rows."""
    schema = "customer_unique_id string, router_key string, s long, event_id long, policy string, metric_value double"
    for rows in files:
        df = spark.createDataFrame(rows, schema).selectExpr("customer_unique_id", "router_key", "timestamp_seconds(s) event_time", "event_id", "policy", "metric_value", "0.1D baseline")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return df.schema


def test_decision_stream_equals_the_batch_fold(spark, tmp_path):
    """Shuffled arrivals within the delay give the batch result; only the delay's rounds wait; a row behind the watermark is late."""
    import random

    from offerlab.config import POLICY_ORDER
    from offerlab.operators import feedback_fold as FF
    from offerlab.operators.asof import asof_join
    from offerlab.streaming.decision_stream import BIAS, DecisionStream

    rng = random.Random(5)
    rows = [(f"c{rng.randrange(5)}", rng.choice(["vip", "vip", "regular", None]), 10 * i, i, rng.choice([*POLICY_ORDER, "nobody"]), rng.random()) for i in range(120)]
    arrived = sorted(rows, key=lambda r: r[2] + rng.randrange(100))
    files = [arrived[i:i + 40] for i in (0, 40, 80)]
    for f in files:
        rng.shuffle(f)
    files[2] = files[2] + [("c1", "vip", 5, 999, "fusion", 1.0)]  # long after its time
    schema = _arrivals(spark, str(tmp_path), files)
    profiles = spark.createDataFrame([(f"c{i}", i) for i in range(4)], "customer_unique_id string, recency int")
    stream = DecisionStream(str(tmp_path / "s"), profiles, lambda df: df.select("event_id", "recency", "late", *BIAS), "100 seconds")
    batches = stream.run(spark, f"{tmp_path}/in", schema)
    assert batches == 3
    for b in range(batches):
        waiting = stream.table(spark, "waiting", b)
        low = stream.table(spark, "watermark", b).first()["watermark"]
        assert waiting.where(F.col("event_time") < F.lit(low)).count() == 0
        assert waiting.count() <= 100 / 10 + 1 and stream.table(spark, "state", b).count() <= 3
    stream.finish(batches)
    got = {r.event_id: r for r in stream.table(spark, "decisions").collect()}
    assert len(got) == 121 and [i for i, r in got.items() if r.late] == [999]
    log = spark.createDataFrame(rows, "customer_unique_id string, router_key string, s long, event_id long, policy string, metric_value double").selectExpr(
        "router_key", "timestamp_seconds(s) event_time", "event_id", "policy", "metric_value", "0.1D baseline")
    fold = FF.fold_feedback(log)
    want = asof_join(log, fold, ("router_key", "event_time", "event_id"), ("router_key", "event_time", "event_id"), BIAS).collect()
    for r in want:
        assert [got[r.event_id][c] for c in BIAS] == pytest.approx([r[c] or 0.0 for c in BIAS], abs=1e-9)
    folded = {r.event_id: [r[c] for c in BIAS] for r in stream.table(spark, "folded").collect()}
    assert set(folded) == {r[3] for r in rows}
    for r in fold.collect():
        assert folded[r.event_id] == pytest.approx([r[c] for c in BIAS], abs=1e-9)
    assert {r.recency for r in got.values()} == {0, 1, 2, 3, None}


def test_money_of_a_missing_amount(spark):
    from offerlab.functions.text import money2

    rows = spark.createDataFrame([(1.005,), (None,), (-0.0,)], "x double").select(money2(F.col("x")).alias("m")).collect()
    assert [r.m for r in rows][1] == "null" and rows[0].m in ("1.00", "1.01")


# --- exact split, exact AUC, model store

def test_exact_split_counts_with_ties(spark):
    """Exactly the share of each label trains, also where rows repeat or a label is NULL."""
    from collections import Counter

    from offerlab.operators.splits import exact_split, train_count

    rows = [(None if i % 11 == 0 else i % 3, f"k{i}") for i in range(200)] + [(0, "same")] * 60 + [(7, "one")]
    df = spark.createDataFrame(rows, "label int, k string").repartition(5)
    got = exact_split(df, "label", F.col("k"), 0.8).collect()
    n = Counter(r[0] for r in rows)
    assert Counter((r.label, r.split) for r in got if r.split == "train") == {(x, "train"): train_count(c, 0.8) for x, c in n.items() if train_count(c, 0.8)}
    assert Counter((r.label, r.k) for r in got) == Counter(rows)
    assert [train_count(k, 0.8) for k in (0, 1, 4, 5, 10)] == [0, 0, 3, 4, 8]
    assert exact_split(df.where("false"), "label", F.col("k"), 0.8).collect() == []


def test_exact_auc_with_ties(spark):
    from offerlab.functions.stats import exact_auc

    rng = np.random.default_rng(2)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 12, 300), rng.integers(0, 2, 300))] + [(None, 1), (float("nan"), 0), (3.0, None), (0.0, 1), (-0.0, 0)]
    good = [(s, y) for s, y in rows if s is not None and s == s and y is not None]
    pos, neg = [s for s, y in good if y], [s for s, y in good if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, y int")
    got = exact_auc(df, "s", "y", 5).first()
    assert (got.positives, got.negatives) == (len(pos), len(neg)) and got.auc == pytest.approx(want, abs=1e-12)
    assert exact_auc(df.where("y = 1"), "s", "y").first().auc is None
    assert exact_auc(df.where("false"), "s", "y").first().positives == 0


def test_model_store_loads_what_it_holds(spark, tmp_path):
    from pyspark.ml.clustering import KMeans, KMeansModel
    from pyspark.ml.linalg import Vectors

    from offerlab.operators.model_store import ModelStore, model_key
    from offerlab.operators.reward_model import RewardModel

    path = str(tmp_path / "models")
    points = spark.createDataFrame([(Vectors.dense([float(i % 2) * 9, 1.0]),) for i in range(20)], ["features"])
    store = ModelStore(spark, path)
    assert store.manifest().count() == 0
    first = store.ml("kmeans", model_key(params=P, data="a"), lambda: KMeans(k=2, seed=1).fit(points), KMeansModel)
    ridge = RewardModel(2, 3, np.array([5, 9]), np.array([.1, .2]), np.arange(6.).reshape(2, 3), np.arange(18.).reshape(2, 3, 3), 4)
    store.ridge("k", lambda: ridge)
    assert store.get("none", "k", lambda: None, None, None) is None
    assert store.fitted == ["kmeans", "ridge", "none"]

    def never():
        raise AssertionError("fitted again")

    again = ModelStore(spark, path)
    second = again.ml("kmeans", model_key(params=P, data="a"), never, KMeansModel)
    assert [c.tolist() for c in second.clusterCenters()] == [c.tolist() for c in first.clusterCenters()]
    back = again.ridge("k", never)
    assert (back.thetas == ridge.thetas).all() and (back.a_invs == ridge.a_invs).all() and back.min_samples == 4 and back.counts.tolist() == [5, 9]
    assert again.fitted == []
    assert model_key(params=P.with_(alpha=.7), data="a") != model_key(params=P, data="a") != model_key(params=P, data="b")
    again.ridge("k", lambda: RewardModel(2, 3, ridge.counts, ridge.means + 1, ridge.thetas, ridge.a_invs, 4), refresh=True)
    assert ModelStore(spark, path).ridge("k", never).means.tolist() == [1.1, 1.2] and again.manifest().count() == 2


def test_second_report_fits_nothing(spark, tmp_path):
    """The report with the conversion model; its second run loads all models and gives the same rows."""
    from offerlab.operators.model_store import ModelStore
    from offerlab.plans.decision import decision_report

    small = P.with_(gbt_rounds=3, gbt_depth=3, router_trees=5)
    path = str(tmp_path / "models")
    first = ModelStore(spark, path)
    columns = ["round_id", "policy", "confidence", "base_conversion", "roi"]
    one = sorted(map(tuple, decision_report(spark, "/root/testdata/sf0.001", small, store=first).select(*columns).collect()))
    second = ModelStore(spark, path)
    two = sorted(map(tuple, decision_report(spark, "/root/testdata/sf0.001", small, store=second).select(*columns).collect()))
    assert set(first.fitted) >= {"ridge", "conversion"} and set(second.fitted) <= {"router"} and one == two
    assert len({r[3] for r in one}) > 1 and all(0.001 <= r[3] <= 0.5 for r in one)


# --- search with text, stored index with a certificate

def test_certified_search_is_exact_reads_few_buckets_and_takes_appends(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(600)] + [(1000 + i, centres[3].tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = [(j, (centres[j] / np.linalg.norm(centres[j])).tolist()) for j in (0, 3, 7)] + [(20, [0.0] * 16)]
    path = str(tmp_path / "index")
    H.build_buckets(df.where("vec_id < 500"), path, P.with_(nlist=12))
    H.append_buckets(df.where("vec_id >= 500").withColumnRenamed("embedding", "v"), path)
    assert sum(c[2] for c in H.stored_centres(spark, path)) == len(rows)
    for k in (1, 5, 40):
        best, share = H.certified_topk(spark, path, queries[:3], k, P.with_(nprobe=1))
        want = {(r.query_id, r.vec_id, r["rank"]) for r in H.exact_topk(df, queries[:3], k).collect()}
        assert {(r.query_id, r.vec_id, r["rank"]) for r in best.collect()} == want
        assert share <= 0.5
    zero, share = H.certified_topk(spark, path, queries[3:], 3, P.with_(nprobe=1))  # all score 0: the smallest ids, and every bucket is read
    assert [r.vec_id for r in zero.orderBy("rank").collect()] == [0, 1, 2] and share == 1.0


def test_search_joins_back_to_text_and_blank_queries_find_nothing(spark):
    from offerlab.operators.knowledge import KnowledgeIndex, knowledge_of

    chunks = spark.createDataFrame([(1, 0, "a.md", "red apples and pears"), (1, 1, "a.md", "blue whales sing"), (2, 0, None, "red apples and pears"),
                                    (3, 0, "b.md", ""), (4, 0, "b.md", None), (5, 0, "c.md", "Whales, whales; WHALES!")], "doc_id long, chunk_no int, source string, text string")
    index = KnowledgeIndex(chunks)
    queries = spark.createDataFrame([(1, "red apples"), (2, "  "), (3, None), (4, "whales"), (5, "unheardof")], "query_id long, text string")
    for block in (1, 100):
        got = {}
        for r in index.search(queries, 2, block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.chunk_no, r.text)
        assert got[1] == {1: (1, 0, "red apples and pears"), 2: (2, 0, "red apples and pears")}  # a tie: the smaller id first
        assert got[4][1] == (5, 0, "Whales, whales; WHALES!") and set(got) <= {1, 4, 5}
    known = {r.query_id: r.knowledge for r in knowledge_of(index.search(queries, 2)).collect()}
    assert known[1] == "1. red apples and pears [a.md]\n2. red apples and pears []"
    assert KnowledgeIndex(chunks.where("false")).search(queries, 2).count() == 0
    assert index.search(queries.where("false"), 2).count() == 0


def test_chunk_words_are_weighed_without_a_shuffle_of_words(spark):
    from offerlab.operators import knowledge as N

    rows = [(i, 0, "m", f"the cat {'sat' if i % 2 else 'ran'} w{i} w{i} the{i % 3}") for i in range(30)] + [(90, 0, "m", "the"), (91, 0, "m", "only91"), (92, 0, None, "?!")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, source string, text string")
    indexes = [N.KnowledgeIndex(chunks, common_words=n) for n in (N.COMMON_WORDS, 3, 1)]
    shown = [{r.doc_id: [round(x, 9) for x in r.v] for r in i.vectors.collect()} for i in indexes]
    plain = N.projected(N.word_counts(chunks, ["doc_id", "chunk_no"]), indexes[0].weights.drop("df"), ["doc_id", "chunk_no"])
    want = {r.doc_id: [round(x, 9) for x in r.v] for r in plain.collect()}
    assert set(want) == set(range(30)) | {90, 91} and all(got == want for got in shown)
    plan = N.chunk_vectors(indexes[0].chunks, indexes[0].weights)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_only_the_common_words_reach_the_driver(spark, monkeypatch):
    from offerlab.operators import knowledge as N

    texts = spark.createDataFrame([(" ".join(f"w{j}" for j in range(40) if i % (j + 1) == 0),) for i in range(60)], "text string")
    weights = N.word_weights(texts, F.lit(60)).cache()
    df = {r.word: r.df for r in weights.collect()}
    kind, collected = type(weights), []
    monkeypatch.setattr(kind, "orderBy", None)  # the words are not sorted in one place
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: collected.append(plain(self)) or collected[-1])
    for most in (5, 13, 39, 40):
        (words, idf, dims, signs), whole = N.commonest(weights, most)
        nth = sorted(df.values(), reverse=True)[most] if most < 40 else 0
        assert set(words.to_pylist()) == {w for w, n in df.items() if n > nth} and whole == (most == 40)
        assert len(idf) == len(dims) == len(signs) == collected[-1].num_rows <= most and dims.shape[1] == signs.shape[1] == N.SPREAD
    chunks = texts.select(F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("chunk_no"), "text")
    assert N.chunk_vectors(chunks, weights, 13).count() == 60


def test_negatives_are_drawn_from_the_whole_hot_list(spark):
    import hashlib

    from offerlab.operators import evaluation as I

    hot = list(range(100, 120))
    bought = {c: [100 + c % 20, 100 + 7 * c % 20, 5] for c in range(40)} | {99: hot}
    rows = [(c, p, 1.0, 10.0, 1.0, 2.0, 1) for c, some in bought.items() for p in some]
    pos = spark.createDataFrame(rows, "customer_unique_id long, product_id long, recency double, order_total double, item_count double, freight_total double, label int")
    got = {}
    for r in I.negatives(pos, hot, P).collect():
        got.setdefault(r.customer_unique_id, set()).add(r.product_id)
    place = lambda c, p: (hashlib.md5(f"{P.seed}|{c}|{p}".encode()).hexdigest()[:8], p)
    want = {c: set(sorted(set(hot) - set(some), key=lambda p: place(c, p))[:P.negatives_per_customer]) for c, some in bought.items()}
    assert got == {c: w for c, w in want.items() if w} and 99 not in got
    assert I.negatives(pos, [], P).count() == 0


def test_boosted_trees_learn_from_counted_bins_as_from_all_rows(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from offerlab.operators import evaluation as I

    rng = np.random.default_rng(3)
    x = rng.integers(0, [12, 5, 3, 2], (3000, 4)).astype(float)
    y = (rng.random(3000) < 0.2 + 0.05 * x[:, 0] * (x[:, 2] > 0)).astype(int)
    rows = [(*map(float, r), int(label), "train" if i % 5 else "test") for i, (r, label) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1.0, 1, "train")]
    split = spark.createDataFrame(rows, "recency double, order_total double, item_count double, freight_total double, label int, split string")
    plain_fit, learned = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: learned.append(df.count()) or plain_fit(self, df))
    model, m = I.fit_conversion_model(split, P.with_(gbt_rounds=4, gbt_depth=3))
    assert learned == [len({tuple(r) for i, r in enumerate(x.tolist()) if i % 5})]
    whole = VectorAssembler(inputCols=I.FEATURES, outputCol="features", handleInvalid="skip").transform(split)
    plain = plain_fit(GBTRegressor(labelCol="label", maxIter=4, stepSize=P.gbt_step, maxDepth=3, seed=P.seed), whole.where("split = 'train'"))
    want = [r.prediction for r in plain.transform(whole.where("split = 'test'")).orderBy(*I.FEATURES).collect()]
    got = model.transform(split.dropna().where("split = 'test'").select("*", *[F.col(c).alias(i) for c, i in zip(I.FEATURES, I.INPUTS)]))
    assert [r.prediction for r in got.orderBy(*I.FEATURES).collect()] == pytest.approx(want, abs=1e-9)
    assert m["predictions"].count() == 600
    odd = spark.createDataFrame([(None, 10.0, 2.0)], "recency int, avg_order_value double, avg_items_per_order double")
    assert 0.001 <= I.base_conversion(model, odd, P).first().base_rate <= 0.5


def test_cuts_come_from_all_rows_and_part_heavy_values(spark):
    from offerlab.operators import evaluation as I

    values = [2.0] * 4000 + [2.0 + i / 5000 for i in range(1, 2000)] + [3.0] * 3000 + [float(i) for i in range(10, 1010)]
    df = spark.createDataFrame([(v, 7.0, float(i % 3)) for i, v in enumerate(values)], "a double, b double, c double").repartition(5)
    cuts = I.cut_points(df, ["a", "b", "c"])
    assert cuts["b"] == [7.0] and cuts["c"] == [0.5, 1.5] and len(cuts["a"]) < I.BINS
    bins = np.searchsorted(cuts["a"], values, side="right")
    for v in (2.0, 3.0):  # a heavy value is alone in its bin
        assert {w for w, b in zip(values, bins) if b == bins[values.index(v)]} == {v}
    others = np.bincount(bins)
    assert sorted(others)[-3] <= len(values) / I.BINS * 2 and I.cut_points(df.where("false"), ["a"]) == {"a": []}


def test_best_splits_against_a_plain_search(spark):
    from offerlab.operators.router_model import best_splits

    rng = np.random.default_rng(8)
    sums, weights = rng.poisson(0.7, (6, 3, 32, 2)).astype(float), np.array([0.6, 2.5])
    sums[1, :, :, 1], sums[2] = 0, 0  # one class only; too few rows
    sums[2, :, 4, 0], sums[2, :, 9, 1] = 7, 8
    sums[:, 1:] = sums[:, :1, rng.permutation(32)][:, :, :]  # the same rows in each feature
    gini = lambda c: (c * weights).sum() - ((c * weights) ** 2).sum() / max((c * weights).sum(), 1e-9)
    which, bins, left, right = best_splits(sums, weights, 8)
    for i, node in enumerate(sums):
        options = {(j, b): gini(node[j].sum(0)) - gini(node[j, :b + 1].sum(0)) - gini(node[j, b + 1:].sum(0)) for j in range(3) for b in range(31)
                   if min(node[j, :b + 1].sum(), node[j, b + 1:].sum()) >= 8}
        if max(options.values(), default=0) <= 1e-9:
            assert which[i] == -1
            continue
        assert options[which[i], bins[i]] == pytest.approx(max(options.values()))
        assert (left[i] == node[which[i], :bins[i] + 1].sum(0)).all() and (left[i] + right[i] == node[0].sum(0)).all()
    assert which[1] == which[2] == -1 and (which >= 0).sum() >= 3


def test_the_forest_learns_from_counted_contexts(spark, tmp_path, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from offerlab.operators import router_model as RMD

    rng = np.random.default_rng(5)
    customers = rng.normal(size=(300, 7))  # a round has its customer's context
    own = rng.integers(0, 300, 4000)
    label = np.where(customers[own, 0] + customers[own, 3] > 0.3, 3, 1)
    label = np.where(rng.random(4000) < 0.05, 4 - label, label)
    rows = spark.createDataFrame([(i, *customers[c].tolist(), int(y)) for i, (c, y) in enumerate(zip(own, label))],
                                 "round_id long, " + ", ".join(f"{x} double" for x in RMD.X) + ", label int")
    grow, seen = RMD.grow_forest, []
    monkeypatch.setattr(RMD, "grow_forest", lambda counted, *a: seen.append(counted.toPandas()) or grow(counted, *a))
    small = P.with_(router_trees=30, router_depth=6)
    model, report = RMD.train_router(rows, small)
    assert len(seen[0]) <= 600 and seen[0]["n"].sum() == sum(n - -(-n // 5) for n in (int((label == y).sum()) for y in (1, 3)))
    assert model.trees == 30 and report["n_samples"] == 4000 and set(report["label_distribution"].values()) == {int((label == y).sum()) for y in (1, 3)}
    features = VectorAssembler(inputCols=RMD.X, outputCol="features").transform(rows)
    plain = RandomForestClassifier(labelCol="label", numTrees=30, maxDepth=6, minInstancesPerNode=8, seed=1).fit(features)
    want = plain.transform(features).where("prediction = label").count() / 4000
    model.save(spark, str(tmp_path / "forest"))
    for forest in (model, RMD.Forest.load(spark, str(tmp_path / "forest"))):
        got = RMD.policy_probs(forest, rows).toPandas()
        probs = got[[f"prob_{p}" for p in POLICY_ORDER]].to_numpy()
        assert np.allclose(probs.sum(axis=1), 1.0) and (probs[:, [0, 2, 4]] == 0).all() and list(got["round_id"]) == list(range(4000))
        assert abs((probs.argmax(axis=1) == got["label"]).mean() - want) < 0.03 and report["val_accuracy"] > 0.85
        assert len({tuple(p) for p in probs}) <= 300
    again, _ = RMD.train_router(rows, small)
    assert (again.left == model.left).all() and (again.probs == model.probs).all()


def test_long_expressions_are_run_in_small_methods(spark, monkeypatch):
    from offerlab.plans import q_text_models as Q
    from offerlab.session import small_methods

    name, held = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    plain = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: held.append((df.columns[-1], spark.conf.get(name))) or plain(df))
    Q.q_router_model(spark, "/root/testdata/sf0.001")
    assert held == [("label", "8000")] and spark.conf.get(name) == before
    with pytest.raises(ValueError), small_methods(spark):
        raise ValueError
    assert spark.conf.get(name) == before


def test_a_small_split_table_is_trained_on_by_all_cores(spark):
    from offerlab.operators.splits import exact_split

    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label")).coalesce(1)
    split = exact_split(rows, "label", F.col("k").cast("string"), 0.8)
    assert split.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000 / 2
    assert split.where("split = 'train'").count() == sum(n - -(-n // 5) for n in (334, 333, 333))


def test_parts_of_the_replayed_log_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    import os

    from offerlab.plans import catalog, q_offers as Q  # noqa: F401
    from tests.conftest import SF_MID

    class Stopped(Exception):
        pass

    def run(self, spark, source, schema, max_files=1):
        raise Stopped(source, max_files)

    monkeypatch.setattr(Q.DecisionStream, "run", run)
    rounds, log = Q.requested_rounds(spark, SF_MID)
    monkeypatch.setattr(Q, "requested_rounds", lambda *_: (rounds.repartition(3), log.repartition(3)))
    kept = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(kept, "false")  # the table is small
    try:
        with pytest.raises(Stopped) as stopped:
            Q.streamed(spark, SF_MID, str(tmp_path))
    finally:
        spark.conf.set(kept, "true")
    source, max_files = stopped.value.args
    files = [f for f in os.listdir(source) if f.endswith(".parquet")]
    assert max_files > 1 and len(files) == Q.STREAM_FILES * max_files
    assert spark.read.parquet(source).count() == rounds.count()


def test_the_fold_computes_its_log_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    schema = "router_key string, event_time timestamp, event_id long, policy string, metric_value double, baseline double"
    rows = [(f"k{i % 2}", datetime(2024, 1, 1, 0, i % 60), i, "uplift", 0.4, 0.3) for i in range(120)]
    assert FF.fold_feedback(spark.createDataFrame(rows, schema).mapInPandas(counted, schema)).count() == 120
    assert read.value == 120


def test_chunk_bounds():
    assert H.chunk_bounds([], 10, 3) == []
    assert H.chunk_bounds([50], 10, 3) == [0, 1]
    assert H.chunk_bounds([4, 4, 4, 50, 2, 2], 10, 4) == [0, 2, 1, 3, 2, 4, 4, 6]


# --- requests against the stored decisions, CSV with a quarantine

def test_requests_join_without_moving_the_log(spark):
    from offerlab.operators.requests import DecisionTable, report_of, resolve_context

    rounds = spark.createDataFrame([(100 + 7 * i, i % 3) for i in range(40)], "round_id long, action int")
    table = DecisionTable(rounds, 8)
    asked = spark.createDataFrame([(i, a) for i, a in enumerate([0, 39, 40, -1, None, 5])], "request_id long, asked long")
    out = table.select(asked)
    got = {r.request_id: r.round_idx for r in out.collect()}
    assert (got[0], got[1], got[5]) == (0, 39, 5) and all(0 <= v < 40 for v in got.values()) and got == {r.request_id: r.round_idx for r in out.collect()}
    assert {r.request_id: r.round_id for r in out.collect()} == {k: 100 + 7 * v for k, v in got.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.select(asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the requests move
    assert [r.round_id for r in table.wrapped(asked.where("request_id in (2, 3)")).orderBy("request_id").collect()] == [100, 100 + 7 * 39]
    own = [f"{i}.0D x{i}" for i in range(7)]
    given = [["1"] * 7, ["1"] * 6, ["1"] * 6 + ["a"], ["NaN"] * 7, None, []]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g array<string>").selectExpr("*", *own)
    assert [(r.own_context, r.x3) for r in resolve_context(df, "g").orderBy("i").collect()] == [(True, 1.0)] + [(False, 3.0)] * 5
    report = spark.createDataFrame([(p, float(i)) for i, p in enumerate(POLICY_ORDER)], "policy string, dr double")
    names = spark.createDataFrame([("RL",), (None,), ("auto",)], "name string")
    assert {r.name: r.policy for r in report_of(names, report).collect()} == {"RL": "rl_policy", None: "rule_engine", "auto": "contextual_bandit"}


def test_csv_bad_rows_go_to_quarantine(spark, tmp_path):
    from offerlab.sources.tables import load_csv_tables

    def put(name, text):
        (tmp_path / name).write_bytes(text.replace("\n", "\r\n").encode("utf-8-sig"))

    put("olist_orders_dataset.csv", "order_id,customer_id,order_status,a,b,c,d,e\no1,c1,delivered,2020-01-01 10:00:00,,,,\no2,c1,delivered,not a time,,,,\no3,c2,canceled,2020-01-02 10:00:00,,,,\no4,c2,delivered,2020-01-03 10:00:00,,,,,too,many\n")
    put("olist_order_items_dataset.csv", 'order_id,order_item_id,product_id,seller_id,limit,price,freight\no1,1,p1,s,,10.50,1.25\no1,2,p2,s,,abc,1\no1,3,"p,3",s,,2,0.5\n')
    put("olist_customers_dataset.csv", "customer_id,customer_unique_id,zip,city,state\nc1,u1,,,\nc2,u2,,,\n")
    put("olist_products_dataset.csv", "product_id,product_category_name,a,b,c,d,e,f,g\np1,x,,,,,,,\np2,unknown,,,,,,,\n")
    put("product_category_name_translation.csv", "product_category_name,product_category_name_english\nx,toys\n")
    t = load_csv_tables(spark, str(tmp_path), quarantine=str(tmp_path / "bad"))
    row, = t.completed.collect()
    assert (row.order_id, row.customer_unique_id, float(row.order_total), float(row.freight_total), row.item_count) == ("o1", "u1", 12.5, 1.75, 2)
    assert {r.product_id: r.category for r in t.products.collect()} == {"p1": "toys", "p2": None}
    bad = {(r.table, r.line.split(",")[0], r.file) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad == {("olist_orders_dataset", "o2", "olist_orders_dataset.csv"), ("olist_orders_dataset", "o4", "olist_orders_dataset.csv"),
                   ("olist_order_items_dataset", "o1", "olist_order_items_dataset.csv")}
    with pytest.raises(Exception):
        load_csv_tables(spark, str(tmp_path), strict=True).completed.collect()


def test_template_channels_come_before_the_offers(spark):
    """A template that names channels uses them, and their costs; others use the offer's."""
    catalog = [(0, "x", ["a", "b"], {"a": 1.0, "b": 2.0, "c": 4.0}, [], (7, 1, 1), 5.0, [("A", "A", "t", 3.0, ["c"])]),
               (1, "y", ["a", "b"], {"a": 1.0, "b": 2.0}, [], (7, 1, 1), 5.0, [("A", "A", "t", 3.0)]), (2, "z", ["a"], {"a": 1.0}, [], (7, 1, 1), 5.0, [("A", "A", "t", 3.0, [])])]
    asked = spark.createDataFrame([(i, i, "c", "t", "s") for i in range(3)], "action_id int, round_id long, customer_unique_id string, routed_tool string, user_segment string")
    got = {r.action_id: (r.channels, r.channel_cost, r.total_cost) for r in G.resolve_offers(asked, G.catalog_df(spark, catalog)).collect()}
    assert got == {0: (["c"], 4.0, 7.0), 1: (["a", "b"], 3.0, 6.0), 2: ([], 0.0, 3.0)}
