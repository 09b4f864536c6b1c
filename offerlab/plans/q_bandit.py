"""Queries for groups D, E and the offline part of T: logged rounds,
propensities, reward model, policy scores, off-policy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlab.config import DEFAULT_PARAMS as P, POLICY_ORDER
from offerlab.functions import vectors as V
from offerlab.functions.hashing import pipe_key
from offerlab.operators import feedback as D
from offerlab.operators import ope as E
from offerlab.operators import reward_model as RM
from offerlab.operators import rfm as B
from offerlab.operators import router as T
from offerlab.plans import oracle_bandit as OB
from offerlab.plans.catalog import present, query
from offerlab.plans.oracle import with_ctes
from offerlab.sources.tables import load_tables, read_table

K = P.n_actions
XC = [f"x{i}" for i in range(D.DIM)]


def rounds_table(spark, sf_dir, params=P, features=None):
    """``features``: the segmented customer features, where the caller has them."""
    if features is None:
        features = B.rule_segments(B.rfm_features(load_tables(spark, sf_dir, params).completed), params)
    return D.logged_rounds(spark, sf_dir, features, params)


def suite(spark, sf_dir, params=P, means_only=False, features=None, fitted=None):
    """``fitted``: called with a function that fits the reward model; returns the one to use (a model store)."""
    rounds = rounds_table(spark, sf_dir, params, features)

    def fit():
        return RM.fit_reward_model(rounds, params, means_only=means_only)

    model = fitted(fit) if fitted else fit()
    return rounds, model, E.score_rounds(rounds, model, params)


# D1-D6 ----------------------------------------------------------------------
@query("context_features", with_ctes(["ctx_c"], f"""
SELECT round_id, customer_unique_id, user_segment, action::BIGINT AS action, reward,
       {", ".join(f"round(x{i}, 6) AS x{i}" for i in range(D.DIM))}
FROM ctx_c"""))
def q_context_features(spark, sf_dir):
    r = rounds_table(spark, sf_dir)
    return present(r.select("round_id", "customer_unique_id", "user_segment", "action", "reward", *XC))


# D8 (empirical), D10 ---------------------------------------------------------
@query("empirical_propensity", with_ctes(["rounds_c"], f"""
SELECT round_id, action::BIGINT AS action, round(pscore, 6) AS pscore,
       {", ".join(f"round(bp{a}, 6) AS bp{a}" for a in range(K))}
FROM rounds_c"""))
def q_empirical_propensity(spark, sf_dir):
    r = rounds_table(spark, sf_dir)
    return present(r.select("round_id", "action", "pscore", *[f"bp{a}" for a in range(K)]))


# Linear behaviour propensities ----------------------------------
# weights of the log itself (a table of k rows) as columns w<feature>_<action>, b<action>
_WCOLS = ", ".join([f"coalesce(max(x{j}) FILTER (WHERE action = {a}), 0.0) AS w{j}_{a}" for j in range(D.DIM) for a in range(K)]
                   + [f"coalesce(max(b) FILTER (WHERE action = {a}), -20.0) AS b_{a}" for a in range(K)])
_WEIGHTS = f"""
, wa AS (SELECT action, {", ".join(f"avg(x{j}) AS x{j}" for j in range(D.DIM))},
                ln(count(*) / CAST((SELECT count(*) FROM ctx_c WHERE action IS NOT NULL) AS DOUBLE)) AS b
         FROM ctx_c WHERE action IS NOT NULL GROUP BY action),
wt AS (SELECT {_WCOLS} FROM wa),
lg AS (SELECT c.*, {", ".join(f"({OB.vsum([f'x{j} * w{j}_{a}' for j in range(D.DIM)])} + b_{a}) AS lg{a}" for a in range(K))} FROM ctx_c c, wt)"""
_probs = OB.floor_prop(OB.softmax([f"lg{a}" for a in range(K)]))


@query("propensity_softmax", with_ctes(["ctx_c"], f"""{_WEIGHTS}
SELECT round_id, {", ".join(f"round(p{a}, 6) AS p{a}" for a in range(K))},
       round(greatest({OB.pick([f"p{a}" for a in range(K)], "action")}, {OB.lit(1e-6)}), 6) AS pscore_model
FROM (SELECT round_id, action, {", ".join(f"{p} AS p{a}" for a, p in enumerate(_probs))} FROM lg)""", extra=True))
def q_propensity_softmax(spark, sf_dir):
    r = rounds_table(spark, sf_dir)
    df = D.with_linear_propensity(r, *D.logged_weights(r), P.min_pscore)
    df = df.withColumn("pscore_model", F.expr(D.logged_pscore(V.cols("p", K))))
    return present(df.select("round_id", *[f"p{a}" for a in range(K)], "pscore_model"))


# Repeatable assignment from the behaviour propensities --------------------
def _assign_sql():
    u = f"({OB.lit(0)} + CAST(('0x' || substr(md5(concat_ws('|', '{P.seed}', CAST(round_id AS VARCHAR))), 1, 8)) AS BIGINT) / {OB.lit(4294967296.0)})"
    cum, acc = [], None
    for a in range(K):
        acc = f"p{a}" if acc is None else f"({acc} + p{a})"
        cum.append(acc)
    case = " ".join(f"WHEN {cum[i]} > u THEN {i}" for i in range(K - 1))
    return with_ctes(["ctx_c"], f"""{_WEIGHTS}
SELECT round_id, (CASE {case} ELSE {K - 1} END)::BIGINT AS assigned_action, round(u, 6) AS u
FROM (SELECT round_id, {", ".join(f"{p} AS p{a}" for a, p in enumerate(_probs))}, {u} AS u FROM lg)""", extra=True)


@query("hash_assignment", _assign_sql())
def q_hash_assignment(spark, sf_dir):
    rounds = rounds_table(spark, sf_dir)
    r = D.with_linear_propensity(rounds, *D.logged_weights(rounds), P.min_pscore)
    act, u = D.hash_assignment(V.cols("p", K), pipe_key(F.lit(str(P.seed)), F.col("round_id")))
    return present(r.select("round_id", act.alias("assigned_action"), u.alias("u")))


# E2, E6 ---------------------------------------------------------------------
@query("action_rewards", with_ctes(["rounds_c"], """
SELECT action::BIGINT AS action, count(*) AS n, round(sum(reward) / count(*), 6) AS mean_reward
FROM rounds_c GROUP BY action"""))
def q_action_rewards(spark, sf_dir):
    r = rounds_table(spark, sf_dir)
    return present(r.groupBy("action").agg(F.count(F.lit(1)).alias("n"),
                                           (F.sum("reward") / F.count(F.lit(1))).alias("mean_reward")))


@query("baseline_action", with_ctes(["rounds_c"], """
SELECT action::BIGINT AS baseline_action, n FROM
  (SELECT action, count(*) AS n FROM rounds_c GROUP BY action ORDER BY n DESC, action LIMIT 1)"""))
def q_baseline_action(spark, sf_dir):
    r = rounds_table(spark, sf_dir)
    top = r.groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "action").limit(1)
    return present(top.select(F.col("action").alias("baseline_action"), "n"))


# Normal-equation sums per action (long form) --------------------------
def _moments_sql():
    w = f"least(greatest({OB.lit(1.0)} / greatest(pscore, {OB.lit(1e-6)}), {OB.lit(1.0)}), {OB.lit(50.0)})"
    parts = []
    for i in range(D.DIM):
        for j in range(D.DIM):
            reg = f" + {OB.lit(P.ridge_reg)}" if i == j else ""
            lo, hi = min(i, j), max(i, j)
            parts.append(f"SELECT action, 'A' AS part, {i} AS i, {j} AS j, "
                         f"sum({w} * x{lo} * x{hi}){reg} AS value FROM rounds_c GROUP BY action")
        parts.append(f"SELECT action, 'b' AS part, {i} AS i, -1 AS j, sum({w} * x{i} * reward) AS value "
                     f"FROM rounds_c GROUP BY action")
    body = "\nUNION ALL ".join(parts)
    return with_ctes(["rounds_c"], f"""
SELECT action::BIGINT AS action, part, i::BIGINT AS i, j::BIGINT AS j, round(value, 6) AS value
FROM ({body})""")


@query("ridge_moments", _moments_sql())
def q_ridge_moments(spark, sf_dir):
    r = rounds_table(spark, sf_dir)
    m = RM.action_moments(r)
    d = D.DIM
    entries = []
    for i in range(d):
        for j in range(d):
            lo, hi = min(i, j), max(i, j)
            v = F.col(f"a_{lo}_{hi}") + (F.lit(P.ridge_reg) if i == j else F.lit(0.0))
            entries.append(F.struct(F.lit("A").alias("part"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                                    v.alias("value")))
        entries.append(F.struct(F.lit("b").alias("part"), F.lit(i).alias("i"), F.lit(-1).alias("j"),
                                F.col(f"b_{i}").alias("value")))
    long = m.select("action", F.explode(F.array(*entries)).alias("e")).select(
        "action", "e.part", "e.i", "e.j", "e.value")
    return present(long)


# E5, E7 with the fitted ridge model (model output: rows only) ----------------
@query("reward_model_scores")
def q_reward_model_scores(spark, sf_dir):
    r, model, scored = suite(spark, sf_dir)
    return present(scored.select("round_id", *[f"q{a}" for a in range(K)], *[f"c{a}" for a in range(K)],
                                 "act_contextual_bandit"))


# E8-E11, T12 with the means model -------------------------------------------
_ACTS = [f"act_{p}" for p in POLICY_ORDER]


@query("policy_actions", with_ctes(["acts_c"], f"""
SELECT round_id, {", ".join(f"{a}::BIGINT AS {a}" for a in _ACTS)},
       round(greatest({", ".join(f"f{a}" for a in range(K))}), 6) AS fusion_max,
       round(greatest({", ".join(f"r{a}" for a in range(K))}), 6) AS rl_max,
       round(greatest({", ".join(f"u{a}" for a in range(K))}), 6) AS uplift_max
FROM acts_c"""))
def q_policy_actions(spark, sf_dir):
    _, _, s = suite(spark, sf_dir, means_only=True)
    return present(s.select("round_id", *_ACTS,
                            F.expr(V.vmax(V.cols("f", K))).alias("fusion_max"),
                            F.expr(V.vmax(V.cols("r", K))).alias("rl_max"),
                            F.expr(V.vmax(V.cols("u", K))).alias("uplift_max")))


# E12-E16, T18 ---------------------------------------------------------------
_OPE_COLS = ["behavior_mean", "overlap", "ips", "snips", "dr", "weight_sum"]


@query("ope_by_policy", with_ctes(["acts_c"], f"""
SELECT policy, {", ".join(f"round({c}, 6) AS {c}" for c in _OPE_COLS)}
FROM ({OB.ope_sql(POLICY_ORDER)})"""))
def q_ope_by_policy(spark, sf_dir):
    _, model, s = suite(spark, sf_dir, means_only=True)
    return present(E.ope_report(s, K))


@query("ope_ridge")
def q_ope_ridge(spark, sf_dir):
    """The full suite (ridge reward model): model output, rows only."""
    _, model, s = suite(spark, sf_dir)
    return present(E.ope_report(s, K))


# Decision lookup for requests derived from the event log -------
_ALIAS_BY_EVENT = {"click": "bandit", "error": " Hybrid ", "purchase": "uplift",
                   "signup": "unknown_policy", "view": "FUSION"}


def _decision_sql():
    alias = "CASE " + " ".join(f"WHEN event_type = '{e}' THEN '{a}'" for e, a in _ALIAS_BY_EVENT.items()) + " END"
    norm = ("CASE lower(trim(raw_policy)) WHEN 'bandit' THEN 'contextual_bandit' WHEN 'contextual' THEN "
            "'contextual_bandit' WHEN 'contextual_bandit' THEN 'contextual_bandit' WHEN 'uplift' THEN 'uplift' "
            "WHEN 'fusion' THEN 'fusion' WHEN 'hybrid' THEN 'fusion' WHEN 'uplift_bandit' THEN 'fusion' "
            "ELSE 'contextual_bandit' END")
    return with_ctes(["acts_c"], f"""
, req AS (SELECT event_id AS request_id, event_id * 31 + user_id AS request_round, {alias} AS raw_policy FROM events),
nr AS (SELECT count(*) AS n FROM acts_c),
dense AS (SELECT *, row_number() OVER (ORDER BY round_id) - 1 AS round_idx FROM acts_c)
SELECT q.request_id, q.request_round, p.policy, d.round_id,
       (CASE p.policy WHEN 'uplift' THEN d.act_uplift WHEN 'fusion' THEN d.act_fusion
             ELSE d.act_contextual_bandit END)::BIGINT AS selected_action
FROM req q CROSS JOIN nr
JOIN (SELECT request_id, {norm} AS policy FROM req) p USING (request_id)
JOIN dense d ON d.round_idx = q.request_round % nr.n""", extra=True)


@query("decision_lookup", _decision_sql())
def q_decision_lookup(spark, sf_dir):
    _, _, s = suite(spark, sf_dir, means_only=True)
    ev = read_table(spark, sf_dir, "events")
    alias = F.lit(None).cast("string")
    for e, a in _ALIAS_BY_EVENT.items():
        alias = F.when(F.col("event_type") == e, F.lit(a)).otherwise(alias)
    req = ev.select(F.col("event_id").alias("request_id"),
                    (F.col("event_id") * 31 + F.col("user_id")).alias("request_round"),
                    alias.alias("raw_policy")).withColumn(
        "policy", F.expr(T.normalize_policy_name("raw_policy"))).drop("raw_policy")
    dense = D.with_dense_index(s)
    n = s.select(F.count(F.lit(1))).scalar()
    out = D.round_lookup(req, dense, n)
    chosen = F.when(F.col("policy") == "uplift", F.col("act_uplift")) \
        .when(F.col("policy") == "fusion", F.col("act_fusion")).otherwise(F.col("act_contextual_bandit"))
    return present(out.select("request_id", "request_round", "policy", "round_id",
                              chosen.alias("selected_action")))
