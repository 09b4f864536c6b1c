"""Policy scores over all rounds, off-policy
evaluation in one aggregate pass, router training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlab.config import DEFAULT_PARAMS, POLICY_ORDER, Params
from offerlab.functions import vectors as V
from offerlab.operators import router as T
from offerlab.operators.feedback import DIM, xs
from offerlab.operators.reward_model import RewardModel

SUITE = ["contextual_bandit", "uplift", "fusion"]


def uplift_scores(q: list[str], baseline: int) -> list[str]:
    """Q - q[baseline]; the baseline entry is exactly 0."""
    return ["0.0D" if a == baseline else f"({qa} - {q[baseline]})" for a, qa in enumerate(q)]


def fusion_scores(ctx_scores: list[str], upl: list[str], q: list[str],
                  params: Params = DEFAULT_PARAMS) -> list[str]:
    """E9 + E10: w_b * rowstd(contextual) + w_u * rowstd(uplift) + 0.1 * q."""
    cs, us = V.row_standardize(ctx_scores), V.row_standardize(upl)
    return [f"((({V.lit(params.bandit_weight)} * {c}) + ({V.lit(params.uplift_weight)} * {u})) + ({V.lit(0.1)} * {m}))"
            for c, u, m in zip(cs, us, q)]


def _set(df: DataFrame, prefix: str, v: list[str]) -> DataFrame:
    return V.with_vec(df, prefix, v)


def score_rounds(rounds: DataFrame, model: RewardModel, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per round q-hat (q*), contextual (c*), uplift (u*),
    fusion (f*) and offline rl (r*) scores, plus each policy's greedy action
    (act_<policy>). Offline rl/rule see a profile that holds only the
    context, so churn risk is 0 and the rule uses the first context value."""
    k = model.n_actions
    x = xs(d=model.dim)
    base = model.baseline_action()
    df = _set(rounds, "q", model.q_hat(x))
    df = _set(df, "c", model.ucb(params.alpha, x))
    df = _set(df, "u", uplift_scores(V.cols("q", k), base))
    df = _set(df, "f", fusion_scores(V.cols("c", k), V.cols("u", k), V.cols("q", k), params))
    churn0 = T.churn_risk("NULL", x[0], params)
    df = _set(df, "r", T.rl_scores(V.cols("c", k), V.cols("u", k), x[0], churn0))
    return df.withColumns({
        "act_contextual_bandit": F.expr(V.argmax(V.cols("c", k))),
        "act_uplift": F.expr(V.argmax(V.cols("u", k))),
        "act_fusion": F.expr(V.argmax(V.cols("f", k))),
        "act_rl_policy": F.expr(V.argmax(V.cols("r", k))),
        "act_rule_engine": F.expr(T.rule_action(None, x[0], k)),
    })


def ope_report(scored: DataFrame, k: int, policies=POLICY_ORDER) -> DataFrame:
    """E12-E16 + T18 for several policies in ONE aggregate pass (no row
    explosion): per policy sum(w r), sum(w), sum(q_pi + w (r - q_a)),
    overlap; the single result row is unpivoted to one row per policy."""
    q = V.cols("q", k)
    p = f"greatest(pscore, {V.lit(1e-6)})"
    q_logged = V.pick(q, "action")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("reward").alias("r_sum")]
    for pol in policies:
        t = f"act_{pol}"
        ind = f"(CASE WHEN action = {t} THEN 1.0D ELSE 0.0D END)"
        w = f"({ind} / {p})"
        aggs += [
            F.expr(f"sum({ind})").alias(f"{pol}__ov"),
            F.expr(f"sum({w} * reward)").alias(f"{pol}__wr"),
            F.expr(f"sum({w})").alias(f"{pol}__w"),
            F.expr(f"sum({V.pick(q, t)} + ({w} * (reward - {q_logged})))").alias(f"{pol}__dr"),
        ]
    row = scored.agg(*aggs)
    stack = ", ".join(f"'{pol}', `{pol}__ov`, `{pol}__wr`, `{pol}__w`, `{pol}__dr`" for pol in policies)
    long = row.selectExpr("n", "r_sum", f"stack({len(policies)}, {stack}) AS (policy, ov, wr, w, dr)")
    n = F.col("n")
    return long.select(
        "policy",
        (F.col("r_sum") / n).alias("behavior_mean"),
        (F.col("ov") / n).alias("overlap"),
        (F.col("wr") / n).alias("ips"),
        F.when(F.col("w") > 0, F.col("wr") / F.col("w")).otherwise(F.lit(0.0)).alias("snips"),
        (F.col("dr") / n).alias("dr"),
        F.col("w").alias("weight_sum"),
    )


def router_labels(scored: DataFrame, k: int, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per round, the policy (index in POLICY_ORDER) whose action has
    the best predicted reward after small policy-specific bonuses."""
    q = V.cols("q", k)
    x = xs()
    cs = V.clip(f"({T.complexity(x)} / {V.lit(max(params.high_complexity, V.EPS))})", 0.0, 1.5)
    low = V.clip(f"(({V.lit(params.low_pscore)} - pscore) / {V.lit(max(params.low_pscore, V.EPS))})", 0.0, 1.0)
    churn_proxy = V.clip(f"(({x[0]} + {V.lit(1.5)}) / {V.lit(3.0)})", 0.0, 1.0)
    bonus = {"fusion": f"({V.lit(0.03)} * {low})", "contextual_bandit": f"({V.lit(0.02)} * {cs})",
             "rl_policy": f"({V.lit(0.03)} * {churn_proxy})", "rule_engine": V.lit(-0.01), "uplift": V.lit(0.0)}
    util = [f"({V.pick(q, f'act_{p}')} + {bonus[p]})" for p in POLICY_ORDER]
    return V.with_vec(scored, "util", util).withColumn(
        "label", F.expr(V.argmax(V.cols("util", len(POLICY_ORDER)))))
