"""Policy router as column expressions over all rounds at once.

Scores over the five policies (or k actions) are vectors of SQL expression
strings; see ``offerlab.functions.vectors``. Nothing here loops over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerlab.config import (DEFAULT_PARAMS, POLICY_ORDER, ROUTER_ALIASES, RULE_SEGMENT_ACTION,
                             SUITE_ALIASES, Params)
from offerlab.functions import vectors as V
from offerlab.functions.vectors import lit

EPS = V.EPS
USTRIP = "regexp_replace({}, '(?U)^\\\\s+|\\\\s+$', '')"


def _alias_lookup(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(table.items()))
    return f"(CASE {key} {whens} ELSE '{default}' END)"


def _key(name: str) -> str:
    return "lower(" + USTRIP.format(f"coalesce(CAST({name} AS STRING), '')") + ")"


def normalize_policy_name(name: str) -> str:
    """Suite aliases; anything else (NULL included) -> contextual_bandit."""
    return _alias_lookup(_key(name), SUITE_ALIASES, "contextual_bandit")


def normalize_router_policy(name: str) -> str:
    """Router aliases, ``auto`` kept; suite names normalised as in E1;
    anything else -> rule_engine."""
    return _alias_lookup(_key(name), {**SUITE_ALIASES, **ROUTER_ALIASES}, "rule_engine")


def safe_float(v: str, default: float) -> str:
    """Numeric value or the default when missing / not a number."""
    return f"coalesce(try_cast(CAST({v} AS STRING) AS DOUBLE), {lit(default)})"


def complexity(ctx: list[str]) -> str:
    """T5: mean absolute context value."""
    return V.vmean([f"abs({x})" for x in ctx])


def churn_risk(recency: str, ctx0: str | None, params: Params = DEFAULT_PARAMS) -> str:
    """From recency when positive, else from the first context value,
    else 0.2. A missing recency counts as 30 days."""
    r = safe_float(recency, 30.0)
    by_recency = V.clip(f"(({r} - {lit(30.0)}) / {lit(max(1.0, params.churn_recency))})", 0.0, 1.0)
    by_ctx = V.clip(f"(({ctx0} + {lit(1.5)}) / {lit(3.0)})", 0.0, 1.0) if ctx0 is not None else lit(0.2)
    return f"(CASE WHEN {r} > 0 THEN {by_recency} ELSE {by_ctx} END)"


def rule_action(segment: str | None, ctx0: str | None, k: int) -> str:
    """Segment -> action (mod k); without a known segment, thresholds on
    the first context value."""
    by_ctx = "0"
    if ctx0 is not None:
        by_ctx = (f"(CASE WHEN {ctx0} > {lit(0.8)} THEN {min(k - 1, 4)} "
                  f"WHEN {ctx0} > {lit(0.2)} THEN {min(k - 1, 3)} "
                  f"WHEN {ctx0} < {lit(-0.8)} THEN {min(k - 1, 1)} ELSE 0 END)")
    if segment is None:
        return by_ctx
    whens = " ".join(f"WHEN '{s}' THEN {a % k}" for s, a in RULE_SEGMENT_ACTION.items())
    return f"(CASE {segment} {whens} ELSE {by_ctx} END)"


def one_hot(idx: str, k: int) -> list[str]:
    return [f"(CASE WHEN {idx} = {a} THEN {lit(1.0)} ELSE {lit(0.0)} END)" for a in range(k)]


def rl_scores(contextual: list[str], uplift: list[str], ctx0: str | None, churn: str) -> list[str]:
    """(1 - churn) * short-term + churn * long-term preference."""
    k = len(contextual)
    short = [f"(({lit(0.6)} * {c}) + ({lit(0.4)} * {u}))"
             for c, u in zip(V.minmax(contextual), V.minmax(uplift))]
    pref = [0.0] * k if k == 1 else [a / (k - 1) for a in range(k)]
    if ctx0 is not None:
        factor = V.clip(f"(({ctx0} + {lit(1.0)}) / {lit(2.0)})", 0.0, 1.0)
        bonus = [f"({factor} * {lit(p)})" for p in pref]
    else:
        bonus = [lit(0.0)] * k
    long = [f"({lit(0.7 * p)} + ({lit(0.3)} * {b}))" for p, b in zip(pref, bonus)]
    return [f"(((1.0D - {churn}) * {s}) + ({churn} * {lt}))" for s, lt in zip(short, long)]


def heuristic_router_scores(has_context: str, cplx: str, pscore: str, churn: str,
                            params: Params = DEFAULT_PARAMS) -> list[str]:
    """Router scores in POLICY_ORDER from low-pscore, complexity and
    churn signals."""
    low = V.clip(f"(({lit(params.low_pscore)} - {pscore}) / {lit(max(params.low_pscore, EPS))})", 0.0, 1.0)
    cs = V.clip(f"({cplx} / {lit(max(params.high_complexity, EPS))})", 0.0, 1.5)
    friendly = V.clip(f"(1.0D - {cs})", 0.0, 1.0)
    scores = {
        "contextual_bandit": f"((({lit(0.6)} * {cs}) + ({lit(0.2)} * (1.0D - {churn}))) + ({lit(0.2)} * greatest({pscore}, 0.0D)))",
        "uplift": f"((({lit(0.55)} * {friendly}) + ({lit(0.25)} * (1.0D - {low}))) + ({lit(0.2)} * (1.0D - {churn})))",
        "fusion": f"((({lit(0.6)} * {low}) + ({lit(0.25)} * {cs})) + ({lit(0.15)} * {churn}))",
        "rl_policy": f"((({lit(0.7)} * {churn}) + ({lit(0.2)} * {cs})) + ({lit(0.1)} * {low}))",
        "rule_engine": f"(CASE WHEN {has_context} THEN {lit(0.2)} ELSE {lit(0.9)} END)",
    }
    return [scores[p] for p in POLICY_ORDER]


def apply_bias(scores: list[str], bias: list, temperature: float) -> list[str]:
    """T10 + T11: distribution, then softmax((log max(p, 1e-8) + bias) / T),
    T floored at 0.1."""
    t = max(0.1, float(temperature))
    probs = V.to_distribution(scores)
    b = [x if isinstance(x, str) else lit(x) for x in bias]
    logits = [f"((ln(greatest({p}, {lit(EPS)})) + {bb}) / {lit(t)})" for p, bb in zip(probs, b)]
    return V.softmax(logits)


def policy_index(name: str) -> str:
    whens = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(POLICY_ORDER))
    return f"(CASE {name} {whens} END)"


def policy_name(idx: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(POLICY_ORDER))
    return f"(CASE {idx} {whens} END)"


def with_decision(df, mode: str, has_context: str, cplx: str, pscore: str, churn: str,
                  bias: list, params: Params = DEFAULT_PARAMS, learned_probs: list[str] | None = None,
                  keep_tmp: bool = False):
    """One routing decision per row, as staged projections (raw scores,
    distribution, biased softmax, then the decision), so each stage refers
    to the previous columns by name and expressions stay small.

    Manual mode -> that policy (confidence 1). Auto without context (and the
    flag set) -> rule_engine. Otherwise learned or heuristic scores, bias,
    arg-max; very low pscore forces rule_engine; else a learned router below
    the confidence floor falls back to rule_engine (confidence kept).
    Adds: mode, policy, confidence, reasons (array), cand0..cand4.
    """
    n = len(POLICY_ORDER)
    learned = learned_probs is not None
    raw = learned_probs if learned else heuristic_router_scores(has_context, cplx, pscore, churn, params)
    df = V.with_vec(df, "_raw", raw)
    df = V.with_vec(df, "_dst", V.to_distribution(V.cols("_raw", n)))
    t = max(0.1, float(params.temperature))
    b = [x if isinstance(x, str) else lit(x) for x in bias]
    df = V.with_vec(df, "_lg", [f"((ln(greatest(_dst{i}, {lit(EPS)})) + {b[i]}) / {lit(t)})" for i in range(n)])
    lg = V.cols("_lg", n)
    df = df.withColumn("_mx", F.expr(V.vmax(lg)))
    df = V.with_vec(df, "_ex", [f"exp({x} - _mx)" for x in lg])
    ex = V.cols("_ex", n)
    df = df.withColumn("_den", F.expr(f"greatest({V.vsum(ex)}, {lit(EPS)})"))
    df = V.with_vec(df, "_cand", [f"({e} / _den)" for e in ex])
    cand = V.cols("_cand", n)
    df = df.withColumn("mode", F.expr(normalize_router_policy(mode)))
    df = df.withColumns({"_conf": F.expr(V.vmax(cand)), "_best": F.expr(policy_name(V.argmax(cand)))})
    force_rule = f"({pscore} < {lit(params.force_rule_pscore)})"
    low_conf = f"(_conf < {lit(params.min_confidence)})" if learned else "false"
    missing = f"((NOT {has_context}) AND {str(bool(params.force_rule_on_missing_context)).lower()})"
    manual = "(mode <> 'auto')"
    auto = f"(NOT {manual} AND NOT {missing})"
    auto_tag = "auto_learned_router" if learned else "auto_heuristic_router"
    reasons = (
        "filter(array("
        f"CASE WHEN {manual} THEN 'manual_override' END, "
        f"CASE WHEN NOT {manual} AND {missing} THEN 'missing_context_force_rule_engine' END, "
        f"CASE WHEN {auto} THEN '{auto_tag}' END, "
        f"CASE WHEN {auto} AND {force_rule} THEN 'force_rule_by_very_low_pscore' END, "
        f"CASE WHEN {auto} AND NOT {force_rule} AND {low_conf} THEN 'low_router_confidence_fallback_rule' END, "
        f"CASE WHEN {pscore} < {lit(params.low_pscore)} THEN 'low_pscore' END, "
        f"CASE WHEN {cplx} >= {lit(params.high_complexity)} THEN 'high_complexity' END, "
        f"CASE WHEN {churn} >= {lit(0.7)} THEN 'high_churn_risk' END"
        "), x -> x IS NOT NULL)"
    )
    df = df.withColumns({
        "policy": F.expr(f"(CASE WHEN {manual} THEN mode WHEN {missing} THEN 'rule_engine' "
                         f"WHEN {force_rule} THEN 'rule_engine' WHEN {low_conf} THEN 'rule_engine' ELSE _best END)"),
        "confidence": F.expr(V.clip(f"(CASE WHEN {manual} OR {missing} THEN 1.0D ELSE _conf END)", 0.0, 1.0)),
        "reasons": F.expr(reasons),
        **{f"cand{i}": F.expr(
            f"(CASE WHEN {manual} THEN (CASE WHEN mode = '{p}' THEN 1.0D ELSE 0.0D END) "
            f"WHEN {missing} THEN {'1.0D' if p == 'rule_engine' else '0.0D'} ELSE _cand{i} END)")
           for i, p in enumerate(POLICY_ORDER)},
    })
    if keep_tmp:
        return df
    return df.drop(*[c for c in df.columns if c.startswith(("_raw", "_dst", "_lg", "_ex", "_cand"))
                     or c in ("_mx", "_den", "_conf", "_best")])
