"""DuckDB oracle CTEs for the logged rounds, propensities and the
means-model policy suite (groups D, E, T)."""

from __future__ import annotations

from offerlab.config import DEFAULT_PARAMS as P
from offerlab.plans.oracle import cte

K = P.n_actions
D = 7
NUMS = ["recency", "frequency", "monetary", "avg_order_value", "avg_items_per_order", "customer_lifetime"]


def lit(v: float) -> str:
    """A double literal that parses back to the same binary value."""
    return f"CAST({repr(float(v))} AS DOUBLE)"


def vsum(terms):
    return "(" + " + ".join(terms) + ")"


def greatest(terms):
    return "greatest(" + ", ".join(terms) + ")"


def least(terms):
    return "least(" + ", ".join(terms) + ")"


def argmax(cols):
    m = greatest(cols)
    parts = " ".join(f"WHEN {c} >= {m} THEN {i}" for i, c in enumerate(cols[:-1]))
    return f"(CASE {parts} ELSE {len(cols) - 1} END)"


def pick(cols, idx):
    parts = " ".join(f"WHEN {idx} = {i} THEN {c}" for i, c in enumerate(cols))
    return f"(CASE {parts} END)"


def clip(e, lo=None, hi=None):
    if lo is not None:
        e = f"greatest({e}, {lit(lo)})"
    if hi is not None:
        e = f"least({e}, {lit(hi)})"
    return e


def floor_prop(cols, m=P.min_pscore):
    q = [f"({c} * {lit(1.0 - len(cols) * m)} + {lit(m)})" for c in cols]
    den = f"greatest({vsum(q)}, {lit(1e-8)})"
    return [f"({x} / {den})" for x in q]


def softmax(cols):
    m = greatest(cols)
    ex = [f"exp({c} - {m})" for c in cols]
    den = f"greatest({vsum(ex)}, {lit(1e-8)})"
    return [f"({e} / {den})" for e in ex]


def row_std(cols):
    k = len(cols)
    mu = f"({vsum(cols)} / {lit(k)})"
    sd = f"sqrt({vsum([f'(({c} - {mu}) * ({c} - {mu}))' for c in cols])} / {lit(k)})"
    sd1 = f"greatest({sd}, {lit(1e-8)})"
    return [f"(({c} - {mu}) / {sd1})" for c in cols]


def minmax(cols):
    lo, hi = least(cols), greatest(cols)
    rng = f"({hi} - {lo})"
    return [f"(CASE WHEN {rng} < {lit(1e-8)} THEN {lit(0.0)} ELSE ({c} - {lo}) / {rng} END)" for c in cols]


def _median(col):
    return (f"(SELECT avg(v) FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn, "
            f"count(*) OVER () AS n FROM rounds0_c WHERE {col} IS NOT NULL) "
            f"WHERE rn IN ((n + 1) // 2, (n + 2) // 2))")


cte("rounds0_c", ["eventlog_c", "seg_c"], f"""
SELECT e.round_id, e.customer_unique_id, e.ts, e.action, e.reward,
       COALESCE(s.user_segment, 'regular') AS user_segment,
       {", ".join(f"CAST(s.{c} AS DOUBLE) AS {c}" for c in NUMS)}
FROM eventlog_c e LEFT JOIN seg_c s USING (customer_unique_id)""")

cte("codes_c", ["rounds0_c"], """
SELECT user_segment, (row_number() OVER (ORDER BY min(customer_unique_id), user_segment) - 1) AS seg_code
FROM rounds0_c GROUP BY user_segment""")

cte("rawctx_c", ["rounds0_c", "codes_c"], f"""
SELECT r.round_id, r.customer_unique_id, r.ts, r.action, r.reward, r.user_segment,
       {", ".join(f"COALESCE(r.{c}, COALESCE({_median(c)}, 0.0)) AS x{i}" for i, c in enumerate(NUMS))},
       CAST(c.seg_code AS DOUBLE) AS x6
FROM rounds0_c r JOIN codes_c c USING (user_segment)""")


def _z(i):
    sd = f"(SELECT stddev_pop(x{i}) FROM rawctx_c)"
    return (f"(x{i} - (SELECT avg(x{i}) FROM rawctx_c)) / "
            f"(CASE WHEN {sd} IS NULL OR {sd} < {lit(1e-8)} THEN {lit(1.0)} ELSE {sd} END) AS x{i}")


cte("ctx_c", ["rawctx_c"], f"""
SELECT round_id, customer_unique_id, ts, action, reward, user_segment, {", ".join(_z(i) for i in range(D))}
FROM rawctx_c""")

_emp_raw = [f"(CAST(c{a} AS DOUBLE) / CAST(n AS DOUBLE))" for a in range(K)]
cte("emp_c", ["ctx_c"], f"""
SELECT user_segment, {", ".join(f"{e} AS bp{a}" for a, e in enumerate(floor_prop(_emp_raw)))}
FROM (SELECT user_segment, {", ".join(f"sum(CASE WHEN action = {a} THEN 1 ELSE 0 END) AS c{a}" for a in range(K))},
             count(*) AS n FROM ctx_c GROUP BY user_segment)""")

_bp = [f"e.bp{a}" for a in range(K)]
cte("rounds_c", ["ctx_c", "emp_c"], f"""
SELECT r.*, {", ".join(_bp)}, greatest({pick(_bp, 'r.action')}, {lit(1e-6)}) AS pscore
FROM ctx_c r JOIN emp_c e USING (user_segment)""")

# Means-only reward model: per action count and mean, baseline action.
cte("amean_c", ["rounds_c"], """
SELECT action, count(*) AS n, sum(reward) / count(*) AS m FROM rounds_c GROUP BY action""")

_X = [f"x{i}" for i in range(D)]
_q = [f"(SELECT least(greatest(m, {lit(0.0)}), {lit(1.0)}) FROM amean_c WHERE action = {a})" for a in range(K)]
_n = [f"(SELECT n FROM amean_c WHERE action = {a})" for a in range(K)]
_quad = vsum([f"{x} * {x} * {lit(1.0)}" for x in _X])
cte("qv_c", ["rounds_c", "amean_c"], f"""
SELECT r.*, {", ".join(f"{q} AS q{a}" for a, q in enumerate(_q))},
       (SELECT min(action) FROM amean_c WHERE n = (SELECT max(n) FROM amean_c)) AS base,
       sqrt(greatest({_quad}, {lit(0.0)})) AS unc,
       {", ".join(f"{n} AS n{a}" for a, n in enumerate(_n))}
FROM rounds_c r""")

_Q = [f"q{a}" for a in range(K)]
cte("cu_c", ["qv_c"], f"""
SELECT *, {", ".join(f"(q{a} + {lit(P.alpha)} * (CASE WHEN n{a} < 10 THEN unc + {lit(0.2)} ELSE unc END)) AS c{a}"
                      for a in range(K))},
       {", ".join(f"(CASE WHEN base = {a} THEN {lit(0.0)} ELSE q{a} - {pick(_Q, 'base')} END) AS u{a}"
                  for a in range(K))}
FROM qv_c""")

_C = [f"c{a}" for a in range(K)]
_U = [f"u{a}" for a in range(K)]
_f = [f"(({lit(P.bandit_weight)} * {c}) + ({lit(P.uplift_weight)} * {u})) + ({lit(0.1)} * {q})"
      for c, u, q in zip(row_std(_C), row_std(_U), _Q)]
_r = [f"({lit(0.6)} * {c} + {lit(0.4)} * {u})" for c, u in zip(minmax(_C), minmax(_U))]
cte("scored_c", ["cu_c"], f"""
SELECT *, {", ".join(f"{e} AS f{a}" for a, e in enumerate(_f))},
       {", ".join(f"{e} AS r{a}" for a, e in enumerate(_r))}
FROM cu_c""")

_rule = (f"(CASE WHEN x0 > {lit(0.8)} THEN {min(K - 1, 4)} WHEN x0 > {lit(0.2)} THEN {min(K - 1, 3)} "
         f"WHEN x0 < {lit(-0.8)} THEN {min(K - 1, 1)} ELSE 0 END)")
cte("acts_c", ["scored_c"], f"""
SELECT *, {argmax(_C)} AS act_contextual_bandit, {argmax(_U)} AS act_uplift,
       {argmax([f'f{a}' for a in range(K)])} AS act_fusion,
       {argmax([f'r{a}' for a in range(K)])} AS act_rl_policy, {_rule} AS act_rule_engine
FROM scored_c""")


def ope_sql(policies) -> str:
    rows = []
    for pol in policies:
        t = f"act_{pol}"
        ind = f"(CASE WHEN action = {t} THEN {lit(1.0)} ELSE {lit(0.0)} END)"
        w = f"({ind} / greatest(pscore, {lit(1e-6)}))"
        rows.append(f"""
SELECT '{pol}' AS policy, sum(reward) / count(*) AS behavior_mean, sum({ind}) / count(*) AS overlap,
       sum({w} * reward) / count(*) AS ips,
       CASE WHEN sum({w}) > 0 THEN sum({w} * reward) / sum({w}) ELSE {lit(0.0)} END AS snips,
       sum({pick(_Q, t)} + {w} * (reward - {pick(_Q, 'action')})) / count(*) AS dr,
       sum({w}) AS weight_sum
FROM acts_c""")
    return "\nUNION ALL".join(rows)
