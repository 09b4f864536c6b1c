"""Queries for offers, strategies, prompts, copy and ROI (groups G, H8-H11,
I13-I18) plus the router feedback fold (T19, T20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlab.config import DEFAULT_PARAMS as P, POLICY_ORDER, SEGMENT_MULTIPLIER
from offerlab.operators import feedback as D
from offerlab.operators import feedback_fold as FF
from offerlab.operators import ope as E
from offerlab.operators import offers as G
from offerlab.operators import rfm as B
from offerlab.operators import router as T
from offerlab.operators.asof import asof_join
from offerlab.plans.catalog import present, query
from offerlab.plans.oracle import cte, with_ctes
from offerlab.plans.q_router import BIAS, act, decisions, routed_rounds, with_bias
from offerlab.session import cut_lineage
from offerlab.sources.tables import load_tables, read_table
from offerlab.streaming.decision_stream import DecisionStream

K = P.n_actions


def offer_requests(spark, sf_dir):
    """One offer request per logged event: its action, round, customer and
    segment (unknown customers: default segment)."""
    t = load_tables(spark, sf_dir)
    seg = B.rule_segments(B.rfm_features(t.completed)).select(
        "customer_unique_id", "user_segment", "avg_order_value")
    ev = D.event_log(spark, sf_dir)
    return ev.join(seg, "customer_unique_id", "left").select(
        "round_id", "customer_unique_id", F.col("action").alias("action_id"),
        F.lit("logged").alias("routed_tool"),
        F.coalesce("user_segment", F.lit("regular")).alias("user_segment"), "avg_order_value", "reward")


# ---------------------------------------------------------------------------
# Oracle pieces
# ---------------------------------------------------------------------------
def _q(s):
    return "'" + s.replace("'", "''") + "'"


_cat_rows = []
_tpl_rows = []
_chan_rows = []
for b, name, ch, cc, aud, cap, dc, tpls in G.CATALOG:
    _cat_rows.append(f"({b}, {_q(name)}, {_q(' + '.join(ch))}, {_q('、'.join(aud))}, {dc}, {len(tpls)}, "
                     f"{cap[0]}, {cap[1]})")
    for i, (tid, grp, text, tdc) in enumerate(tpls):
        _tpl_rows.append(f"({b}, {i}, {_q(tid)}, {_q(grp)}, {_q(text)}, {tdc})")
    for c in ch:
        _chan_rows.append(f"({b}, {_q(c)}, {cc.get(c, 0.0)})")

cte("cat_c", [], f"SELECT * FROM (VALUES {', '.join(_cat_rows)}) AS t(action_bucket, name, channels, audience, discount_cost, n_tpl, window_days, max_touch)")
cte("tpl_c", [], f"SELECT * FROM (VALUES {', '.join(_tpl_rows)}) AS t(action_bucket, idx, template_id, ab_group, text, discount_cost)")
cte("chan_c", [], f"SELECT * FROM (VALUES {', '.join(_chan_rows)}) AS t(action_bucket, channel, cost)")

cte("offreq_c", ["eventlog_c", "seg_c"], """
SELECT e.round_id, e.customer_unique_id, e.action AS action_id, 'logged' AS routed_tool,
       COALESCE(s.user_segment, 'regular') AS user_segment, s.avg_order_value, e.reward
FROM eventlog_c e LEFT JOIN seg_c s USING (customer_unique_id)""")

cte("offers_c", ["offreq_c", "cat_c", "tpl_c", "chan_c"], f"""
SELECT r.*, r.action_id % 5 AS action_bucket, c.channels, c.audience, c.window_days, c.max_touch,
       (('0x' || substr(md5(concat_ws('|', CAST(r.action_id AS VARCHAR), CAST(r.round_id AS VARCHAR),
              CAST(r.customer_unique_id AS VARCHAR), r.routed_tool, r.user_segment)), 1, 8))::BIGINT) % c.n_tpl AS idx,
       (SELECT sum(cost) FROM chan_c h WHERE h.action_bucket = r.action_id % 5) AS channel_cost
FROM offreq_c r JOIN cat_c c ON c.action_bucket = r.action_id % 5""")

cte("offers2_c", ["offers_c", "tpl_c"], """
SELECT o.*, t.template_id, t.ab_group, t.text AS offer_text, t.discount_cost,
       'action_' || o.action_bucket || '_tpl_' || t.template_id AS offer_id,
       t.discount_cost + o.channel_cost AS total_cost
FROM offers_c o JOIN tpl_c t ON t.action_bucket = o.action_bucket AND t.idx = o.idx""")


# G1-G5 ------------------------------------------------------------------------
@query("offer_resolution", with_ctes(["offers2_c"], """
SELECT round_id, offer_id, action_bucket::BIGINT AS action_bucket, template_id, ab_group, offer_text,
       channels, audience, round(discount_cost, 6) AS discount_cost, round(channel_cost, 6) AS channel_cost,
       round(total_cost, 6) AS total_cost
FROM offers2_c"""))
def q_offer_resolution(spark, sf_dir):
    off = G.resolve_offers(offer_requests(spark, sf_dir), G.catalog_df(spark))
    return present(off.select("round_id", "offer_id", "action_bucket", "template_id", "ab_group", "offer_text",
                              F.array_join("channels", " + ").alias("channels"),
                              F.array_join("audience_segments", "、").alias("audience"),
                              "discount_cost", "channel_cost", "total_cost"))


# G6-G9 ------------------------------------------------------------------------
_strat_rows = ", ".join("(" + ", ".join(_q(x) for x in (k, *v)) + ")" for k, v in G.DEFAULT_STRATEGIES.items())
cte("strat_c", [], f"SELECT * FROM (VALUES {_strat_rows}) AS t(segment, offer, channel, send_time, tone, goal)")


@query("strategy_overlay", with_ctes(["offers2_c", "strat_c"], """
SELECT o.round_id,
       CASE WHEN o.offer_text IS NOT NULL AND trim(o.offer_text) <> '' THEN o.offer_text END AS final_offer,
       o.routed_tool || ' (action=' || CAST(o.action_id AS VARCHAR) || ')' AS strategy_source,
       CASE WHEN o.channels <> '' THEN o.channels END AS final_channel, o.audience,
       COALESCE(s.send_time, r.send_time) AS strategy_send_time, COALESCE(s.tone, r.tone) AS strategy_tone,
       COALESCE(s.goal, r.goal) AS strategy_goal, CAST(o.window_days AS BIGINT) AS cap_window_days,
       CAST(o.max_touch AS BIGINT) AS cap_max_touch, o.offer_id, o.template_id
FROM offers2_c o LEFT JOIN strat_c s ON s.segment = o.user_segment
CROSS JOIN (SELECT * FROM strat_c WHERE segment = 'regular') r"""))
def q_strategy_overlay(spark, sf_dir):
    off = G.resolve_offers(offer_requests(spark, sf_dir), G.catalog_df(spark))
    st = G.with_default_strategy(off, G.default_strategies(spark))
    ov = G.strategy_overlay(st)
    return present(ov.select("round_id", "final_offer", "strategy_source", "final_channel", "audience",
                             "strategy_send_time", "strategy_tone", "strategy_goal",
                             F.col("frequency_cap.window_days").alias("cap_window_days"),
                             F.col("frequency_cap.max_touch").alias("cap_max_touch"),
                             "offer_id", "template_id"))


# I13 -------------------------------------------------------------------------
_DISC = f"""CASE WHEN offer_text IS NULL OR trim(offer_text) = '' OR avg_order_value IS NULL OR avg_order_value <= 0 THEN 5.0
     WHEN TRY_CAST(regexp_extract(offer_text, '{G.SPEND_SAVE}', 1) AS DOUBLE) IS NOT NULL
          THEN TRY_CAST(regexp_extract(offer_text, '{G.SPEND_SAVE}', 1) AS DOUBLE)
     WHEN TRY_CAST(regexp_extract(offer_text, '{G.REDUCE}', 1) AS DOUBLE) IS NOT NULL
          THEN TRY_CAST(regexp_extract(offer_text, '{G.REDUCE}', 1) AS DOUBLE)
     WHEN TRY_CAST(regexp_extract(offer_text, '{G.FOLD}', 1) AS DOUBLE) IS NOT NULL
          THEN round(avg_order_value * (1.0 - least(greatest(TRY_CAST(regexp_extract(offer_text, '{G.FOLD}', 1) AS DOUBLE), 0.1), 10.0) / 10.0) * 100.0) / 100.0
     ELSE 5.0 END"""


@query("discount_amount", with_ctes(["offers2_c"], f"""
SELECT round_id, offer_text, round({_DISC}, 6) AS discount_amount FROM offers2_c"""))
def q_discount_amount(spark, sf_dir):
    off = G.resolve_offers(offer_requests(spark, sf_dir), G.catalog_df(spark))
    return present(off.select("round_id", "offer_text",
                              G.discount_amount(F.col("offer_text"), F.col("avg_order_value")).alias("discount_amount")))


# I14, I16-I18 -------------------------------------------------------------------
_MULT = "CASE user_segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_MULTIPLIER.items()) + " ELSE 1.0 END"


def _roi_sql():
    body = f"""
, base AS (SELECT customer_unique_id, avg(reward) AS base_rate FROM offreq_c GROUP BY customer_unique_id),
r0 AS (SELECT o.*, least(greatest(b.base_rate, 0.001), 0.5) AS base_conversion,
              greatest(o.discount_cost, 0.0) + greatest(o.channel_cost, 0.0) AS tc, {_MULT} AS mult
       FROM offers2_c o JOIN base b USING (customer_unique_id)),
r1 AS (SELECT *, least(base_conversion * mult, 0.8) AS predicted_conversion FROM r0),
r2 AS (SELECT *, avg_order_value * (predicted_conversion - base_conversion) AS incremental_revenue FROM r1),
r3 AS (SELECT *, round((CASE WHEN tc > 0 THEN incremental_revenue / tc ELSE 0.0 END) * 100.0) / 100.0 AS roi FROM r2)
SELECT round_id, user_segment, round(base_conversion, 6) AS base_conversion,
       round(predicted_conversion, 6) AS predicted_conversion, round(tc, 6) AS total_cost,
       round(incremental_revenue, 6) AS incremental_revenue, roi,
       round((predicted_conversion - base_conversion) / base_conversion, 6) AS lift,
       CASE WHEN roi >= 0.9 AND predicted_conversion > 0.05 THEN 'launch test now'
            ELSE 'tune the offer before testing' END AS advice
FROM r3"""
    return with_ctes(["offers2_c", "offreq_c"], body, extra=True)


@query("roi_report", _roi_sql())
def q_roi_report(spark, sf_dir):
    req = offer_requests(spark, sf_dir)
    off = G.resolve_offers(req, G.catalog_df(spark))
    # base conversion: the customer's logged reward rate (an empirical model)
    base = req.groupBy("customer_unique_id").agg(F.avg("reward").alias("base_rate"))
    rep = G.roi_report(off.join(base, "customer_unique_id"), P, offer_col="offer_text")
    return present(rep.select("round_id", "user_segment", "base_conversion", "predicted_conversion",
                              "total_cost", "incremental_revenue", "roi", "lift", "advice"))


# H8, H9, H11 -------------------------------------------------------------------
def _money(x):
    return f"printf('%.2f', round(({x}) * 100.0) / 100.0)"


_STRATEGY = "LEFT JOIN strat_c t ON t.segment = s.user_segment CROSS JOIN (SELECT * FROM strat_c WHERE segment = 'regular') r"
_known = " || chr(10) || ".join(f"'{i}. ' || coalesce(t.{c}, r.{c})" for i, c in enumerate(("offer", "channel", "send_time", "tone", "goal"), 1))


@query("prompt_table", with_ctes(["seg_c", "prefs_c", "strat_c"], f"""
SELECT s.customer_unique_id, s.user_segment,
       'Plan one offer for a customer of segment ' || s.user_segment || ' (days since purchase ' || s.recency::BIGINT || ', orders ' || s.frequency::BIGINT
       || ', spend $' || {_money('s.monetary')} || ', mean order $' || coalesce({_money('s.avg_order_value')}, 'null')
       || ', likes ' || array_to_string(coalesce(p.favorite_categories, []), ', ') || ').' || chr(10) || 'What is known:' || chr(10) || {_known}
       || chr(10) || 'Answer with a JSON object: offer, channel, send_time, tone, goal.' AS prompt
FROM seg_c s LEFT JOIN prefs_c p USING (customer_unique_id) {_STRATEGY}"""))
def q_prompt_table(spark, sf_dir):
    from offerlab.plans.q_customers import profile_table

    _, prof = profile_table(spark, sf_dir)
    st = G.with_default_strategy(prof, G.default_strategies(spark))
    st = st.withColumn("knowledge", G.knowledge_text(F.array(
        "strategy_offer", "strategy_channel", "strategy_send_time", "strategy_tone", "strategy_goal")))
    return st.select("customer_unique_id", "user_segment", G.strategy_prompt(st).alias("prompt"))


def _copy_sql():
    from offerlab.plans.q_customers import _recommend_sql

    return with_ctes(["seg_c", "strat_c"], f"""
, recs AS ({_recommend_sql()})
SELECT s.customer_unique_id, CASE WHEN c.label IS NULL THEN 'For you: ' || coalesce(t.offer, r.offer)
       ELSE coalesce(t.offer, r.offer) || ' | ' || c.label || ' for $' || {_money('c.price')} END AS copy
FROM seg_c s LEFT JOIN recs c ON c.customer_unique_id = s.customer_unique_id AND c.pos = 1 {_STRATEGY}""", extra=True)


def _copy_prompt_sql():
    from offerlab.plans.q_customers import _recommend_sql

    return with_ctes(["seg_c", "prefs_c", "strat_c"], f"""
, recs AS ({_recommend_sql()}),
listed AS (SELECT customer_unique_id, string_agg(pos || '. ' || label || ' - $' || {_money('price')}, chr(10) ORDER BY pos) AS listed FROM recs GROUP BY customer_unique_id)
SELECT s.customer_unique_id, 'Write one short message (70 characters at most, plain text) for a customer of segment ' || s.user_segment
       || ' (spend $' || {_money('s.monetary')} || ', likes ' || array_to_string(coalesce(p.favorite_categories, []), ', ') || ').' || chr(10)
       || 'It names the offer "' || coalesce(t.offer, r.offer) || '" and at least one product, in this tone: ' || coalesce(t.tone, r.tone) || '.' || chr(10)
       || 'Products:' || chr(10) || coalesce(l.listed, '') AS prompt
FROM seg_c s LEFT JOIN prefs_c p USING (customer_unique_id) LEFT JOIN listed l USING (customer_unique_id) {_STRATEGY}""", extra=True)


@query("copy_prompts", _copy_prompt_sql())
def q_copy_prompts(spark, sf_dir):
    from offerlab.operators import recommend as R
    from offerlab.plans.q_customers import profile_table

    t, prof = profile_table(spark, sf_dir)
    recs = R.recommend(prof, R.product_stats(t))
    listed = recs.groupBy("customer_unique_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label", "price"))).alias("products"))  # n_recommend items
    st = G.with_default_strategy(prof, G.default_strategies(spark)).join(listed, "customer_unique_id", "left")
    return st.select("customer_unique_id", G.copy_prompt(st).alias("prompt"))


# What a model sent back, or the fallback. The log's event types stand for model outputs.
_OUTPUTS = {"click": '{"offer": "20% off", "tone": "warm"}', "error": "{broken", "purchase": "  ", "signup": "{}", "view": '```json {"offer": "x"}```'}


@query("parsed_strategies", with_ctes(["offreq_c", "strat_c"], """
SELECT e.event_id AS round_id, (CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS parsed,
       CASE WHEN e.event_type = 'click' THEN '20% off' ELSE coalesce(t.offer, r.offer) END AS offer,
       CASE WHEN e.event_type = 'click' THEN 'warm' ELSE coalesce(t.tone, r.tone) END AS tone,
       CASE WHEN e.event_type = 'click' THEN NULL ELSE coalesce(t.goal, r.goal) END AS goal,
       CASE WHEN e.event_type IN ('purchase') THEN 'For you: ' || coalesce(t.offer, r.offer)
            WHEN e.event_type = 'click' THEN '{"offer": "20% off", "tone": "warm"}' WHEN e.event_type = 'error' THEN '{broken'
            WHEN e.event_type = 'signup' THEN '{}' WHEN e.event_type = 'view' THEN '```json {"offer": "x"}```' ELSE 'For you: ' || coalesce(t.offer, r.offer) END AS copy
FROM events e JOIN offreq_c q ON q.round_id = e.event_id LEFT JOIN strat_c t ON t.segment = q.user_segment CROSS JOIN (SELECT * FROM strat_c WHERE segment = 'regular') r"""))
def q_parsed_strategies(spark, sf_dir):
    kinds = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("round_id"), "event_type")
    raw = F.lit(None).cast("string")
    for kind, text in _OUTPUTS.items():
        raw = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(raw)
    rows = offer_requests(spark, sf_dir).select("round_id", "user_segment").join(kinds, "round_id").withColumn("raw", raw)
    st = G.with_default_strategy(rows, G.default_strategies(spark))
    copy = G.copy_or_fallback(F.col("raw"), F.col("strategy_offer"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    out = G.with_parsed_strategy(st.withColumn("copy", copy))
    return present(out.select("round_id", F.col("strategy_parsed").alias("parsed"), F.col("strategy_offer").alias("offer"),
                              F.col("strategy_tone").alias("tone"), F.col("strategy_goal").alias("goal"), "copy"))


@query("copy_fallback", _copy_sql())
def q_copy_fallback(spark, sf_dir):
    from offerlab.operators import recommend as R
    from offerlab.plans.q_customers import profile_table

    t, prof = profile_table(spark, sf_dir)
    recs = R.recommend(prof, R.product_stats(t)).where(F.col("pos") == 1)
    st = G.with_default_strategy(prof, G.default_strategies(spark)).join(recs, "customer_unique_id", "left")
    return present(st.select("customer_unique_id",
                             G.fallback_copy(F.col("strategy_offer"), F.col("label"), F.col("price")).alias("copy")))


# T19, T20 --------------------------------------------------------------------
def feedback_events(spark, sf_dir, df=None, report=None):
    """Feedback log: each round's routed policy (heuristic router) with that
    policy's OPE report (DR value vs behaviour mean, rounded to 6), keyed by
    segment, in event-time order. ``df`` and ``report``: routed rounds and their
    report, where the caller has them."""
    df = routed_rounds(spark, sf_dir)[0] if df is None else df
    d = decisions(df)
    def r6(c):
        # reports carry 6 decimals (scaled binary rounding, engine-independent)
        return F.round(F.col(c) * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)

    rep = (E.ope_report(df, K) if report is None else report).select("policy", r6(FF.metric_column(P)).alias("metric_value"),
                                     r6("behavior_mean").alias("baseline"))
    return d.select(F.col("user_segment").alias("router_key"), F.col("ts").alias("event_time"),
                    F.col("round_id").alias("event_id"), "policy").join(F.broadcast(rep), "policy", "left")


def _fold_sql():
    from offerlab.plans.oracle_bandit import ope_sql, lit

    n = len(POLICY_ORDER)
    pidx = "CASE e.policy " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(POLICY_ORDER)) + " END"
    init = ", ".join([f"CAST(0.0 AS DOUBLE) AS b{j}" for j in range(n)] + [f"CAST(0 AS BIGINT) AS n{j}" for j in range(n)]
                     + [f"CAST(0.0 AS DOUBLE) AS em{j}" for j in range(n)] + [f"CAST(0.0 AS DOUBLE) AS ea{j}" for j in range(n)])
    dec = lit(1.0 - min(max(P.feedback_decay, 0.0), 0.99))
    ca = f"least(greatest(e.metric_value - e.baseline, {lit(-P.feedback_clip)}), {lit(P.feedback_clip)})"
    ebias = [f"((s.b{j} * {dec}) + (CASE WHEN {pidx} = {j} THEN {lit(P.feedback_lr)} * {ca} ELSE 0.0 END))"
             for j in range(n)]
    mean = "((" + " + ".join(ebias) + f") / {lit(n)})"
    nb = [f"least(greatest({b} - {mean}, {lit(-1.5)}), {lit(1.5)})" for b in ebias]
    beta = P.feedback_ema
    step = ", ".join(
        [f"{nb[j]} AS b{j}" for j in range(n)]
        + [f"s.n{j} + (CASE WHEN {pidx} = {j} THEN 1 ELSE 0 END) AS n{j}" for j in range(n)]
        + [f"CASE WHEN {pidx} = {j} THEN {lit(1 - beta)} * s.em{j} + {lit(beta)} * e.metric_value ELSE s.em{j} END AS em{j}" for j in range(n)]
        + [f"CASE WHEN {pidx} = {j} THEN {lit(1 - beta)} * s.ea{j} + {lit(beta)} * (e.metric_value - e.baseline) ELSE s.ea{j} END AS ea{j}" for j in range(n)])
    old = "CASE " + " ".join(f"WHEN {pidx} = {j} THEN s.b{j} * {dec}" for j in range(n)) + " END"
    body = f"""
, rep AS ({ope_sql(POLICY_ORDER)}),
fe AS (SELECT d.user_segment AS router_key, d.round_id AS event_id, d.policy,
              (round(r.dr * 1000000.0) / 1000000.0 + 0.0) AS metric_value,
              (round(r.behavior_mean * 1000000.0) / 1000000.0 + 0.0) AS baseline,
              row_number() OVER (PARTITION BY d.user_segment ORDER BY d.ts, d.round_id) AS rn
       FROM decide_c d JOIN rep r ON r.policy = d.policy),
st AS (SELECT router_key, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS policy,
              NULL::DOUBLE AS metric_value, NULL::DOUBLE AS baseline, NULL::DOUBLE AS old_bias, {init}
       FROM (SELECT DISTINCT router_key FROM fe)
       UNION ALL
       SELECT s.router_key, s.rn + 1, e.event_id, e.policy, e.metric_value, e.baseline, {old}, {step}
       FROM st s JOIN fe e ON e.router_key = s.router_key AND e.rn = s.rn + 1)
SELECT router_key, event_id, policy, CAST(1 AS BIGINT) AS enabled, round(metric_value, 6) AS metric_value,
       round(baseline, 6) AS baseline, round(metric_value - baseline, 6) AS advantage,
       round(least(greatest(metric_value - baseline, {lit(-P.feedback_clip)}), {lit(P.feedback_clip)}), 6) AS clipped_advantage,
       round(old_bias, 6) AS old_bias,
       round(CASE {" ".join(f"WHEN policy = '{p}' THEN b{j}" for j, p in enumerate(POLICY_ORDER))} END, 6) AS new_bias,
       {", ".join(f"round(b{j}, 6) AS bias_{p}" for j, p in enumerate(POLICY_ORDER))},
       CASE {" ".join(f"WHEN policy = '{p}' THEN n{j}" for j, p in enumerate(POLICY_ORDER))} END AS feedback_count,
       round(CASE {" ".join(f"WHEN policy = '{p}' THEN em{j}" for j, p in enumerate(POLICY_ORDER))} END, 6) AS ema_metric,
       round(CASE {" ".join(f"WHEN policy = '{p}' THEN ea{j}" for j, p in enumerate(POLICY_ORDER))} END, 6) AS ema_advantage
FROM st WHERE rn > 0"""
    sql = with_ctes(["decide_c", "acts_c"], body, extra=True)
    return "WITH RECURSIVE " + sql[len("WITH "):]


def _snapshot_sql():
    """T20 over the same recursion: the state at each key's last event."""
    sql = _fold_sql()
    i = sql.rindex("SELECT router_key, event_id, policy")
    names = ", ".join(f"round(b{j}, 6) AS bias_{p}" for j, p in enumerate(POLICY_ORDER))
    return sql[:i] + f"""SELECT router_key, rn AS events, {names} FROM st
WHERE rn > 0 AND (router_key, rn) IN (SELECT (router_key, max(rn)) FROM st GROUP BY router_key)"""


@query("feedback_fold", _fold_sql())
def q_feedback_fold(spark, sf_dir):
    return present(FF.fold_feedback(feedback_events(spark, sf_dir)).drop("reason", "event_time"))


@query("bias_snapshot", _snapshot_sql())
def q_bias_snapshot(spark, sf_dir):
    return present(FF.bias_snapshot(FF.fold_feedback(feedback_events(spark, sf_dir))))


# Every branch of the decision, with the bias that feedback has left ------
#: Requested mode by event type: automatic, by alias, by name, unknown.
MODES = {"click": "auto", "error": " Bandit ", "purchase": "auto", "signup": "no such policy", "view": "fusion"}


def requested_rounds(spark, sf_dir):
    """(rounds with the requested mode, their feedback log)."""
    df, _ = routed_rounds(spark, sf_dir)
    kinds = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("round_id"), "event_type")
    mode = F.lit(None).cast("string")
    for kind, name in MODES.items():
        mode = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(mode)
    df = cut_lineage(df.join(kinds, "round_id").withColumn("requested", mode))
    return df, feedback_events(spark, sf_dir, df)


def modal_rounds(spark, sf_dir):
    df, log = requested_rounds(spark, sf_dir)
    return with_bias(df, cut_lineage(FF.bias_snapshot(FF.fold_feedback(log))))


def _modes_sql(as_of=False):
    from offerlab.plans import oracle_bandit as OB
    from offerlab.plans.q_router import lit

    n = len(POLICY_ORDER)
    if as_of:  # the bias after the key's last feedback before the round, by (time, id)
        fold = _fold_sql()
        biases = ", ".join(f"b{j} AS bias_{p}" for j, p in enumerate(POLICY_ORDER))
        snap = f"SELECT f.*, q.place FROM ({fold[:fold.rindex('SELECT router_key, event_id, policy')]}SELECT router_key, event_id, {biases} FROM st WHERE rn > 0) f JOIN places q ON q.round_id = f.event_id"
        met = "JOIN places q ON q.round_id = d.round_id ASOF LEFT JOIN snap s ON s.router_key = d.user_segment AND q.place > s.place"
    else:
        snap, met = _snapshot_sql(), "LEFT JOIN snap s ON s.router_key = d.user_segment"
    names = {"click": "auto", "error": "contextual_bandit", "purchase": "auto", "signup": "rule_engine", "view": "fusion"}
    mode = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " ELSE 'rule_engine' END"
    logits = [f"(lg{i} + coalesce(s.bias_{p}, 0.0))" for i, p in enumerate(POLICY_ORDER)]
    cand = OB.softmax([f"bl{i}" for i in range(n)])
    best = "CASE " + OB.argmax([f"bc{i}" for i in range(n)]) + " " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(POLICY_ORDER)) + " END"
    return with_ctes(["dist_c"], f"""
, places AS (SELECT round_id, row_number() OVER (ORDER BY ts, round_id) AS place FROM dist_c),
snap AS ({snap}),
ml AS (SELECT d.*, {mode} AS mode, {", ".join(f"{x} AS bl{i}" for i, x in enumerate(logits))}
       FROM dist_c d JOIN events e ON e.event_id = d.round_id {met}),
mc AS (SELECT *, {", ".join(f"{c} AS bc{i}" for i, c in enumerate(cand))} FROM ml),
md AS (SELECT *, mode <> 'auto' AS manual, mode = 'auto' AND NOT known_customer AS missing,
              mode = 'auto' AND known_customer AND pscore < {lit(P.force_rule_pscore)} AS forced FROM mc)
SELECT round_id, mode, CASE WHEN manual THEN mode WHEN missing OR forced THEN 'rule_engine' ELSE ({best}) END AS policy,
       round(CASE WHEN manual OR missing THEN 1.0 ELSE greatest({", ".join(f"bc{i}" for i in range(n))}) END, 6) AS confidence,
       concat_ws(',', CASE WHEN manual THEN 'manual_override' END, CASE WHEN missing THEN 'missing_context_force_rule_engine' END,
                 CASE WHEN NOT manual AND NOT missing THEN 'auto_heuristic_router' END, CASE WHEN forced THEN 'force_rule_by_very_low_pscore' END,
                 CASE WHEN pscore < {lit(P.low_pscore)} THEN 'low_pscore' END, CASE WHEN complexity >= {lit(P.high_complexity)} THEN 'high_complexity' END,
                 CASE WHEN churn_risk >= {lit(0.7)} THEN 'high_churn_risk' END) AS reasons
FROM md""", extra=True)


@query("router_decide_modes", _modes_sql())
def q_router_decide_modes(spark, sf_dir):
    d = decisions(modal_rounds(spark, sf_dir), P, BIAS, "requested", "known_customer")
    return present(d.select("round_id", "mode", "policy", "confidence", F.array_join("reasons", ",").alias("reasons")))


# The bias as of each round ---------------------------------------------
def bias_as_of(df, folded):
    """Rounds with the bias that feedback before them has left (0 before the first)."""
    out = asof_join(df, folded, ("user_segment", "ts", "round_id"), ("router_key", "event_time", "event_id"), BIAS)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in BIAS})


@query("router_decide_asof", _modes_sql(as_of=True))
def q_router_decide_asof(spark, sf_dir):
    df, log = requested_rounds(spark, sf_dir)
    d = decisions(bias_as_of(df, cut_lineage(FF.fold_feedback(log))), P, BIAS, "requested", "known_customer")
    return present(d.select("round_id", "mode", "policy", "confidence", F.array_join("reasons", ",").alias("reasons")))


# J1-J5 -------------------------------------------------------------------------
@query("decision_report")
def q_decision_report(spark, sf_dir):
    from offerlab.plans.decision import decision_report

    return present(decision_report(spark, sf_dir))


# Rounds and their feedback as a stream ----------------------------------------
#: How late a round may come; the replayed log arrives shuffled within it, in so many files.
STREAM_DELAY_SECONDS, STREAM_FILES = 86_400, 4


def streamed(spark, sf_dir, path, files=STREAM_FILES):
    """The log arrives part by part, each round up to the delay late; returns the finished stream."""
    df, log = requested_rounds(spark, sf_dir)
    feedback = log.select("router_key", F.col("event_time").cast("timestamp").alias("event_time"), "event_id", "policy", "metric_value", "baseline")
    own = ["profile_recency", "known_customer", "churn_risk"]  # these come from the static profiles
    rounds = cut_lineage(df.drop(*own).join(feedback, F.col("round_id") == F.col("event_id")))
    arrival = F.unix_micros("event_time") + F.pmod(F.xxhash64("event_id"), F.lit(STREAM_DELAY_SECONDS)) * 1_000_000
    rounds = rounds.withColumn("arrival", arrival)
    cuts = [0, *rounds.approxQuantile("arrival", [i / files for i in range(1, files)], 0.01), float(1 << 62)]
    for low, high in zip(cuts, cuts[1:]):
        rounds.where((F.col("arrival") > low) & (F.col("arrival") <= high)).drop("arrival").write.mode("append").parquet(f"{path}/arrived")
    t = load_tables(spark, sf_dir)
    profiles = B.rfm_features(t.completed).select("customer_unique_id", F.col("recency").alias("profile_recency"))

    def decide(due):
        known = due.drop("policy", "metric_value", "baseline").withColumn("known_customer", F.col("profile_recency").isNotNull())
        known = known.withColumn("profile_recency", F.coalesce("profile_recency", F.lit(30)))
        known = known.withColumn("churn_risk", F.expr(T.churn_risk("profile_recency", "x0", P)))
        d = act(decisions(known, P, BIAS, "requested", "known_customer"), P)
        # ends the lineage: the offers would repeat the routing expressions
        d = cut_lineage(d.select("round_id", "customer_unique_id", "user_segment", "late", "mode", "policy", "confidence", "reasons", "selected_action"))
        d = G.resolve_offers(d.withColumnRenamed("selected_action", "action_id").withColumnRenamed("policy", "routed_tool"), G.catalog_df(spark))
        return d.select("round_id", "late", "mode", F.col("routed_tool").alias("policy"), "confidence", F.array_join("reasons", ",").alias("reasons"),
                        F.col("action_id").alias("selected_action"), "offer_id", "ab_group")

    stream = DecisionStream(f"{path}/stream", profiles, decide, f"{STREAM_DELAY_SECONDS} seconds")
    # a part of the log is one file per partition
    batches = stream.run(spark, f"{path}/arrived", rounds.drop("arrival").schema, max(1, rounds.rdd.getNumPartitions()))
    stream.finish(batches)
    return stream


def _stream_path(spark):
    import uuid

    from offerlab.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("decision_stream", _modes_sql(as_of=True))
def q_decision_stream(spark, sf_dir):
    out = streamed(spark, sf_dir, _stream_path(spark)).table(spark, "decisions").where("not late")
    return present(out.select("round_id", "mode", "policy", "confidence", "reasons"))


@query("feedback_stream", _fold_sql())
def q_feedback_stream(spark, sf_dir):
    return present(streamed(spark, sf_dir, _stream_path(spark)).table(spark, "folded").drop("reason", "event_time", "batch"))
