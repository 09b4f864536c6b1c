"""Queries for groups A-C: tables, customer features, segments,
preferences, profiles and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlab.config import CATEGORY_LABELS, SEGMENTS
from offerlab.operators import preferences as P
from offerlab.operators import recommend as R
from offerlab.operators import rfm as B
from offerlab.plans.catalog import present, query
from offerlab.plans.oracle import with_ctes
from offerlab.sources.tables import CUSTOMERS_CSV, ITEMS_CSV, MONEY, ORDERS_CSV, PRODUCTS_CSV, TRANSLATION_CSV, load_csv_tables, load_tables, read_table


def _ts(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def profile_table(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    seg = B.rule_segments(B.rfm_features(t.completed))
    prefs = P.preferences(P.customer_items(t))
    return t, P.profiles(seg, prefs)


# A4-A6 ----------------------------------------------------------------------
ORDER_TOTALS_SQL = with_ctes(["completed_c"], f"""
SELECT order_id, customer_unique_id, {_ts('ts').replace(' AS ts', ' AS order_purchase_timestamp')},
       round(order_total, 6) AS order_total, round(freight_total, 6) AS freight_total,
       item_count::DOUBLE AS item_count
FROM completed_c""")


@query("order_totals", ORDER_TOTALS_SQL)
def q_order_totals(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    # item_count is NULL for orders without items: emitted as DOUBLE so
    # both engines carry the NULL the same way
    return present(t.completed.select("order_id", "customer_unique_id", "order_purchase_timestamp",
                                      "order_total", "freight_total",
                                      F.col("item_count").cast("double").alias("item_count")))


# The same totals from CSV files of the original layout ------------------------
def write_csv_tables(spark, sf_dir, path):
    """The driver's tables as CSV files of the original layout (folders of part files)."""
    orders, items, part, customer = (read_table(spark, sf_dir, x) for x in ("orders", "lineitem", "part", "customer"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    none = F.lit(None).cast("string")
    layout = {
        "olist_orders_dataset.csv": orders.select(F.col("o_orderkey"), "o_custkey", "o_orderstatus", text(F.col("o_orderdate")), none, none, none, none).toDF(*[f.name for f in ORDERS_CSV]),
        "olist_order_items_dataset.csv": items.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("s"), none, "l_extendedprice", F.round(
            F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast(MONEY), 2)).toDF(*[f.name for f in ITEMS_CSV]),
        "olist_customers_dataset.csv": customer.select("c_custkey", F.col("c_custkey").alias("u"), none, none, none).toDF(*[f.name for f in CUSTOMERS_CSV]),
        "olist_products_dataset.csv": part.select("p_partkey", "p_type", *[none] * 7).toDF(*[f.name for f in PRODUCTS_CSV]),
        "product_category_name_translation.csv": spark.createDataFrame(sorted(CATEGORY_LABELS.items()), ", ".join(f"{f.name} string" for f in TRANSLATION_CSV)),
    }
    for name, df in layout.items():
        df.write.option("header", True).csv(f"{path}/{name}")


@query("order_totals_csv", ORDER_TOTALS_SQL)
def q_order_totals_csv(spark, sf_dir):
    import uuid

    from offerlab.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv_tables(spark, sf_dir, path)
    t = load_csv_tables(spark, path, "F", quarantine=f"{path}/refused")
    return present(t.completed.select(F.col("order_id").cast("long").alias("order_id"), F.col("customer_unique_id").cast("long").alias("customer_unique_id"),
                                      "order_purchase_timestamp", "order_total", "freight_total", F.col("item_count").cast("double").alias("item_count")))


# B1-B3 ----------------------------------------------------------------------
@query("rfm", with_ctes(["rfm_c"], f"""
SELECT customer_unique_id, recency::BIGINT AS recency, frequency::BIGINT AS frequency,
       round(monetary, 6) AS monetary, round(avg_order_value, 6) AS avg_order_value,
       total_items, round(avg_items_per_order, 6) AS avg_items_per_order,
       {_ts('first_purchase')}, {_ts('last_purchase')},
       customer_lifetime::BIGINT AS customer_lifetime
FROM rfm_c"""))
def q_rfm(spark, sf_dir):
    return present(B.rfm_features(load_tables(spark, sf_dir).completed))


# B4 -------------------------------------------------------------------------
_Z = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM rfm_c)) / (SELECT CASE WHEN stddev_pop({c}) IS NULL "
    f"OR stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM rfm_c), 6) AS {c}_z"
    for c in B.RFM_FEATURES)


@query("rfm_scaled", with_ctes(["rfm_c"], f"SELECT customer_unique_id, {_Z} FROM rfm_c"))
def q_rfm_scaled(spark, sf_dir):
    z = B.standardize(B.rfm_features(load_tables(spark, sf_dir).completed))
    return present(z.select("customer_unique_id", *[f"{c}_z" for c in B.RFM_FEATURES]))


# B9, B10 --------------------------------------------------------------------
@query("rule_segments", with_ctes(["seg_c"], """
SELECT customer_unique_id, user_segment, recency::BIGINT AS recency, frequency::BIGINT AS frequency,
       round(monetary, 6) AS monetary FROM seg_c"""))
def q_rule_segments(spark, sf_dir):
    seg = B.rule_segments(B.rfm_features(load_tables(spark, sf_dir).completed))
    return present(seg.select("customer_unique_id", "user_segment", "recency", "frequency", "monetary"))


@query("segment_mix", with_ctes(["seg_c"], """
SELECT user_segment, count(*) AS customers, round(avg(monetary), 6) AS avg_monetary
FROM seg_c GROUP BY user_segment"""))
def q_segment_mix(spark, sf_dir):
    seg = B.rule_segments(B.rfm_features(load_tables(spark, sf_dir).completed))
    return present(seg.groupBy("user_segment").agg(F.count(F.lit(1)).alias("customers"),
                                                   F.avg("monetary").alias("avg_monetary")))


# B11-B13 --------------------------------------------------------------------
@query("favorite_categories", with_ctes(["favs_c"], """
SELECT customer_unique_id, fav_rank::BIGINT AS fav_rank, category, cnt FROM favs_c"""))
def q_favorite_categories(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return present(P.favorite_categories(P.customer_items(t))
                   .select("customer_unique_id", "fav_rank", "category", "cnt"))


@query("profiles", with_ctes(["seg_c", "prefs_c"], """
SELECT s.customer_unique_id, s.user_segment, s.recency::BIGINT AS recency,
       s.frequency::BIGINT AS frequency, round(s.monetary, 6) AS monetary,
       round(s.avg_order_value, 6) AS avg_order_value,
       round(CASE WHEN p.purchase_count IS NULL THEN 0.0 ELSE p.avg_price END, 6) AS avg_price,
       round(p.total_spent, 6) AS total_spent, p.purchase_count::DOUBLE AS purchase_count,
       array_to_string(COALESCE(p.favorite_categories, []), ',') AS favorite_categories
FROM seg_c s LEFT JOIN prefs_c p USING (customer_unique_id)"""))
def q_profiles(spark, sf_dir):
    _, prof = profile_table(spark, sf_dir)
    return present(prof.select(
        "customer_unique_id", "user_segment", "recency", "frequency", "monetary", "avg_order_value",
        "avg_price", "total_spent", F.col("purchase_count").cast("double").alias("purchase_count"),
        F.array_join("favorite_categories", ",").alias("favorite_categories")))


# Profiles for every logged user (unknown ones get defaults) ------
def _profile_lookup_sql():
    body = """
, req AS (SELECT DISTINCT user_id AS customer_unique_id FROM events),
prof AS (SELECT s.*, CASE WHEN p.purchase_count IS NULL THEN 0.0 ELSE p.avg_price END AS avg_price2,
                COALESCE(p.favorite_categories, []) AS favs
         FROM seg_c s LEFT JOIN prefs_c p USING (customer_unique_id))
SELECT r.customer_unique_id, (p.customer_unique_id IS NOT NULL)::BIGINT AS found,
       CASE WHEN p.customer_unique_id IS NULL THEN 'regular' ELSE p.user_segment END AS user_segment,
       (CASE WHEN p.customer_unique_id IS NULL THEN 30 ELSE p.recency END)::BIGINT AS recency,
       (CASE WHEN p.customer_unique_id IS NULL THEN 1 ELSE p.frequency END)::BIGINT AS frequency,
       round(CASE WHEN p.customer_unique_id IS NULL THEN 100.0 ELSE p.monetary END, 6) AS monetary,
       round(CASE WHEN p.customer_unique_id IS NULL THEN 100.0 ELSE p.avg_order_value END, 6) AS avg_order_value,
       round(CASE WHEN p.customer_unique_id IS NULL THEN 1.0 ELSE p.avg_items_per_order END, 6) AS avg_items_per_order,
       round(CASE WHEN p.customer_unique_id IS NULL THEN 100.0 ELSE p.avg_price2 END, 6) AS avg_price,
       array_to_string(CASE WHEN p.customer_unique_id IS NULL THEN [] ELSE p.favs END, ',') AS favorite_categories
FROM req r LEFT JOIN prof p USING (customer_unique_id)"""
    return with_ctes(["seg_c", "prefs_c"], body, extra=True)


@query("profile_lookup", _profile_lookup_sql())
def q_profile_lookup(spark, sf_dir):
    _, prof = profile_table(spark, sf_dir)
    req = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_unique_id")).distinct()
    out = P.lookup_profiles(req, prof)
    return present(out.select(
        "customer_unique_id", "found", "user_segment", "recency", "frequency", "monetary",
        "avg_order_value", "avg_items_per_order", "avg_price",
        F.array_join("favorite_categories", ",").alias("favorite_categories")))


# C1-C4 ----------------------------------------------------------------------
@query("product_stats", with_ctes(["pstats_c"], """
SELECT product_id, round(avg_price, 6) AS avg_price, sales_count, category FROM pstats_c"""))
def q_product_stats(spark, sf_dir):
    s = R.product_stats(load_tables(spark, sf_dir))
    return present(s.select("product_id", "avg_price", "sales_count", "category"))


@query("category_bestsellers", with_ctes(["catbest_c"], """
SELECT category, cat_rank::BIGINT AS cat_rank, product_id, round(avg_price, 6) AS avg_price, sales_count
FROM catbest_c"""))
def q_category_bestsellers(spark, sf_dir):
    s = R.category_bestsellers(R.product_stats(load_tables(spark, sf_dir)))
    return present(s.select("category", "cat_rank", "product_id", "avg_price", "sales_count"))


@query("global_bestsellers", with_ctes(["globalbest_c"], """
SELECT global_rank::BIGINT AS global_rank, product_id, category, round(avg_price, 6) AS avg_price, sales_count
FROM globalbest_c"""))
def q_global_bestsellers(spark, sf_dir):
    s = R.global_bestsellers(R.product_stats(load_tables(spark, sf_dir)))
    return present(s.select("global_rank", "product_id", "category", "avg_price", "sales_count"))


# C5-C8 ----------------------------------------------------------------------
def _recommend_sql():
    body = """
, prof AS (SELECT s.customer_unique_id, COALESCE(p.favorite_categories, []) AS favs,
                  CASE WHEN p.purchase_count IS NULL THEN 0.0 ELSE p.avg_price END AS avg_price
           FROM seg_c s LEFT JOIN prefs_c p USING (customer_unique_id)),
base AS (SELECT customer_unique_id, favs,
                CASE WHEN avg_price IS NULL OR avg_price = 0 THEN (SELECT avg(avg_price) FROM pstats_c)
                     ELSE avg_price END AS anchor FROM prof),
fav AS (SELECT customer_unique_id, anchor, unnest(favs) AS category,
               generate_subscripts(favs, 1) - 1 AS cat_pos FROM base),
src0 AS (SELECT f.customer_unique_id, b.product_id, b.category, b.avg_price AS price,
                0 AS source, f.cat_pos, b.cat_rank AS rnk
         FROM fav f JOIN catbest_c b ON b.category = f.category
         WHERE b.avg_price BETWEEN 0.5 * f.anchor AND 1.5 * f.anchor),
src1 AS (SELECT c.customer_unique_id, g.product_id, g.category, g.avg_price AS price,
                1 AS source, 0 AS cat_pos, g.global_rank AS rnk
         FROM base c, globalbest_c g),
cand AS (SELECT * FROM src0 UNION ALL
         SELECT * FROM src1 WHERE NOT EXISTS (
             SELECT 1 FROM src0 WHERE src0.customer_unique_id = src1.customer_unique_id
                                  AND src0.product_id = src1.product_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY source, cat_pos, rnk) AS pos
           FROM cand QUALIFY pos <= 3)
SELECT customer_unique_id, pos::BIGINT AS pos, product_id, category, round(price, 6) AS price,
       concat_ws(' ', COALESCE(category, 'None'), 'item', substr(CAST(product_id AS VARCHAR), 1, 8)) AS label,
       source::BIGINT AS source
FROM ranked"""
    return with_ctes(["seg_c", "prefs_c", "pstats_c", "catbest_c", "globalbest_c"], body, extra=True)


@query("recommendations", _recommend_sql())
def q_recommendations(spark, sf_dir):
    t, prof = profile_table(spark, sf_dir)
    stats = R.product_stats(t)
    return present(R.recommend(prof, stats))


# Five customers of each segment (of all, where a segment has fewer) -----------------
@query("customer_samples", with_ctes(["seg_c"], f"""
, wanted AS (SELECT unnest([{", ".join(f"'{s}'" for s in SEGMENTS)}, 'nobody']) AS asked),
pool AS (SELECT w.asked, s.customer_unique_id, s.user_segment, md5('42|' || s.customer_unique_id) AS h FROM wanted w, seg_c s
         WHERE s.user_segment = w.asked OR (SELECT count(*) FROM seg_c c WHERE c.user_segment = w.asked) < 5)
SELECT asked, customer_unique_id, user_segment FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY h, customer_unique_id) AS rk FROM pool) WHERE rk <= 5""", extra=True))
def q_customer_samples(spark, sf_dir):
    from functools import reduce

    from offerlab.session import cut_lineage

    seg = cut_lineage(B.rule_segments(B.rfm_features(load_tables(spark, sf_dir).completed)).select("customer_unique_id", "user_segment"))
    parts = [P.sample_customers(seg, 5, name).select(F.lit(name).alias("asked"), "customer_unique_id", "user_segment") for name in (*SEGMENTS, "nobody")]
    return present(reduce(lambda a, b: a.unionByName(b), parts))
