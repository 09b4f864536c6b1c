"""DuckDB oracle SQL building blocks.

Each named CTE restates one canonical table or one operator in plain SQL
over the driver's pre-registered views, so that a query's oracle is the
WITH-chain of the CTEs it needs plus a final SELECT. Written independently
of the Spark code (long form instead of arrays, SQL windows instead of
DataFrame calls) so that agreement means something.
"""

from __future__ import annotations

from offerlab.config import CATEGORY_LABELS, EVENT_ACTIONS

_CAT_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(CATEGORY_LABELS.items()))
_ACT_VALUES = ", ".join(f"('{e}', {i})" for i, e in enumerate(EVENT_ACTIONS))

M = "DECIMAL(18,2)"

CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTE[name] = (deps, sql)


cte("orders_c", [], """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
       o_orderdate AS ts
FROM orders""")

cte("items_c", [], f"""
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
       l_extendedprice AS price,
       round(CAST(l_extendedprice AS {M}) * CAST(l_tax AS {M}), 2)::DOUBLE AS freight_value
FROM lineitem""")

cte("catmap_c", [], f"SELECT * FROM (VALUES {_CAT_VALUES}) AS t(product_category_name, category)")

cte("products_c", ["catmap_c"], """
SELECT p.p_partkey AS product_id, p.p_type AS product_category_name, m.category
FROM part p LEFT JOIN catmap_c m ON m.product_category_name = p.p_type""")

cte("totals_c", ["items_c"], f"""
SELECT order_id,
       COALESCE(sum(CAST(price AS {M})), 0)::DOUBLE AS order_total,
       COALESCE(sum(CAST(freight_value AS {M})), 0)::DOUBLE AS freight_total,
       count(order_item_id) AS item_count
FROM items_c WHERE order_id IS NOT NULL GROUP BY order_id""")

cte("enriched_c", ["orders_c", "totals_c"], """
SELECT o.order_id, o.customer_id, o.order_status, o.ts, t.order_total, t.freight_total,
       t.item_count, c.c_custkey AS customer_unique_id
FROM orders_c o
LEFT JOIN totals_c t ON t.order_id = o.order_id
LEFT JOIN customer c ON c.c_custkey = o.customer_id""")

cte("completed_c", ["enriched_c"], "SELECT * FROM enriched_c WHERE order_status = 'F'")

cte("rfm_c", ["completed_c"], f"""
SELECT customer_unique_id,
       date_sub('day', max(ts), (SELECT max(ts) + INTERVAL 1 DAY FROM completed_c))::INTEGER AS recency,
       count(DISTINCT order_id) AS frequency,
       COALESCE(sum(CAST(order_total AS {M})), 0)::DOUBLE AS monetary,
       CASE WHEN count(order_total) > 0
            THEN COALESCE(sum(CAST(order_total AS {M})), 0)::DOUBLE / count(order_total) END
            AS avg_order_value,
       COALESCE(sum(item_count), 0)::BIGINT AS total_items,
       avg(item_count) AS avg_items_per_order,
       min(ts) AS first_purchase, max(ts) AS last_purchase,
       date_sub('day', min(ts), max(ts))::INTEGER AS customer_lifetime
FROM completed_c WHERE customer_unique_id IS NOT NULL
GROUP BY customer_unique_id""")

SEGMENT_CASE = """CASE
  WHEN recency < 30 AND frequency > 2 AND monetary > 200 THEN 'loyal'
  WHEN recency < 60 AND frequency > 1 AND monetary > 100 THEN 'growth'
  WHEN recency < 90 AND frequency = 1 THEN 'new'
  WHEN recency < 180 AND monetary > 50 THEN 'regular'
  ELSE 'churn_risk' END"""

cte("seg_c", ["rfm_c"], f"SELECT *, {SEGMENT_CASE} AS user_segment FROM rfm_c")

# Items of completed orders with their customer and category.
cte("citems_c", ["items_c", "completed_c", "products_c"], """
SELECT i.*, o.customer_unique_id, p.category
FROM items_c i JOIN completed_c o ON o.order_id = i.order_id
LEFT JOIN products_c p ON p.product_id = i.product_id""")

cte("favs_c", ["citems_c"], """
SELECT customer_unique_id, category, cnt,
       row_number() OVER (PARTITION BY customer_unique_id ORDER BY cnt DESC, category) AS fav_rank
FROM (SELECT customer_unique_id, category, count(*) AS cnt FROM citems_c
      WHERE category IS NOT NULL AND customer_unique_id IS NOT NULL
      GROUP BY ALL)
QUALIFY fav_rank <= 3""")

cte("prefs_c", ["citems_c", "favs_c"], f"""
SELECT a.customer_unique_id, a.avg_price, a.total_spent, a.purchase_count,
       COALESCE(f.favs, []) AS favorite_categories
FROM (SELECT customer_unique_id,
             sum(CAST(price AS {M}))::DOUBLE / count(price) AS avg_price,
             COALESCE(sum(CAST(price AS {M})), 0)::DOUBLE AS total_spent,
             count(*) AS purchase_count
      FROM citems_c WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id) a
LEFT JOIN (SELECT customer_unique_id, list(category ORDER BY fav_rank) AS favs
           FROM favs_c GROUP BY customer_unique_id) f USING (customer_unique_id)""")

cte("pstats_c", ["items_c", "products_c"], f"""
SELECT s.product_id, s.avg_price, s.sales_count, p.category
FROM (SELECT product_id, sum(CAST(price AS {M}))::DOUBLE / count(price) AS avg_price,
             count(order_item_id) AS sales_count
      FROM items_c WHERE product_id IS NOT NULL GROUP BY product_id) s
LEFT JOIN products_c p ON p.product_id = s.product_id""")

cte("catbest_c", ["pstats_c"], """
SELECT category, product_id, avg_price, sales_count,
       row_number() OVER (PARTITION BY category ORDER BY sales_count DESC, product_id) AS cat_rank
FROM pstats_c WHERE category IS NOT NULL
QUALIFY cat_rank <= 5""")

cte("globalbest_c", ["pstats_c"], """
SELECT product_id, category, avg_price, sales_count,
       row_number() OVER (ORDER BY sales_count DESC, product_id) AS global_rank
FROM pstats_c QUALIFY global_rank <= 20""")

cte("eventlog_c", [], f"""
SELECT e.event_id AS round_id, e.user_id AS customer_unique_id, e.ts, a.action,
       CASE WHEN e.value >= 50 THEN 1.0 ELSE 0.0 END AS reward
FROM events e JOIN (VALUES {_ACT_VALUES}) AS a(event_type, action) ON a.event_type = e.event_type""")


def with_ctes(names: list[str], body: str, extra: bool = False) -> str:
    """WITH-chain of the named CTEs (dependencies first) + body. With
    ``extra`` the body starts with ", name AS (...)" continuing the chain."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n][1].strip()})" for n in order]
    sep = "\n" if extra else "\n"
    return "WITH " + ",\n".join(parts) + sep + body.strip()
