"""Connected components of an edge table, by alternating stars.

Large star: every node sends its larger neighbours to its smallest one; small
star: every node sends its smaller neighbours to the smallest of them. Both
are joins and grouped minima, so a hub's edges are spread over tasks (minima
combine before the shuffle, the join side may be split). Each round is
written to the shared folder; rounds end when no edge changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerlab.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # u: the larger end
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = (joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable."""
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where(F.col("a") != F.col("b")).distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    last = mark(now)
    while True:
        now = written(_star(_star(now, True), False), "stars")
        new = mark(now)
        if new == last:
            break
        last = new
    # every edge now goes from a node to its component
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
