"""Recency / frequency / monetary features and segments."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlab.config import DEFAULT_PARAMS, SEGMENTS, Params, SegmentThresholds
from offerlab.session import cut_lineage
from offerlab.sources.tables import MONEY

RFM_FEATURES = ["recency", "frequency", "monetary", "avg_order_value"]
#: Most steps of a k-means start.
KMEANS_STEPS = 30


def reference_date(completed: DataFrame) -> Column:
    """B1: max purchase time + 1 day, as a scalar subquery (computed once,
    inlined into the consuming plan; no join)."""
    return completed.select(
        (F.max("order_purchase_timestamp") + F.expr("INTERVAL 1 DAY")).alias("ref")).scalar()


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days (floor of the time difference, trap X1)."""
    return F.timestamp_diff("DAY", start, end).cast("int")


def rfm_features(completed: DataFrame) -> DataFrame:
    """B2 + B3: one row per customer_unique_id; NULL customers dropped.

    An order counts once however often its row is repeated.
    """
    ref = reference_date(completed)
    per = (
        completed.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.max("order_purchase_timestamp").alias("last_purchase"),
            F.min("order_purchase_timestamp").alias("first_purchase"),
            F.countDistinct("order_id").alias("frequency"),
            F.sum(F.col("order_total").cast(MONEY)).alias("_m"),
            F.count("order_total").alias("_n_total"),
            F.coalesce(F.sum("item_count"), F.lit(0)).alias("total_items"),
            F.avg("item_count").alias("avg_items_per_order"),
        )
    )
    monetary = F.coalesce(F.col("_m"), F.lit(0).cast(MONEY)).cast("double")
    return per.select(
        "customer_unique_id",
        whole_days(F.col("last_purchase"), ref).alias("recency"),
        "frequency",
        monetary.alias("monetary"),
        F.when(F.col("_n_total") > 0, monetary / F.col("_n_total")).alias("avg_order_value"),
        "total_items",
        "avg_items_per_order",
        "first_purchase",
        "last_purchase",
        whole_days(F.col("first_purchase"), F.col("last_purchase")).alias("customer_lifetime"),
    )


def standardize(df: DataFrame, features=RFM_FEATURES, suffix: str = "_z") -> DataFrame:
    """Z-score with population std; zero std divides by 1. NULL stays
    NULL. The moments are one scalar aggregate (scalar subqueries)."""
    stats = df.select(F.struct(*[F.avg(c).alias(f"mu_{c}") for c in features],
                               *[F.stddev_pop(c).alias(f"sd_{c}") for c in features])).scalar()
    out = df
    for c in features:
        mu = stats[f"mu_{c}"]
        sd = stats[f"sd_{c}"]
        sd1 = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - mu) / sd1)
    return out


def segment_ladder(recency: Column, frequency: Column, monetary: Column,
                   t: SegmentThresholds = SegmentThresholds()) -> Column:
    """B7/B9 ladder; first rung that matches wins; NULL compares false."""
    r, f, m = recency, frequency, monetary
    return (
        F.when((r < t.loyal_recency) & (f > t.loyal_frequency) & (m > t.loyal_monetary), F.lit(SEGMENTS[0]))
        .when((r < t.growth_recency) & (f > t.growth_frequency) & (m > t.growth_monetary), F.lit(SEGMENTS[1]))
        .when((r < t.new_recency) & (f == t.new_frequency), F.lit(SEGMENTS[2]))
        .when((r < t.regular_recency) & (m > t.regular_monetary), F.lit(SEGMENTS[3]))
        .otherwise(F.lit(SEGMENTS[4]))
    )


def rule_segments(rfm: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The ladder applied to each customer row."""
    return rfm.withColumn(
        "user_segment",
        segment_ladder(F.col("recency"), F.col("frequency"), F.col("monetary"), params.thresholds))


def segment_mix(segmented: DataFrame, col: str = "user_segment") -> DataFrame:
    """Customers per segment (partial + final hash aggregate)."""
    return segmented.groupBy(col).agg(F.count(F.lit(1)).alias("customers"))


# ---------------------------------------------------------------------------
# K-means segmentation
# ---------------------------------------------------------------------------

def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, its squared distance) per start and row; ties go to the smaller number."""
    d = ((x[None, :, None, :] - centres[:, None, :, :]) ** 2).sum(axis=3)
    best = d.argmin(axis=2)
    return best, np.take_along_axis(d, best[:, :, None], 2)[:, :, 0]


def kmeans_starts(rows: DataFrame, columns: list[str], key: str, k: int, starts: int, seed: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, costs) of several k-means starts that advance together: (starts, k, columns) and (starts).

    Start r begins with the k rows of least md5(seed|r|key). A step is one
    pass: each task assigns its rows for all starts and sends starts x k sums,
    which one aggregate adds up. A centre without rows stays where it is.
    Ends after ``steps`` steps, or when no centre moves.
    """
    x_of = lambda batch: np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(columns))])
    table = rows.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])

    def first(batches):
        for batch in batches:
            keys, x = batch.column(0).to_pylist(), x_of(batch)
            for r in range(starts):
                places = [hashlib.md5(f"{seed}|{r}|{i}".encode()).hexdigest() for i in keys]
                at = sorted(range(len(keys)), key=places.__getitem__)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(at), pa.int32()), pa.array([places[i] for i in at], pa.string()),
                                                  pa.array([x[i].tolist() for i in at], pa.list_(pa.float64()))], ["start", "place", "x"])

    found = table.mapInArrow(first, "start int, place string, x array<double>")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("place"))).where(F.col("n") <= k).collect()  # starts x k rows
    if len(found) < starts * k:
        raise ValueError(f"fewer than {k} complete rows")
    centres = np.array([r["x"] for r in sorted(found, key=lambda r: (r["start"], r["n"]))]).reshape(starts, k, len(columns))
    for step in range(steps + 1):
        def sums(batches, centres=centres):
            total, count, cost = np.zeros(centres.shape), np.zeros(centres.shape[:2]), np.zeros(starts)
            for batch in batches:
                x = x_of(batch)
                best, d = _nearest(x, centres)
                for r in range(starts):
                    np.add.at(total[r], best[r], x)
                    count[r] += np.bincount(best[r], minlength=k)
                cost += d.sum(axis=1)
            flat = np.concatenate([total.ravel(), count.ravel(), cost])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

        added = table.mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at").column("value").to_numpy()
        total, rest = added[:centres.size].reshape(centres.shape), added[centres.size:]
        count, cost = rest[:starts * k].reshape(starts, k), rest[starts * k:]
        new = np.where(count[:, :, None] > 0, total / np.maximum(count, 1)[:, :, None], centres)
        if step == steps or (new == centres).all():
            return centres, cost
        centres = new
    return centres, cost


def kmeans_segments(rfm: DataFrame, params: Params = DEFAULT_PARAMS, restarts: int | None = None, steps: int = KMEANS_STEPS):
    """Standardise, k-means (of several starts the one of least cost,
    to six decimals), name clusters from their feature means with the ladder,
    map names back.

    Rows with a NULL feature cannot be clustered (the source would fail);
    they are kept with cluster NULL and segment from the per-row ladder.
    Returns (segmented DataFrame, info dict with costs and centres).
    """
    z = cut_lineage(standardize(rfm))
    zcols = [f"{c}_z" for c in RFM_FEATURES]
    incomplete = F.expr(" OR ".join(f"{c} IS NULL" for c in zcols))
    complete = z.where(~incomplete)
    starts = max(1, params.kmeans_restarts if restarts is None else restarts)
    centres, costs = kmeans_starts(complete, zcols, "customer_unique_id", params.n_clusters, starts, params.kmeans_seed, steps)
    best = int(np.argmin(np.round(costs, 6)))
    far = F.array(*[sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(zcols[1:], centre[1:])),
                        (F.col(zcols[0]) - F.lit(float(centre[0]))) * (F.col(zcols[0]) - F.lit(float(centre[0])))) for centre in centres[best]])
    clustered = complete.withColumn("_far", far).withColumn("cluster", F.array_position("_far", F.array_min("_far")).cast("int") - 1).drop("_far")
    # Cluster means (k rows), B7: name each cluster from its means.
    means = clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in RFM_FEATURES])
    names = means.select(
        "cluster",
        segment_ladder(F.col("recency"), F.col("frequency"), F.col("monetary"), params.thresholds)
        .alias("cluster_segment"))
    # K-row table, broadcast by construction (k = n_clusters).
    out = clustered.join(F.broadcast(names), "cluster", "left")
    dropped = z.where(incomplete)
    dropped = dropped.withColumn("cluster", F.lit(None).cast("int")).withColumn(
        "cluster_segment",
        segment_ladder(F.col("recency"), F.col("frequency"), F.col("monetary"), params.thresholds))
    result = out.unionByName(dropped).withColumn("cluster", F.col("cluster").cast("int")) \
        .withColumnRenamed("cluster_segment", "user_segment").drop(*zcols)
    return result, {"costs": costs.tolist(), "best_cost": float(costs[best]), "centres": centres[best]}
