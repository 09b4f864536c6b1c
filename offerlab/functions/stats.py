"""Exact order statistics without gathering a column in one place.

``percentile``/``median`` keep a value->count map of the whole column in
one final aggregation buffer, which does not scale for continuous values.
Here the k-th smallest value is found digit by digit: a double maps to a
64-bit integer of the same order, and four passes each count its next 16
bits among the rows that share the digits found so far. A pass returns at
most 65,536 counts per wanted rank, whatever the table's size, and ties,
hot values and any distribution take the same four passes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from offerlab.session import cut_lineage

DIGITS, BITS = 4, 16
SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one value."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def from_ordered(bits: int) -> float:
    b = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([b], dtype=np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, ranks: dict[str, Iterable[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} of 0-based ranks among a column's values (NULL
    and NaN ignored); a rank beyond the values is left out."""
    columns = list(ranks)
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    open_ranks = {(i, k): (0, int(k)) for i, c in enumerate(columns) for k in set(ranks[c])}  # found digits, rank among those left
    for digit in range(DIGITS):
        shift = np.uint64(64 - BITS * (digit + 1))
        wanted = sorted({(i, found) for (i, _), (found, _) in open_ranks.items()})

        def count(batches, wanted=wanted, shift=shift, first=digit == 0):
            sums = [np.zeros(1 << BITS, dtype=np.int64) for _ in wanted]
            for batch in batches:
                for total, (i, found) in zip(sums, wanted):
                    x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    bits = ordered_bits(x[~np.isnan(x)]) >> shift
                    if not first:
                        bits = bits[bits >> np.uint64(BITS) == np.uint64(found)]
                    total += np.bincount((bits & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
            for at, total in enumerate(sums):
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at)), pa.array(some), pa.array(total[some])], ["at", "digit", "n"])

        counts = values.mapInArrow(count, "at long, digit long, n long").groupBy("at", "digit").agg(F.sum("n").alias("n")).toPandas()
        tables = {wanted[at]: g.sort_values("digit") for at, g in counts.groupby("at")}
        for key, (found, left) in list(open_ranks.items()):
            table = tables.get((key[0], found))
            ends = table["n"].cumsum().to_numpy() if table is not None else np.zeros(0)
            at = int(np.searchsorted(ends, left, side="right"))
            if at == len(ends):
                del open_ranks[key]
                continue
            open_ranks[key] = (found << BITS | int(table["digit"].iloc[at]), left - int(ends[at - 1] if at else 0))
    return {(columns[i], k): from_ordered(found) for (i, k), (found, _) in open_ranks.items()}


def kth_smallest(df: DataFrame, col: str, k: int) -> float | None:
    """0-based k-th smallest non-null value of ``col``."""
    return order_statistics(df, {col: [k]}).get((col, k))


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """Medians of several columns as pandas defines them: the middle value,
    or the mean of the two middle values for an even count."""
    valid = [F.col(c).cast("double") for c in cols]
    sizes = df.agg(*[F.count(F.when(~F.isnan(v), v)).alias(f"n{i}") for i, v in enumerate(valid)]).first()
    middle = {c: ((n - 1) // 2, n // 2) for c, n in zip(cols, sizes) if n}
    found = order_statistics(df, middle)
    return {c: (found[c, middle[c][0]] + found[c, middle[c][1]]) / 2.0 if c in middle else None for c in cols}


def exact_auc(df: DataFrame, score: str, label: str, partitions: int | None = None) -> DataFrame:
    """One row (auc, positives, negatives): the share of (positive, negative) pairs that the score orders rightly, ties half.

    Equal scores are counted together first, then range-partitioned; a
    partition adds the negatives of those before it to its running count. NULL
    and NaN scores and NULL labels do not count; without both classes auc is
    NULL.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = F.col(score).cast("double")
    some = df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).select((s + F.lit(0.0)).alias("s"), (F.col(label) > 0).cast("long").alias("p"))
    tied = some.groupBy("s").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q"))
    placed = cut_lineage(tied.repartitionByRange(n, "s").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("q").alias("q"))  # a row per partition
    earlier = totals.select("part", F.coalesce(F.sum("q").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = placed.withColumn("below", inside).join(F.broadcast(earlier), "part")
    wide = lambda c: c.cast("decimal(18,0)")
    twice = F.sum(wide(F.col("p")) * wide(2 * (F.col("below") + F.col("earlier")) + F.col("q")))
    out = below.agg(twice.alias("t"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    pairs = wide(F.col("positives")) * wide(F.col("negatives"))
    return out.select(F.when(pairs > 0, F.col("t").cast("double") / (2 * pairs).cast("double")).alias("auc"),
                      F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_medians(df, [col])[col]
