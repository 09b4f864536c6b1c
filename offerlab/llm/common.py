"""Small helpers shared by the operators: table access, written intermediates."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlab.session import ensure_checkpoint_dir


#: Bytes of an Arrow batch between the JVM and Python; Spark's default lets a batch of texts take a large part of a worker's memory.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``; a lower limit that it has stays."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower()).groups()
    if not 0 < int(number) * 1024 ** " kmgt".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Ends the lineage in files that every executor can read, so losing an
    executor never recomputes what came before.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_ranges(sizes: list[int], limit: int):
    """(start, end) ranges over consecutive items so that each range's sizes sum to at most ``limit`` (single larger items alone)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Return a Python worker's freed memory to the system at a task's end: a worker stays and serves other stages, beside those of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of 2^bits slots (64-bit words) in which the hashes of a long column are set; its size does not grow with the rows."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (df.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow())
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes have their slot set."""
    slot = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def in_filter(hashes: DataFrame, bits: int):
    """A condition on a column of 64-bit hashes that holds for all of ``hashes`` (one long column) and for few others.

    Its size is fixed; beyond that it merely lets more pass.
    """
    shared = hashes.sparkSession.sparkContext.broadcast(bitmap_of(hashes, hashes.columns[0], bits))

    @F.pandas_udf("boolean")
    def run(some: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(some.to_numpy().view(np.uint64), shared.value))

    return run
