"""Routing decisions and router feedback over arriving rounds.

Rounds arrive in files, each with the feedback that came of it. A round waits
until the watermark (latest event time seen, less ``delay``) has passed it;
then it is decided with the bias as of its time and its feedback is folded,
so any order within the delay gives the batch plan's result. Each micro-batch
runs the batch operators (prefix-sum fold, as-of join) on the rounds that are
due, so one hot router key is spread over all tasks; arriving rounds meet the
static profiles by a stream-static join. Between batches only two small
tables stay: the state (twenty numbers per router key) and the rounds of the
delay.

A round older than a watermark that has passed is decided with the bias as it
stands, marked late, and its feedback changes nothing. All tables of a batch
are written under its number and overwritten when it is retried, so a retry
changes nothing. ``finish`` decides what still waits at the end of a log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlab.config import DEFAULT_PARAMS, POLICY_ORDER, Params
from offerlab.operators.asof import asof_join
from offerlab.operators.feedback_fold import STATE_TABLE, bias_columns, continue_fold
from offerlab.session import cut_lineage

BIAS = [f"bias_{p}" for p in POLICY_ORDER]
FEEDBACK = ["router_key", "event_time", "event_id", "policy", "metric_value", "baseline"]


class DecisionStream:
    """One stream's tables under ``path``. ``profiles`` has one row per customer; ``decide`` adds the decision to rows with the bias columns."""

    def __init__(self, path: str, profiles: DataFrame, decide: Callable[[DataFrame], DataFrame], delay: str = "1 day", params: Params = DEFAULT_PARAMS):
        self.path, self.profiles, self.decide, self.delay, self.params = path, profiles, decide, delay, params

    def table(self, spark: SparkSession, name: str, batch: int | None = None) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}" + ("" if batch is None else f"/batch={batch}"))

    def _save(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _step(self, arrived: DataFrame | None, batch: int) -> None:
        """Decide and fold what is due after ``arrived`` (None: everything that waits)."""
        spark = arrived.sparkSession if arrived is not None else self.profiles.sparkSession
        if batch:
            state, waiting = self.table(spark, "state", batch - 1), self.table(spark, "waiting", batch - 1)
            before = self.table(spark, "watermark", batch - 1).first()["watermark"]
            rows = waiting if arrived is None else waiting.unionByName(arrived)
        else:
            state, before, rows = spark.createDataFrame([], STATE_TABLE), None, arrived
        if arrived is None:
            watermark = None
        else:
            seen = rows.agg((F.max("event_time") - F.expr(f"INTERVAL {self.delay}")).alias("w")).first()["w"]
            watermark = max(x for x in (before, seen) if x is not None) if before is not None or seen is not None else None
        rows = cut_lineage(rows)
        at = F.col("event_time")
        late = F.lit(False) if before is None else at < F.lit(before)
        open_ = F.lit(False) if arrived is None else (at >= F.lit(watermark)) if watermark is not None else F.lit(True)
        due = rows.where(~late & ~open_)
        folded, after = continue_fold(due.select(*FEEDBACK), state, self.params)
        self._save(folded, "folded", batch)
        folded = self.table(spark, "folded", batch)
        now = asof_join(due, folded, ("router_key", "event_time", "event_id"), ("router_key", "event_time", "event_id"), BIAS)
        old = rows.where(late).select("*", *[F.lit(None).cast("double").alias(c) for c in BIAS])
        both = now.withColumn("late", F.lit(False)).unionByName(old.withColumn("late", F.lit(True)))
        # what the batch began with: one row per router key
        start = state.select(F.col("router_key").alias("_key"), F.struct(*bias_columns()).alias("_start"))
        both = both.join(start, F.col("router_key").eqNullSafe(F.col("_key")), "left")
        both = both.withColumns({c: F.coalesce(F.col(c), F.col(f"_start.{c}"), F.lit(0.0)) for c in BIAS}).drop("_key", "_start")
        self._save(self.decide(both.join(self.profiles, "customer_unique_id", "left")), "decisions", batch)
        self._save(after, "state", batch)
        self._save(rows.where(~late & open_), "waiting", batch)
        self._save(spark.createDataFrame([(watermark,)], "watermark timestamp"), "watermark", batch)

    def run(self, spark: SparkSession, source: str, schema, max_files: int = 1) -> int:
        """Work through the files present (and only these); the number of the next batch."""
        last = {"batch": -1}

        def each(rows: DataFrame, batch: int) -> None:
            self._step(rows, batch)
            last["batch"] = batch

        query = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source).writeStream.foreachBatch(each)
                 .option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        return last["batch"] + 1

    def finish(self, batch: int) -> None:
        """The log has ended: decide and fold all that waits, as batch ``batch``."""
        if batch:
            self._step(None, batch)
