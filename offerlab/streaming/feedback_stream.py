"""J6 / T19 streaming: router feedback as a Structured Streaming query.

Feedback events stream in (files here); per router key the state store holds
the fold's 20 numbers and the events that the watermark has not passed yet.
When the watermark passes (new data of the key, or its event-time timeout)
the waiting events up to it are folded in (event time, event id) order and
their rows come out; later ones keep waiting. An event at or before the time
already folded comes out at once with the reason ``late`` and changes
nothing. So the result equals the batch fold however files and rows are
ordered, as long as no event is later than the watermark's delay.

Rows go to a Parquet table on shared storage, never through the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from offerlab.config import DEFAULT_PARAMS, POLICY_ORDER, Params
from offerlab.operators.feedback_fold import COLUMNS, FOLD_SCHEMA, N, STATE_COLUMNS, KeyFold, prepared

EVENT_SCHEMA = ("router_key string, event_time timestamp, event_id long, policy string, "
                "metric_value double, baseline double")
WAITING = ["event_time", "event_id", "policy", "i", "metric_value", "baseline", "advantage", "clipped_advantage"]
STATE_SCHEMA = ("numbers array<double>, folded long, times array<long>, ids array<long>, policies array<string>, indexes array<int>, "
                "metrics array<double>, baselines array<double>")


def _micros(times: pd.Series) -> pd.Series:
    return (times - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)


def _fold_group(params: Params):
    clip = params.feedback_clip

    def shown(key, rows: pd.DataFrame, reason=None) -> pd.DataFrame:
        ok = rows["i"].notna() if reason is None else pd.Series(False, index=rows.index)
        refused = reason or ("invalid_policy" if params.feedback_enabled else "disabled")
        out = rows.assign(router_key=key, enabled=ok, reason=[None if x else refused for x in ok])
        for c in ("metric_value", "baseline", "advantage", "clipped_advantage", *[c for c in STATE_COLUMNS if not c.startswith("bias_")]):
            out[c] = out[c].astype(object).where(ok, None) if c in out else None
        for p in POLICY_ORDER:
            out[f"bias_{p}"] = out[f"bias_{p}"] if f"bias_{p}" in out else None
        return out[COLUMNS]

    def run(key, batches, state):
        numbers, folded, *lists = state.get if state.exists else ([0.0] * (4 * N), -(1 << 62), [], [], [], [], [], [])
        waiting = [pd.DataFrame(dict(zip(("event_time", "event_id", "policy", "i", "metric_value", "baseline"),
                                         (pd.to_datetime(pd.Series(lists[0], dtype="int64"), unit="us"), *[pd.Series(x, dtype=object) for x in lists[1:]]))))]
        if not state.hasTimedOut:
            waiting += [b[["event_time", "event_id", "policy", "i", "metric_value", "baseline"]] for b in batches]
        rows = pd.concat([w for w in waiting if len(w)], ignore_index=True) if any(map(len, waiting)) else waiting[0]
        rows["advantage"] = rows["metric_value"].astype(float) - rows["baseline"].astype(float)
        rows["clipped_advantage"] = rows["advantage"].clip(-clip, clip)
        at = _micros(rows["event_time"])
        passed = state.getCurrentWatermarkMs() * 1000
        late, due = at <= folded, (at > folded) & (at < passed)
        if late.any():
            yield shown(key[0], rows[late], "late")
        if due.any():
            fold = KeyFold(params, numbers)
            yield shown(key[0], fold.rows(rows[due].sort_values(["event_time", "event_id"])))
            numbers, folded = fold.state.ravel().tolist(), int(at[due].max())
        left = rows[~late & ~due]
        lists = [at[left.index].tolist(), *[[None if pd.isna(x) else x for x in left[c]] for c in ("event_id", "policy", "i", "metric_value", "baseline")]]
        lists[3] = [None if x is None else int(x) for x in lists[3]]
        state.update((list(map(float, numbers)), folded, *lists))
        if len(left):
            state.setTimeoutTimestamp(max(int(at[left.index].min()) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return run


def feedback_stream(events: DataFrame, params: Params = DEFAULT_PARAMS, watermark: str = "1 hour") -> DataFrame:
    """Streaming DataFrame of folded feedback (append mode). Watermarks need
    a zoned TIMESTAMP, so a TIMESTAMP_NTZ event time is read as session-zone
    time. An event waits in the state until the watermark passes it."""
    ready = prepared(events.withColumn("event_time", F.col("event_time").cast("timestamp")), params)
    return (ready.drop("advantage", "clipped_advantage").withWatermark("event_time", watermark).groupBy("router_key")
            .applyInPandasWithState(_fold_group(params), FOLD_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


def run_feedback_stream(spark: SparkSession, source_dir: str, checkpoint: str, sink_dir: str, params: Params = DEFAULT_PARAMS,
                        max_files: int = 1, watermark: str = "1 hour") -> DataFrame:
    """Drive the stream to completion over the files present (availableNow)
    into a Parquet table; events that the watermark has not passed stay in
    the state for the next run on the same checkpoint."""
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    q = (feedback_stream(src, params, watermark).writeStream.format("parquet").option("path", sink_dir)
         .outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(FOLD_SCHEMA).parquet(sink_dir)
