"""Answering requests from a stored decision table.

The decided rounds are written once as a table bucketed by their dense number
(0 to n - 1), so requests join to it without moving the log. A request names
a round; a number out of range gets one by a hash of the request.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlab.config import DEFAULT_PARAMS, POLICY_ORDER, Params
from offerlab.functions.hashing import pipe_key, stable_index
from offerlab.operators import router as T
from offerlab.operators.feedback import DIM, with_dense_index
from offerlab.session import ensure_checkpoint_dir


class DecisionTable:
    """Rounds numbered by round_id and bucketed by that number, in the shared folder."""

    def __init__(self, rounds: DataFrame, buckets: int | None = None):
        spark: SparkSession = rounds.sparkSession
        name = f"decisions_{uuid.uuid4().hex}"
        n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        (with_dense_index(rounds).withColumn("round_idx", F.col("round_idx").cast("long")).write.bucketBy(n, "round_idx").sortBy("round_idx")
         .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
        self.table = spark.table(name)
        self.rounds = self.table.count()

    def select(self, requests: DataFrame, asked: str = "asked", request: str = "request_id", params: Params = DEFAULT_PARAMS) -> DataFrame:
        """Requests with ``round_idx``: the number asked for, or (missing or out of range) one by hash of the request; and the round's row."""
        n = F.lit(self.rounds).cast("long")
        ok = F.col(asked).isNotNull() & (F.col(asked) >= 0) & (F.col(asked) < n)
        by_hash = stable_index(pipe_key(F.lit(str(params.seed)), F.col(request)), n).cast("long")
        return requests.withColumn("round_idx", F.when(ok, F.col(asked).cast("long")).otherwise(by_hash)).join(self.table, "round_idx")

    def wrapped(self, requests: DataFrame, asked: str = "asked") -> DataFrame:
        """The number asked for modulo the rounds, and the round's row."""
        return requests.withColumn("round_idx", F.pmod(F.col(asked).cast("long"), F.lit(self.rounds).cast("long"))).join(self.table, "round_idx")


def resolve_context(df: DataFrame, given: str, dim: int = DIM) -> DataFrame:
    """T4: x0..x6 from the request's array of texts where it has the right length and only finite numbers, else the round's own."""
    numbers = F.transform(F.col(given), lambda v: v.try_cast("double"))
    usable = F.coalesce((F.size(given) == dim) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return df.withColumn("_usable", usable).withColumn("_given", numbers).withColumns(
        {f"x{i}": F.when(F.col("_usable"), F.try_element_at("_given", F.lit(i + 1))).otherwise(F.col(f"x{i}")) for i in range(dim)}
    ).withColumnRenamed("_usable", "own_context").drop("_given")


def policy_scores(policy: Column, k: int) -> list[Column]:
    """The score vector of a suite policy (uplift, fusion, else contextual)."""
    return [F.when(policy == "uplift", F.col(f"u{a}")).when(policy == "fusion", F.col(f"f{a}")).otherwise(F.col(f"c{a}")).alias(f"score{a}") for a in range(k)]


def score_record(df: DataFrame) -> DataFrame:
    """What a decision reports: method, scores, router, and the logged action, reward and propensity (absent: -1, 0, 0)."""
    return df.select(
        "request_id", "round_id", F.col("policy").alias("method"), "selected_action", "policy_score", "top_actions",
        F.col("confidence").alias("router_confidence"), F.array_join("reasons", ",").alias("router_reasons"),
        *[F.col(f"cand{i}").alias(f"cand_{p}") for i, p in enumerate(POLICY_ORDER)],
        F.coalesce("action", F.lit(-1)).alias("logged_action"), F.coalesce("reward", F.lit(0.0)).alias("logged_reward"), F.coalesce("pscore", F.lit(0.0)).alias("logged_pscore"))


def report_of(names: DataFrame, report: DataFrame, name: str = "name", suite_only: bool = False) -> DataFrame:
    """E18 (suite names only), T18: the report of a policy by any of its names; a name without a report gets the contextual one's."""
    known = F.expr(T.normalize_policy_name(name) if suite_only else T.normalize_router_policy(name))
    with_report = ["contextual_bandit", "uplift", "fusion"] if suite_only else POLICY_ORDER
    asked = names.withColumn("policy", F.when(known.isin(with_report), known).otherwise(F.lit("contextual_bandit")))
    return asked.join(F.broadcast(report), "policy", "left")  # a row per policy
