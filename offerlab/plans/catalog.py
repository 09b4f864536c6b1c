"""Registered queries: one per operator group of the inventory, each with
(where expressible) an equivalent DuckDB oracle query.

Every query reads the whole driver tables under ``sf_dir`` (no id subsets,
no row caps except where a limit is the feature itself), and emits plain
scalar columns with doubles rounded to 6 decimals so that results hash the
same in both engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from offerlab.plans.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = scaled_round_sql(oracle)
        return fn
    return deco


def scaled_round_sql(sql: str, digits: int = 6) -> str:
    """Rewrite ``round(x, 6)`` into ``round(x * 1e6) / 1e6 + 0.0``.

    Both engines then round the same binary product half-away-from-zero,
    which agrees bit for bit (rounding at a decimal digit does not: one
    engine rounds the shortest decimal text, the other the binary value),
    and ``+ 0.0`` turns a negative zero into zero.
    """
    token = "round("
    tail = f", {digits})"
    out, i = [], 0
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            break
        depth, k = 0, j + len(token) - 1
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + len(token):k]
        if sql[j:k + 1].endswith(tail) and (j == 0 or not (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            arg = inner[: len(inner) - len(tail) + 1]
            arg = scaled_round_sql(arg, digits)
            scale = f"{10 ** digits}.0"
            out.append(sql[i:j] + f"(round(({arg}) * {scale}) / {scale} + 0.0)")
        else:
            out.append(sql[i:j + len(token)])
            k = j + len(token) - 1
        i = k + 1
    return "".join(out)


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, render timestamps as text, ints as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            scale = float(10 ** digits)
            c = F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {col}"


# Registration modules append to QUERIES / ORACLES on import.
from offerlab.plans import q_customers, q_bandit, q_router, q_offers, q_text_models  # noqa: E402,F401
