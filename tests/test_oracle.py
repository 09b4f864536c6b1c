"""DuckDB oracle agreement of every query that has oracle SQL, at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from offerlab.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
NAMES = sorted(ORACLES)


def _norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA"):
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    got = _rows(QUERIES[name](spark, SF_SMALL).toPandas())
    want = _rows(con.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "policy" in df.columns and "roi" in df.columns
