"""Every query that SQL can express equals its SQL; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from calibra.plans.catalog import ORACLES, QUERIES, flagship

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


def plain(x):
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str([plain(y) for y in x.tolist()])
    if isinstance(x, list):
        return str([plain(y) for y in x])
    if pd.isna(x):
        return None
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(frame: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_has_a_schema(spark):
    assert flagship(spark, SF).columns
