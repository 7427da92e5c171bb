"""The driver's contract, and every query with SQL against it on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import bag


def test_entry(spark):
    assert entry.entry(spark).columns == ["upload_id", "role", "kind", "from_at", "to_at"]


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, small, con, name):
    got, want = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
