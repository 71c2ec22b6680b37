"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from nearpath.plans import files  # noqa: F401
from nearpath.plans import queries as search

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if hasattr(v, "__float__") else str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(norm(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(search.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(search.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(search.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
