"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trustfold.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    got = registry.queries()[name](spark, FOLDER)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = tables.sql(sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
