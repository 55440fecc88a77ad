"""Every query with a SQL twin against DuckDB on the smallest test data; every other one runs and keeps its schema."""

import collections
import datetime as dt
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TESELA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v.isoformat() if isinstance(v, (dt.datetime, dt.date)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


# models whose operators tests/test_models.py tries on planted signals; here a few run on the tables
SLOW = ("fit_", "classify_", "forest_")
PLAIN = sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith(SLOW))


@pytest.mark.parametrize("name", [*PLAIN, "fit_poisson", "classify_logistic", "fit_tree_sizes"])
def test_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
