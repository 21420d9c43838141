"""Every query against its SQL twin on the smallest tables, and the entry point."""

from __future__ import annotations

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def shown(v) -> str:
    if isinstance(v, (list, dict)):
        return str(v)
    if pd.isna(v):
        return "NULL"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return repr(round(float(v), 9)) if isinstance(v, numbers.Number) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = entry_point.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry_point.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert entry_point.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 4
