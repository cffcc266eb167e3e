"""Every registered query against its SQL equivalent in DuckDB, on the smallest folder of tables."""

import datetime as dt
import decimal
import os
import time

import duckdb
import pytest

import __spark_entry__ as entry
from pactlake.sources.derived import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    os.environ["TZ"] = "UTC"
    time.tzset()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool):
        return str(round(float(x), 6))
    return "~" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    place = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    entry.queries()[name](spark, SF).collect()
