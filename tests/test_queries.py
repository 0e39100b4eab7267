"""Every registered query against its SQL on the smallest tables."""

import threading

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

NAMES = sorted(entry.queries())
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    timer = threading.Timer(60, con.interrupt)
    timer.start()
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    timer.cancel()
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, want)


def test_check_sql_has_a_query():
    assert set(SQL) <= set(NAMES)


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["total_problems"] == 40 and 0 < row["complete_pct"] <= 100
