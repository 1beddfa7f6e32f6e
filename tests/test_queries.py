"""Every query with SQL against DuckDB on the smallest tables; the others run and have a stable schema."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
