"""Every query with SQL gives DuckDB's rows on a small scale."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from imgaudit.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return str(x) if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_the_oracles(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
