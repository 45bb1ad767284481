"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from talelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in registry.ORACLES:
        assert got
    else:
        want = oracle.sql(registry.ORACLES[name])
        places = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[p]) for p in places) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
