"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from taleweave.plans import catalog, registry
from taleweave.sources.fixtures import RAW

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return "-" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(tuple(plain(v) for v in row) for row in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(registry.SLOW_SQL))
def test_same_rows_of_slow_sql(name, spark, duck, monkeypatch):
    monkeypatch.setitem(catalog.ORACLES, name, registry.SLOW_SQL[name])
    test_same_rows(name, spark, duck)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - set(registry.SLOW_SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
