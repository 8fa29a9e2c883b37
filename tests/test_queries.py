"""Every query with a DuckDB counterpart gives its rows, on the smallest tables."""

import os

import duckdb
import pytest

import siltstone.plans  # noqa: F401
from siltstone.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in registry.NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_match(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    answer = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    want = [dict(zip(names, row, strict=True)) for row in answer.fetchall()]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(row[c]) for c in columns) for row in want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(len(r) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
