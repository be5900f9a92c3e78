"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from strandwork.plans import registry

NAMES = sorted(registry.SQL)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(v):
    return None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    df, sql = registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    expected = sorted((tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall()), key=repr)
    assert found == expected


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_needs_no_session():
    """The entry module is read before any session exists."""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
