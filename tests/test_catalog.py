"""Every registered query against its oracle SQL, and a few rules about the registry."""

from __future__ import annotations

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
import catalog
from tests.conftest import SMALL
from tools.check import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cur.fetchall(), columns)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "ranking" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(inspect.signature(next(iter(QUERIES.values()))).parameters) == 2
    assert catalog.QUERIES
