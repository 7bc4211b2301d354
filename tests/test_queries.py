"""Every registered query with SQL equals it; the others run with rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from skyloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def plain(rows):
    return sorted(repr(tuple(v + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = sql.execute(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]}) q").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["x", "y", "gre", "gim", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
