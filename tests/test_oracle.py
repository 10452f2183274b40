"""Every query with a SQL twin against DuckDB on the smallest tables."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 200
