"""Every registered query against DuckDB on the smallest tables."""

import pytest

from sparktally.plans import QUERIES, SQL

from .oracle import agree


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, small, name):
    agree(QUERIES[name](spark, small), SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_is_stable(spark, small, name):
    first = sorted(map(str, QUERIES[name](spark, small).collect()))
    assert first
    assert first == sorted(map(str, QUERIES[name](spark, small).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
