"""Every query with SQL against DuckDB on the smallest tables, and the contract's functions."""

from __future__ import annotations

import pytest
from oracle import duck_rows, rows_of

import __spark_entry__ as entry
from contextloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    columns, expected = duck_rows(catalogue.SQL[name], small)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_without_sql_has_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
