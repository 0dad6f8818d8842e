"""Every registered query against its DuckDB statement."""

import importlib

import pytest

from verification.compare import differences, duckdb_tables, ordered

entry = importlib.import_module("__spark_entry__")
# The training-data queries are tested in their own folder.
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def tables(sf_dir):
    return duckdb_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_statement(name, spark, sf_dir, tables):
    sql = ORACLES[name]
    assert differences(QUERIES[name](spark, sf_dir), tables, sql, in_order=name.startswith(("q", "lookup")) and ordered(sql)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_no_statement_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
