"""Registered operator queries against their DuckDB statements."""

import pytest

from accesslens.llm.queries import LLM_ORACLES, LLM_QUERIES
from verification.compare import differences, duckdb_tables


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_matches_statement(name, spark, sf_dir):
    assert differences(LLM_QUERIES[name](spark, sf_dir), duckdb_tables(sf_dir), LLM_ORACLES[name]) is None


def test_every_statement_has_a_query():
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)
