"""Queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from quarrylight.llm import registry

from .util import oracle, rows, same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert same(rows(registry.QUERIES[name](spark, sf_dir)), oracle(registry.SQL[name], sf_dir))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
