"""Registered queries against their SQL, over whole small tables."""

import pytest

from tests.oracle import same
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, data, name):
    same(registry.QUERIES[name](spark, data), registry.SQL[name], data)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
