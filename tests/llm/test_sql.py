"""Queries with an SQL text against DuckDB, on the smallest tables."""

import pytest

from oracle import compare, connect
from sievework.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    assert compare(registry.QUERIES[name](spark, SF_DIR), connect(SF_DIR), registry.SQL[name]) is None
