"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OWN = set(entry._extra()[0])  # those have their own tests in tests/llm
QUERIES = {name: query for name, query in entry.queries().items() if name not in OWN}
SQL = {name: text for name, text in entry.oracle_sql().items() if name not in OWN}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
