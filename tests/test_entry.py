"""Queries stay when the optional training-data operators cannot be imported."""

import sys

import __spark_entry__ as entry
from sievework.plans import registry


def test_queries_without_the_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sievework.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sievework.llm", None)  # as if it, or what it needs, were not there
    assert set(entry.queries()) == set(registry.load()[0]) and set(entry.oracle_sql()) == set(registry.load()[1])
