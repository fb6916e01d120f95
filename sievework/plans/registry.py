"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("report", "tabular", "catalog", "documents")


def load() -> tuple[dict, dict[str, str]]:
    queries: dict = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"sievework.plans.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
