"""All queries of the core library, and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ["problem1", "interval_queries", "cue_queries", "text_queries", "vector_queries", "choice_queries", "evidence_queries", "inventory_queries", "inventory_more"]


def collect(package: str, modules: list[str]) -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in modules:
        module = import_module(f"{package}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql


def core() -> tuple[dict, dict]:
    return collect("cuemill.plans", MODULES)
