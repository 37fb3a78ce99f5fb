"""Queries of the llm subpackage and the SQL of those that have any."""

from __future__ import annotations

from importlib import import_module

MODULES = [f"problem{n}" for n in range(2, 11)]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"cuemill.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
