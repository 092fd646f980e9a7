"""All queries of the subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
for _name in ("queries_a", "queries_b", "queries_c", "queries_d"):
    _module = importlib.import_module(f"skeinwork.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
