"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

import importlib

FLAGSHIP = "top_domains"
QUERIES: dict = {}
SQL: dict = {}
for _name in ("skew_queries", "analytics_queries", "url_queries", "frontier_queries", "similarity_queries", "content_queries", "event_queries"):
    _module = importlib.import_module(f"skeinwork.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
