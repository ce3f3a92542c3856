"""All queries of the core library."""

from __future__ import annotations

from codeloom.plans import graph_queries, hierarchy, search_queries, usage_queries
from codeloom.plans.registry import Query

_MODULES = [graph_queries, search_queries, usage_queries, hierarchy]


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.R.sql.items()}
