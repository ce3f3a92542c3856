"""Queries of this subpackage and their SQL; the entry module adds them where this imports."""

from __future__ import annotations

from importlib import import_module

from codeloom.plans.registry import Query

_NAMES = ["secret_queries", "origin_queries", "term_queries", "similar_queries", "docpair_queries", "packing_queries", "mixture_queries", "spam_queries"]


def _modules():
    out = []
    for n in _NAMES:
        try:
            out.append(import_module(f"codeloom.llm.{n}"))
        except ModuleNotFoundError as e:
            if e.name != f"codeloom.llm.{n}":
                raise
    return out


def queries() -> dict[str, Query]:
    return {k: v for m in _modules() for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.R.sql.items()}
