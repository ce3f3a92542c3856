"""Queries of problem 9."""

from __future__ import annotations

from codeloom.llm import spam
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()


@R.query("p9_found")
def p9_found(spark, d):
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id")


@R.query("p9_shares")
def p9_shares(spark, d):
    return spam.page_shares(table(spark, d, "documents"))
