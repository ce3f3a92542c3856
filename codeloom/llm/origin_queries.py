"""Queries of problem 3."""

from __future__ import annotations

from codeloom.llm import origin
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()


@R.query("p3_found")
def p3_found(spark, d):
    return origin.origins(table(spark, d, "files"), table(spark, d, "nodes")).select("file_id")


@R.query("p3_reasons")
def p3_reasons(spark, d):
    return origin.origins(table(spark, d, "files"), table(spark, d, "nodes"))
