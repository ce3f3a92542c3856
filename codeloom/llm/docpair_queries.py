"""Queries of problem 6."""

from __future__ import annotations

from codeloom.llm import docpairs
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()


@R.query("p6_found")
def p6_found(spark, d):
    return docpairs.descriptions(table(spark, d, "nodes")).select("node_id")


@R.query("p6_pairs")
def p6_pairs(spark, d):
    return docpairs.documented(table(spark, d, "nodes"))
