"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import secrets
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()


@R.query("p2_found")
def p2_found(spark, d):
    return secrets.credentials(table(spark, d, "nodes")).select("node_id", "line_no").distinct()


@R.query("p2_redacted")
def p2_redacted(spark, d):
    return secrets.redacted(table(spark, d, "nodes"))


@R.query(
    "p2_offsets",
    """select id node_id, min(length(code_content)) length, min(length(code_content) - length(replace(code_content, chr(10), ''))) line_ends
    from nodes where id is not null and length(code_content) > 0 group by id""",
)
def p2_offsets(spark, d):
    """Length and line ends of every node's code after redaction: what replacing values in place must leave as it was."""
    nodes = table(spark, d, "nodes")
    after = secrets.redacted(nodes).select(F.col("node_id").alias("_n"), F.col("code_content").alias("_after"))
    own = nodes.where(F.col("id").isNotNull() & (F.length("code_content") > 0)).groupBy(F.col("id").alias("node_id")).agg(F.min(F.length("code_content")).alias("_len"), F.min(_line_ends(F.col("code_content"))).alias("_ends"))
    rows = own.join(after, F.col("node_id") == F.col("_n"), "left")
    return rows.select("node_id", F.coalesce(F.length("_after"), F.col("_len")).alias("length"), F.coalesce(_line_ends(F.col("_after")), F.col("_ends")).alias("line_ends"))


def _line_ends(c):
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
