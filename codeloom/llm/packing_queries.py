"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import packing
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table
from codeloom.storage import Scratch

R = Registry()


@R.query("p7_packs")
def p7_packs(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


@R.query("p7_fill")
def p7_fill(spark, d):
    return packing.summary(p7_packs(spark, d))


@R.query(
    "p7_whole",
    """select pack_name, (select count(distinct doc_id) from documents) documents, 0 overfull_packs, 0 broken_documents, 0 needless_splits
    from pack_sizes where pack_name is not null and capacity_tokens > 0""",
)
def p7_whole(spark, d):
    """What must hold of the packs, from the packs themselves and the documents' own token counts.

    Every document is in the packs of each size, no pack is above its capacity, the pieces of a document follow each other without gap or
    overlap and hold all its tokens, and only documents above the capacity have several.
    """
    packs = p7_packs(spark, d)
    docs = packing.sizes(table(spark, d, "documents"), Scratch(spark)).select(F.col("doc_id").alias("_d"), F.col("n_tokens").alias("true"))
    packs = Scratch(spark).save(packs)
    full = packs.groupBy("pack_name", "capacity", "pack_id").agg(F.sum("n_tokens").alias("t")).groupBy(F.col("pack_name").alias("_p")).agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull_packs"))
    end = F.max(F.col("start_token") + F.col("n_tokens"))
    each = packs.groupBy("pack_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("held"), F.min("start_token").alias("first"), end.alias("end"), F.count_distinct("start_token").alias("starts"))
    each = each.join(docs, F.col("doc_id") == F.col("_d"), "full")
    whole = (F.col("held") == F.col("true")) & (F.col("first") == 0) & (F.col("end") == F.col("true")) & (F.col("starts") == F.col("pieces"))
    rows = each.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.coalesce(whole, F.lit(False))).alias("broken_documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("true") <= F.col("capacity"))).alias("needless_splits"),
    )
    return rows.join(full, F.col("pack_name") == F.col("_p")).select("pack_name", "documents", "overfull_packs", "broken_documents", "needless_splits")
