"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import mixture
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table
from codeloom.storage import Scratch

R = Registry()


@R.query("p8_mix")
def p8_mix(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@R.query("p8_shares")
def p8_shares(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@R.query(
    "p8_limits",
    """select source, max(target_share) target_share, true share_met, 0 foreign_documents, 0 overused_documents, 0 repeated_rows
    from mix_targets where source is not null group by source""",
)
def p8_limits(spark, d):
    """What must hold of the mixture, counted from the chosen documents: shares within 0.001 of their targets, no document beyond its source's limit, none of another source, none twice.

    A source without tokens, or with a target of zero, meets its share with none.
    """
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    chosen, _ = mixture.mix(docs, targets)
    chosen = Scratch(spark).save(chosen)
    total = max(chosen.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0, 1)
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("_d"), F.col("source").alias("_own")).distinct()
    rows = chosen.join(own, (F.col("doc_id") == F.col("_d")) & F.col("source").eqNullSafe(F.col("_own")), "left")
    limits = targets.where("source is not null").groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("_s", "t.*")
    rows = rows.join(limits, F.col("source") == F.col("_s"), "left")
    twice = chosen.groupBy("source").agg((F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated_rows")).withColumnRenamed("source", "_r")
    got = rows.groupBy(F.col("source").alias("_g")).agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count_if(F.col("_d").isNull()).alias("foreign_documents"), F.count_if(F.col("repeats") > F.col("max_repeats")).alias("overused_documents")
    )
    out = limits.join(got, F.col("_s") == F.col("_g"), "left").join(twice, F.col("_s") == F.col("_r"), "left")
    zero = F.lit(0).cast("long")
    met = F.abs(F.coalesce("tokens", zero) / F.lit(total) - F.col("target_share")) <= 0.001
    return out.select(F.col("_s").alias("source"), "target_share", met.alias("share_met"), *[F.coalesce(c, zero).alias(c) for c in ("foreign_documents", "overused_documents", "repeated_rows")])
