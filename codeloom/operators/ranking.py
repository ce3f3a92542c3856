"""Running sums and positions inside groups of any size, without one task per group.

A window over a hot key puts all its rows into one task. Here a group is cut into
buckets of about ``rows_per_bucket`` rows by a hash; sums per (group, bucket) are
taken with map-side combine, a window runs over the few buckets of a group, and a
second window over the rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame,
    keys: list[str],
    value: Column,
    order: list[Column],
    out: str,
    spread: Column | None = None,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys``.

    Rows are ordered by (bucket, ``order``); the bucket is a hash of ``spread``
    (default: the order columns), so the order inside a group is fixed but
    arbitrary when the group needs more than one bucket. Null keys form one group,
    null values count as 0. Empty input gives an empty result.
    """
    spread = F.xxhash64(*order) if spread is None else spread
    sizes = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    buckets = F.ceil(F.col("_n") / F.lit(rows_per_bucket)).cast("long")
    cut = (
        df.withColumn("_v", F.coalesce(value.cast("long"), F.lit(0)))
        .join(sizes, on, "inner")
        .withColumn("_b", F.pmod(spread, buckets))
        .drop("_n", *[f"_k{i}" for i in range(len(keys))])
    )
    per = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("_base", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"), "_base")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [*on, F.col("_b") == F.col("_bb")]
    return (
        cut.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(base, on, "inner")
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_v", "_b", "_bb", "_in", "_base", *[f"_k{i}" for i in range(len(keys))])
    )
