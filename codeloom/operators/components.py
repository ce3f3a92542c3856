"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.storage import Scratch


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``pairs``; the component is its smallest node.

    Alternating large-star and small-star rounds: each is one group minimum (map-side
    combine) and one join, the number of rounds is logarithmic in practice, and no
    group is gathered in a task. Null ends and self pairs only keep their node; an
    empty input gives no rows.
    """
    scratch = Scratch(pairs.sparkSession)
    raw = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = scratch.save(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = scratch.save(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    edges = edges.where("u <> v")
    last = None
    while True:
        # large star: neighbours above a node point to the least of its closed neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct())
        # small star: a node and its neighbours below point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        down = large.join(least, F.col("u") == F.col("_u"))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        new = scratch.save(small.where("u <> v").distinct(), replaces=large)
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = new
        if now == last:
            break
        last = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
