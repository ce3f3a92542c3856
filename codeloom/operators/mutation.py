"""Snapshot updates as joins (inventory B): a new state is a query over the old one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.graph import Graph


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) with status new, changed or deleted, by path and content hash; equal files are left out."""
    a = old.select(F.col("path").alias("_a"), F.col("content_hash").alias("_ha"))
    b = new.select(F.col("path").alias("_b"), F.col("content_hash").alias("_hb"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(~F.col("_ha").eqNullSafe(F.col("_hb")), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias("path"), status.alias("status")).where("status is not null")


def upsert(old: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``changed`` in place of those with the same keys."""
    k = changed.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return old.join(k, on, "left_anti").unionByName(changed.select(*old.columns))


def delete_files(g: Graph, gone: DataFrame) -> Graph:
    """The graph without the files of the given paths (column path), their nodes, vectors, and the edges at either end."""
    files = g.files.join(gone.select(F.col("path").alias("_p")).distinct(), F.col("path") == F.col("_p"), "left_anti")
    kept = files.select(F.col("file_id").alias("_f"))
    nodes = g.nodes.join(kept, F.col("file_id") == F.col("_f"), "left_semi")
    alive = nodes.select(F.col("id").alias("_n"))
    edges = g.edges.join(alive, F.col("source_id") == F.col("_n"), "left_semi").join(alive, F.col("target_id") == F.col("_n"), "left_semi")
    vectors = None if g.vectors is None else g.vectors.join(alive, F.col("node_id") == F.col("_n"), "left_semi")
    return replace(g, files=files, nodes=nodes, edges=edges, vectors=vectors, raw_nodes=None)


def add_edges(g: Graph, more: DataFrame) -> DataFrame:
    """The edges with those of ``more`` (source_id, target_id, relation, metadata) that are not there yet; new ids are hashes of the key."""
    key = ["source_id", "target_id", "relation", "metadata"]
    fresh = more.withColumn("metadata", F.coalesce("metadata", F.lit(""))).select(*key).distinct()
    fresh = fresh.join(g.edges.select(*[F.col(c).alias(f"_{c}") for c in key]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")
    return g.edges.unionByName(fresh.withColumn("id", F.xxhash64(*key)).select(*g.edges.columns))


def update_contexts(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Nodes with the new context strings (id, context_string) where there is one."""
    c = contexts.select(F.col("id").alias("_i"), F.col("context_string").alias("_c"))
    return nodes.join(c, F.col("id") == F.col("_i"), "left").withColumn("context_string", F.coalesce("_c", "context_string")).drop("_i", "_c")


def replace_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["node_id"])


def flush_metrics(rows: DataFrame, path: str) -> None:
    """Append session records as JSON lines."""
    rows.write.mode("append").json(path)


def retain(rows: DataFrame, since, column: str = "ts") -> DataFrame:
    """Records not older than ``since``."""
    return rows.where(F.col(column) >= F.lit(since))
