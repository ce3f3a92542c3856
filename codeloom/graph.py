"""The graph container: cleaned relations and Parquet snapshots."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.operators.dedupe import one_per_key
from codeloom.sources.tables import table


def latest_files(files: DataFrame) -> DataFrame:
    """One row per file id: that with the latest ``indexed_at`` (ties by stamp, hash and path)."""
    row = F.struct("indexed_at", "last_modified", "content_hash", "path", "language")
    return files.where("id is not null").groupBy("id").agg(F.max(row).alias("r")).select(
        F.col("id").alias("file_id"), "r.path", "r.content_hash", "r.last_modified", F.lower("r.language").alias("language"), "r.indexed_at"
    )


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id; unused columns are pruned from the aggregate."""
    return nodes.where("id is not null").dropDuplicates(["id"])


def unique_edges(edges: DataFrame) -> DataFrame:
    """The unique key (source, target, relation, metadata), relations trimmed and in lower case, null ends dropped, the least id kept."""
    return (
        edges.where("source_id is not null and target_id is not null")
        .groupBy("source_id", "target_id", F.lower(F.trim("relation")).alias("relation"), F.coalesce("metadata", F.lit("")).alias("metadata"))
        .agg(F.min("id").alias("id"))
    )


def node_key(path: Column, kind: Column, qualified: Column, start: Column) -> Column:
    """A node id that stays the same over re-indexing."""
    return F.xxhash64(path, kind, qualified, start)


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    raw_nodes: DataFrame | None = None

    @staticmethod
    def clean(files: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> "Graph":
        return Graph(latest_files(files), unique_nodes(nodes), unique_edges(edges), vectors, nodes)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "Graph":
        return Graph.clean(*(table(spark, folder, t) for t in ("files", "nodes", "edges")))

    def with_vectors(self, vectors: DataFrame) -> "Graph":
        return replace(self, vectors=vectors)

    def texts(self, *columns: str) -> DataFrame:
        """Nodes (id and the given columns), one row an id, for columns that hold texts: rows whose id is alone are not shuffled."""
        if self.raw_nodes is None:
            return self.nodes.select("id", *columns)
        return one_per_key(self.raw_nodes.select("id", *columns), "id")

    def located(self, *columns: str) -> DataFrame:
        """Nodes (the given columns) with the path and language of their file."""
        cols = [F.col(c) for c in dict.fromkeys(("id", "file_id", *columns))]
        f = self.files.select(F.col("file_id").alias("_fid"), "path", "language")
        return self.nodes.select(*cols).join(f, F.col("file_id") == F.col("_fid")).drop("_fid")

    def save(self, folder: str, buckets: int = 64) -> None:
        """A snapshot: nodes clustered by file, edges by target, so that the usual joins read co-located rows."""
        self.files.withColumnRenamed("file_id", "id").write.mode("overwrite").parquet(f"{folder}/files.parquet")
        self.nodes.repartition(buckets, "file_id").sortWithinPartitions("file_id").write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
        self.edges.repartition(buckets, "target_id").sortWithinPartitions("target_id").write.mode("overwrite").parquet(f"{folder}/edges.parquet")
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{folder}/vectors.parquet")
