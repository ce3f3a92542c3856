"""Incremental indexing and usage metrics on Structured Streaming (inventory K)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom import schema as S
from codeloom.graph import Graph
from codeloom.operators import lookups, mutation, resolve, search

#: Kinds of file events that change content.
CONTENT_EVENTS = ("create", "remove", "data", "name", "any")


def content_events(events: DataFrame, kind: str = "kind") -> DataFrame:
    return events.where(F.col(kind).isin(*CONTENT_EVENTS))


def incremental(old: Graph, files: DataFrame, rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[Graph, DataFrame]:
    """(graph, dirty): one pass over a new file table: diff, dirty set before any change, delete, rebuild changed files, union.

    ``rebuild`` gives (nodes, edges) of the new and changed paths. Running it again with the same files changes nothing.
    """
    diff = mutation.snapshot_diff(old.files, files)
    touched = diff.select("path")
    dirty = lookups.dirty_nodes(old, touched)
    kept = mutation.delete_files(old, touched)
    nodes, edges = rebuild(diff.where("status <> 'deleted'").select("path"))
    fresh = files.join(diff.where("status <> 'deleted'").select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_semi")
    new = Graph(kept.files.unionByName(fresh.select(*kept.files.columns)), kept.nodes.unionByName(nodes.select(*kept.nodes.columns)), kept.edges.unionByName(edges.select(*kept.edges.columns)), kept.vectors)
    return new, dirty


def latest(files: DataFrame, events: DataFrame) -> DataFrame:
    """The file table after a batch of events: rows of the file columns, with ``kind`` where the source gives it; of several events of a path the last by ``indexed_at`` counts, 'remove' takes the file away."""
    gone = F.col("kind") == "remove" if "kind" in events.columns else F.lit(False)
    seen = content_events(events) if "kind" in events.columns else events
    last = seen.groupBy("path").agg(F.max(F.struct("indexed_at", gone.alias("_gone"), *[c for c in files.columns if c not in ("path", "indexed_at")])).alias("_r"))
    kept = files.join(last.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")
    return kept.unionByName(last.where("not _r._gone").select("path", "_r.*").select(*files.columns))


def with_contexts(g: Graph, dirty: DataFrame) -> DataFrame:
    """The nodes with the contexts of ``dirty`` (column id), and of nodes that have none, made again."""
    wanted = dirty.select("id").unionByName(g.nodes.where("context_string is null").select("id")).distinct()
    return mutation.update_contexts(g.nodes, resolve.context_strings(g, wanted))


def embed_missing(g: Graph, embedder: search.Embedder, most: int = 10_000) -> Graph:
    """The graph with vectors for the ``most`` referenced nodes that have a context and none yet; vectors of another dimension are made again, rows that fail stay open."""
    held = None if g.vectors is None else search.check_dimension(g.vectors, embedder.dimension)
    g = replace(g, vectors=held)
    todo = lookups.unembedded(g, most).select(F.col("id").alias("_i"))
    rows = g.nodes.join(todo, F.col("id") == F.col("_i"), "left_semi").select("id", "context_string")
    made = search.normalised(search.embed_nodes(rows, embedder).where("embedding is not null").select("node_id", "embedding"))
    return g.with_vectors(made if held is None else mutation.replace_vectors(held, made))


def watch(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "30 seconds", files_per_trigger: int = 1000) -> StreamingQuery:
    """One incremental pass a micro-batch over the file events of a folder; without ``every`` what is there is worked off once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stop(query: StreamingQuery) -> None:
    query.stop()


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming totals per tool of the session records that land in a folder."""
    rows = spark.readStream.schema(S.USAGE).parquet(folder).select(F.explode("tools").alias("tool", "s"))
    return rows.groupBy("tool").agg(F.sum("s.n").alias("n"), F.sum("s.ms").alias("ms"), F.sum("s.err").alias("err"), F.max("s.max_ms").alias("max_ms"))


def usage_stream_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming totals per tool and kind of error."""
    rows = spark.readStream.schema(S.USAGE).parquet(folder).select(F.explode("tools").alias("tool", "s"))
    return rows.select("tool", F.explode("s.err_kinds").alias("kind", "k")).groupBy("tool", "kind").agg(F.sum("k").alias("n"))


def usage_stream_search(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming totals of searches: queries, misses and quality weighted by queries."""
    q = F.col("search.queries")
    rows = spark.readStream.schema(S.USAGE).parquet(folder)
    return rows.agg(F.sum(q).alias("queries"), F.sum("search.zero").alias("zero"), F.try_divide(F.sum(F.col("search.avg_quality") * q), F.sum(q)).alias("avg_quality"))


def windowed_usage(rows: DataFrame, late: str = "4 days", window: str = "1 day") -> DataFrame:
    """Sessions and calls by event-time window, late records accepted up to ``late`` (an extension; streaming or batch)."""
    calls = F.aggregate(F.map_values("tools"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["n"], F.lit(0).cast("long")))
    rows = rows.select("ts", F.coalesce(calls, F.lit(0)).alias("calls"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("calls").alias("calls")).select(F.col("w.start").alias("start"), "sessions", "calls")


def cooldown(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Events kept when the last kept one of their key is at least ``seconds`` older: stateful on streams, with one row of state a key.

    Events of a micro-batch are taken in time order; state leaves after ten cooldowns without an event. On batch input the same rule
    runs per key in time order.
    """
    local = dict(events.dtypes)[ts] == "timestamp_ntz"
    at = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts)) / 1e6 if local else F.col(ts).cast("double")
    out = events.select(*keys, at.alias("at"))
    schema = ", ".join(f"{c} {t}" for c, t in out.dtypes)
    if not events.isStreaming:

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: tuple = ()
            at = 0.0
            for b in batches:
                keep = []
                for row in b.itertuples(index=False):
                    key = row[:-1]
                    fresh = key != held or row[-1] - at >= seconds
                    if fresh:
                        held, at = key, row[-1]
                    keep.append(fresh)
                yield b[pd.Series(keep, index=b.index, dtype=bool)]

        # rows of a key lie together in time order, so a task needs one value of state however many rows a key has
        return out.repartition(*keys).sortWithinPartitions(*keys, "at").mapInPandas(scan, schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        for b in batches:
            keep = []
            for t in b.sort_values("at")["at"]:
                keep.append(t - last >= seconds)
                last = t if keep[-1] else last
            yield b.sort_values("at")[keep]
        state.update((last,))
        state.setTimeoutDuration(seconds * 10_000)

    return out.groupBy(*keys).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
