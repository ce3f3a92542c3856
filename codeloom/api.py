"""The callable surface: one method a tool, arguments checked, DataFrames out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom import schema as S
from codeloom.functions import predicates as P
from codeloom.graph import Graph
from codeloom.operators import analysis, lookups, mutation, resolve, search, shaping, traverse
from codeloom.sources import extract, scan
from codeloom.storage import Scratch
from codeloom.streaming import incremental

#: Path prefixes that dead code ignores unless told otherwise: harness entry points.
DEAD_CODE_IGNORES = ["benches/"]
#: Types whose uses in annotations and constructions are no edges.
TYPE_DEFINITIONS = ("class", "struct", "enum", "interface", "type", "trait")


def required(name: str, value: str | None) -> str:
    """A non-empty string argument."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must not be empty")
    return value


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(most, int(value)))


@dataclass
class Answer:
    """A result with what there is to say about it: status, hidden counts, hints, warnings. Behaves like its rows."""

    rows: DataFrame
    notes: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        return getattr(self.rows, name)


class CodeLoom:
    """The tools over one graph; results that are asked for often are kept for ``ttl`` seconds or until the next snapshot."""

    def __init__(self, graph: Graph, index: search.TextIndex | None = None, texts: DataFrame | None = None, ttl: float = 60.0):
        """``index`` is a kept postings table, ``texts`` (path, text) the source files that context lines are read from."""
        self.graph, self.index, self.texts, self.ttl = graph, index, texts, ttl
        self._kept: dict[str, tuple[float, DataFrame]] = {}
        self._watching: StreamingQuery | None = None

    # --- snapshots ------------------------------------------------------------------

    def refresh(self, graph: Graph, index: search.TextIndex | None = None) -> None:
        """A new snapshot; what was kept of the old one is released."""
        for _, df in self._kept.values():
            df.unpersist()
        self._kept.clear()
        self.graph, self.index = graph, index

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        made, df = self._kept.get(name, (float("-inf"), None))
        if df is None or time.monotonic() - made > self.ttl:
            if df is not None:
                df.unpersist()
            df = make().cache()
            self._kept[name] = (time.monotonic(), df)
        return df

    def rebuild_index(self, root: str, folder: str, confirm: bool = False, ignored: list[str] | None = None) -> Answer:
        """Scan a source folder, build the graph with contexts and write it as the new snapshot in ``folder``; the counts of skipped files are in the notes."""
        if not confirm:
            raise ValueError("rebuild_index replaces the snapshot: pass confirm=True")
        spark = self.graph.nodes.sparkSession
        scratch = Scratch(spark)
        found = scratch.save(scan.scan_directory(spark, root, ignored))
        sources = found.where("source is not null").select("path", "content_hash", "last_modified", "language", "source")
        graph = Graph.clean(*[scratch.save(t) for t in extract.build(sources)])
        contexts = resolve.context_strings(graph)
        nodes = mutation.update_contexts(graph.nodes, contexts)
        Graph(graph.files, nodes, graph.edges).save(folder)
        self.refresh(Graph.load(spark, folder))
        self.texts = sources.select("path", F.col("source").alias("text"))
        skipped = scan.skip_counts(found).unionByName(extract.skipped(sources).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")))
        return Answer(lookups.index_status(self.graph), {"skipped": {r["skip_reason"]: r["n"] for r in skipped.collect()}})  # one row a reason

    def start_watch(self, folder: str, schema: str, rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """Follow the file events of a folder: one incremental pass a micro-batch, after which the tools see the new state. ``rebuild`` gives (nodes, edges) of changed paths."""
        if self._watching is not None and self._watching.isActive:
            raise ValueError("already watching")

        def step(batch: DataFrame, _: int) -> None:
            # the scratch tables cut the lineage: the next batch starts from written tables
            graph, dirty = incremental.incremental(self.graph, incremental.latest(self.graph.files, batch), rebuild)
            scratch = Scratch(batch.sparkSession)
            graph = Graph(scratch.save(graph.files), scratch.save(incremental.with_contexts(graph, dirty)), scratch.save(graph.edges), graph.vectors)
            self.refresh(graph)

        self._watching = incremental.watch(self.graph.nodes.sparkSession, folder, schema, step, checkpoint, every)
        return self._watching

    def stop_watch(self) -> bool:
        """Whether there was a watch to stop."""
        query, self._watching = self._watching, None
        if query is None:
            return False
        incremental.stop(query)
        return True

    # --- names ----------------------------------------------------------------------

    def _named(self, name: str, path: str | None) -> tuple[str, dict, DataFrame | None]:
        """(name to use, notes, candidates): candidates where the name is ambiguous; a single fuzzy match is used in place of an unknown name."""
        said = search.resolve_name(self.graph, name, path).first()
        notes = {"status": said["status"], "candidates": said["candidates"]}
        if said["status"] == "Ambiguous" and path is None:
            return name, notes, search.candidates(self.graph, name)
        if said["status"] == "Unique":
            hit = self.graph.nodes.where(F.col("id") == said["id"]).select("name").first()
            if hit and hit["name"] != name:
                notes["fuzzy"] = hit["name"]
                return hit["name"], notes, None
        return name, notes, None

    def resolve(self, name: str, path: str | None = None) -> DataFrame:
        return search.resolve_name(self.graph, required("name", name), path)

    # --- tools ----------------------------------------------------------------------

    def semantic_code_search(self, query: str, query_vector: list[float] | None = None, top_k: int = 10, node_type: str | None = None, language: str | None = None, compact: bool = False) -> Answer:
        """Hybrid search; notes hold the confidence, a warning where it is low and no name matches, and a hint where nothing is found."""
        rows = search.hybrid_search(self.graph, required("query", query), query_vector, clamp(top_k, 1, 100), node_type, language, self.index)
        rows = Scratch(rows.sparkSession).save(rows)
        first = rows.select("confidence").first()
        notes: dict = {} if first else {"hint": search.zero_result_hint(query)}
        if first:
            notes["confidence"] = first["confidence"]
            if search.low_confidence(rows, query, first["confidence"]).first()["warning"]:
                notes["warning"] = "low confidence"
        return Answer(shaping.compact(rows, "semantic_code_search") if compact else rows, notes)

    def get_call_graph(self, name: str, direction: str = "both", depth: int = 3, path: str | None = None, include_tests: bool = False) -> Answer:
        """Callers and callees; an ambiguous name gives its candidates, notes say how many test symbols are hidden."""
        if direction not in ("callers", "callees", "both"):
            raise ValueError("direction must be callers, callees or both")
        name, notes, several = self._named(required("name", name), path)
        if several is not None:
            return Answer(several, notes)
        depth = clamp(depth, 1, 20)
        if not include_tests:
            reach = lambda tests: traverse.callers_and_callees(self.graph, name, direction, depth, path, tests).agg(F.count(F.lit(1)).alias("n")).first()["n"]
            notes["hidden_tests"] = reach(True) - reach(False)
        return Answer(traverse.call_graph_tool(self.graph, name, direction, depth, path, include_tests), notes)

    def trace_http_chain(self, route: str, depth: int = 3) -> DataFrame:
        return traverse.trace_routes(self.graph, required("route", route), clamp(depth, 1, 20))

    find_http_route = trace_http_chain

    def get_ast_node(self, name: str | None = None, path: str | None = None, node_id: int | None = None, context_lines: int | None = None, references: bool = False, impact: bool = False, compact: bool = False) -> Answer:
        """A symbol by id or by name and file; with its source lines and lines around them, its references and its impact where asked for."""
        if node_id is None:
            required("name", name)
        rows = analysis.show_node(self.graph, name, path, node_id)
        notes: dict = {}
        if context_lines is not None:
            if self.texts is None:
                raise ValueError("context lines need the source texts")
            rows = lookups.source_context(rows, self.texts, clamp(context_lines, 0, 100))
        if references:
            notes["references"] = self.find_references(name, node_id=node_id, path=path).rows
        if impact and name is not None:
            notes["impact"] = analysis.impact(self.graph, name, path=path)
        return Answer(shaping.compact(rows, "get_ast_node") if compact else rows, notes)

    read_snippet = get_ast_node

    def get_index_status(self) -> DataFrame:
        """Counts, embedding coverage in percent (at least 1 where there is any) and whether the index is usable."""
        rows = lookups.index_status(self.graph)
        if self.graph.vectors is None:
            cover = rows.select(F.lit(0).alias("embedded"), F.lit(0).alias("embeddable")).limit(1)
        else:
            cover = lookups.embedding_coverage(self.graph)
        both = rows.withColumn("_k", F.lit(1)).join(cover.withColumn("_j", F.lit(1)), F.col("_k") == F.col("_j")).drop("_k", "_j")
        share = F.floor(F.try_divide(F.col("embedded") * 100, F.col("embeddable")))
        share = F.when(F.col("embedded") > 0, F.greatest(share, F.lit(1))).otherwise(0)
        state = F.when(F.lit(self.graph.vectors is None), "unavailable").when(F.col("embedded") == 0, "pending").when(F.col("embedded") < F.col("embeddable"), "partial").otherwise("complete")
        age = F.unix_timestamp() - F.col("last_indexed_at")
        out = both.withColumn("coverage", share).withColumn("embedding_status", state).withColumn("healthy", (F.col("files") > 0) & (F.col("nodes") > 0))
        return out.withColumn("age_seconds", age).withColumn("watching", F.lit(self._watching is not None and self._watching.isActive))

    def project_summary(self) -> dict:
        """The status as one record, with the schema version."""
        return self.get_index_status().first().asDict() | {"schema_version": S.SCHEMA_VERSION}

    def impact_analysis(self, name: str, depth: int = 3, change: str = "behavior", path: str | None = None) -> DataFrame:
        return analysis.impact(self.graph, required("name", name), clamp(depth, 1, 20), change == "remove", path)

    def module_overview(self, prefix: str) -> DataFrame:
        prefix = required("prefix", prefix).removeprefix("./")
        return self._keep(f"module_overview {prefix}", lambda: analysis.module_overview(self.graph, "" if prefix == "." else prefix))

    def dependency_graph(self, path: str, direction: str = "outgoing", depth: int = 2) -> Answer:
        """The files a file depends on, with the symbols between it and its neighbours; where the path is a directory the notes say so and list its files."""
        path = required("path", path)
        rows = traverse.dependency_graph(self.graph, path, direction, clamp(depth, 1, 10))
        s = traverse.direct_symbols(self.graph, path, direction).withColumnRenamed("path", "_p")
        rows = rows.join(s, (F.col("path") == F.col("_p")) & (F.col("depth") == 1), "left").drop("_p")
        notes = {}
        if self.graph.files.where(F.col("path") == path).limit(1).count() == 0:
            inside = self.graph.files.where(F.startswith(F.col("path"), F.lit(path.rstrip("/") + "/"))).orderBy("path").limit(10)
            if some := [r["path"] for r in inside.select("path").collect()]:
                notes = {"hint": "directory", "files": some}
        return Answer(rows, notes)

    def find_similar_code(self, node_id: int, top_k: int = 5, max_distance: float = 0.8) -> DataFrame:
        return search.similar_nodes(self.graph, node_id, clamp(top_k, 1, 100), max_distance)

    def project_map(self, compact: bool = False) -> DataFrame:
        rows = self._keep("project_map", lambda: analysis.project_map(self.graph))
        return shaping.compact(rows, "project_map") if compact else rows

    def hot_functions(self) -> DataFrame:
        return self._keep("hot_functions", lambda: analysis.hot_functions(self.graph))

    def entry_points(self) -> DataFrame:
        return analysis.entry_points(self.graph)

    def ast_search(self, query: str | None = None, node_type: str | None = None, returns: str | None = None, params: str | None = None, limit: int = 20) -> Answer:
        """By text and filters, or by filters alone, most called first. Where a generic return type has no hit the notes name the type inside it."""
        limit = clamp(limit, 1, 100)
        if query:
            hits = search.hybrid_search(self.graph, query, None, min(100, 4 * limit), node_type, index=self.index).drop("confidence")
            n = self.graph.nodes.select(F.col("id").alias("_i"), "return_type", "param_types")
            has = lambda c, t: F.contains(F.lower(c), F.lit(t.lower()))
            rows = hits.join(n, F.col("id") == F.col("_i"))
            for c, t in (("return_type", returns), ("param_types", params)):
                rows = rows if t is None else rows.where(has(c, t))
            rows = rows.select(*hits.columns).orderBy(F.desc("relevance"), "id").limit(limit)
        elif node_type or returns or params:
            rows = lookups.filtered_nodes(self.graph, node_type, returns, params, limit)
        else:
            raise ValueError("Must pass a query or a filter")
        notes = {}
        if returns and "<" in returns and rows.limit(1).count() == 0:
            notes["hint"] = search.strip_outer_generic(returns)
        return Answer(rows, notes)

    def find_references(self, name: str | None = None, relation: str | None = None, node_id: int | None = None, path: str | None = None, include_tests: bool = False, compact: bool = False) -> Answer:
        """References by id, by name and file, or by the only fuzzy match of a name; test symbols are left out unless wanted."""
        notes: dict = {}
        if node_id is None:
            name, notes, several = self._named(required("name", name), path)
            if several is not None and path is not None:
                return Answer(several, notes)
        rows = lookups.incoming_references(self.graph, name, relation, node_id, path)
        if not include_tests:
            flags = self.graph.nodes.select(F.col("id").alias("_i"), "is_test")
            rows = rows.join(flags, F.col("source_id") == F.col("_i"), "left").where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test"))).drop("_i", "is_test")
        which = self.graph.nodes.where(F.col("id") == node_id if node_id is not None else F.col("name") == name)
        if which.where(F.col("type").isin(*TYPE_DEFINITIONS)).limit(1).count():
            notes["note"] = "a type: its uses in annotations and constructions are no edges"
        rows = rows.orderBy("relation", "path", "start_line", "source_id")
        return Answer(shaping.compact(rows, "find_references") if compact else rows, notes)

    def find_dead_code(self, prefix: str | None = None, node_type: str | None = None, include_tests: bool = False, min_lines: int = 3, limit: int = 50, ignore: list[str] | None = None) -> Answer:
        """Unreferenced symbols; notes say how many rows the ignored prefixes suppress."""
        prefixes = DEAD_CODE_IGNORES if ignore is None else ignore
        rows = analysis.classified_dead_code(self.graph, prefix=prefix, kind=node_type, include_tests=include_tests, min_lines=min_lines, limit=clamp(limit, 1, 1000))
        rows = Scratch(rows.sparkSession).save(rows)
        return Answer(lookups.ignoring(rows, prefixes), {"suppressed": lookups.suppressed(rows, prefixes).first()["suppressed"]})

    def compressed(self, rows: DataFrame, threshold: int = S.COMPRESSION_TOKENS) -> tuple[str, DataFrame]:
        return shaping.compress(rows, threshold)

    def shortened(self, rows: DataFrame, budget: int = 8000) -> DataFrame:
        return shaping.shorten(rows, budget)


def open_graph(spark: SparkSession, folder: str) -> CodeLoom:
    """The tools over a snapshot folder, with its postings table where there is one."""
    try:
        index = search.TextIndex.load(spark, folder)
    except Exception:  # noqa: BLE001  no postings table was built
        index = None
    return CodeLoom(Graph.load(spark, folder), index)
