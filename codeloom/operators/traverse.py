"""Bounded traversal by level-synchronous breadth-first search (inventory H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import predicates as P
from codeloom.graph import Graph
from codeloom.storage import Scratch


def bfs(steps: DataFrame, seeds: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """(seed, node, depth, parent): shortest distance of every node reached from each seed group.

    ``steps`` has (source, target), ``seeds`` has (seed, node); several nodes may share a seed and all of them are at depth 0. Each level
    is one join of the frontier with the steps and one anti join with what was visited, cut off as a written table; a parent is the least
    of those one level up. Cycles end by the anti join. Empty inputs give the seeds, or nothing.
    """
    scratch = scratch or Scratch(steps.sparkSession)
    steps = scratch.save(steps.select(F.col("source").alias("_from"), F.col("target").alias("_to")).distinct())
    kind = dict(seeds.dtypes)["node"]
    level = scratch.save(seeds.select("seed", "node").distinct().select("seed", "node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")))
    visited = level
    for d in range(1, depth + 1):
        found = level.join(steps, F.col("node") == F.col("_from")).groupBy("seed", F.col("_to").alias("node")).agg(F.min("node").alias("parent"))
        known = visited.select(F.col("seed").alias("_s"), F.col("node").alias("_n"))
        fresh = found.join(known, (F.col("seed") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_anti")
        level, seen = scratch.save_counting(fresh.select("seed", "node", F.lit(d).alias("depth"), "parent"), rows=F.lit(True))
        if not seen["rows"]:
            break
        visited = visited.unionByName(level)
    return visited


def call_steps(g: Graph, direction: str) -> DataFrame:
    e = g.edges.where(F.col("relation") == S.CALLS)
    a, b = ("target_id", "source_id") if direction == "callers" else ("source_id", "target_id")
    return e.select(F.col(a).alias("source"), F.col(b).alias("target"))


def call_reach(g: Graph, name: str, direction: str = "both", depth: int = 3, path: str | None = None) -> DataFrame:
    """(node_id, name, type, path, depth, direction, parent_id) of every symbol reached from the symbols of a name, these at depth 0.

    Depth is cut at 10. With direction 'both' the seeds come once per direction.
    """
    depth = max(0, min(depth, S.MAX_GRAPH_DEPTH))
    named = g.located("name").where((F.col("name") == name) & (F.lit(True) if path is None else F.col("path") == path))
    seeds = named.select(F.lit(0).alias("seed"), F.col("id").alias("node"))
    where = g.located("name", "type").select(F.col("id").alias("_i"), "name", "type", "path")
    out = None
    for way in ("callers", "callees") if direction == "both" else (direction,):
        rows = bfs(call_steps(g, way), seeds, depth).join(where, F.col("node") == F.col("_i"))
        rows = rows.select(F.col("node").alias("node_id"), "name", "type", "path", "depth", F.lit(way).alias("direction"), F.col("parent").alias("parent_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def listed(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows a direction by depth and id: for listings only, counts are taken before."""
    part = lambda way: rows.where(F.col("direction") == way).orderBy("depth", "node_id").limit(limit)
    return part("callers").unionByName(part("callees"))


def call_graph(g: Graph, name: str, direction: str = "both", depth: int = 3, path: str | None = None, limit: int = S.MAX_GRAPH_ROWS) -> DataFrame:
    """The listing of ``call_reach``: at most ``limit`` rows a direction by depth and id, seeds included."""
    return listed(call_reach(g, name, direction, depth, path), limit)


def closest(rows: DataFrame) -> DataFrame:
    """The least depth of each (node, direction)."""
    return rows.groupBy("node_id", "direction").agg(F.min("depth").alias("depth"))


def callers_and_callees(g: Graph, name: str, direction: str = "both", depth: int = 3, path: str | None = None, include_tests: bool = False) -> DataFrame:
    """``call_reach`` without its seeds and, unless wanted, without test symbols."""
    rows = call_reach(g, name, direction, depth, path).where("depth > 0")
    if include_tests:
        return rows
    flags = g.nodes.select(F.col("id").alias("_i"), "is_test")
    rows = rows.join(flags, F.col("node_id") == F.col("_i"), "left")
    return rows.where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test"))).drop("_i", "is_test")


def call_graph_tool(g: Graph, name: str, direction: str = "both", depth: int = 3, path: str | None = None, include_tests: bool = False, limit: int = S.MAX_GRAPH_ROWS) -> DataFrame:
    """The listing without seeds and, unless wanted, without test symbols: one row for each (name, path, depth, direction), the first ``limit`` of a direction."""
    rows = callers_and_callees(g, name, direction, depth, path, include_tests)
    return listed(rows.groupBy("name", "path", "depth", "direction").agg(F.min("node_id").alias("node_id")), limit)


def rollup(rows: DataFrame, most: int = 10) -> DataFrame:
    """Call-graph rows by file and direction: count, first names, depth range."""
    return rows.groupBy("path", "direction").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("depth", "node_id", "name"))), 1, most), lambda x: x["name"]), ",").alias("names"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
    )


def file_edges(g: Graph) -> DataFrame:
    """(source, target, n): imports and calls between files, counted once per edge."""
    n = g.nodes.select(F.col("id").alias("_n"), F.col("file_id").alias("_f"))
    e = g.edges.where(F.col("relation").isin(S.IMPORTS, S.CALLS)).select("source_id", "target_id")
    e = e.join(n.select(F.col("_n").alias("_a"), F.col("_f").alias("source")), F.col("source_id") == F.col("_a"))
    e = e.join(n.select(F.col("_n").alias("_b"), F.col("_f").alias("target")), F.col("target_id") == F.col("_b"))
    return e.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def import_tree(g: Graph, path: str, direction: str = "outgoing", depth: int = 2) -> DataFrame:
    """(path, depth, n): the files a file depends on, or that depend on it; n counts the edges directly between both, depth is cut to 1..10."""
    depth = max(1, min(depth, 10))
    scratch = Scratch(g.files.sparkSession)
    pairs = scratch.save(file_edges(g))
    a, b = ("source", "target") if direction == "outgoing" else ("target", "source")
    root = g.files.where(F.col("path") == path).select(F.lit(0).alias("seed"), F.col("file_id").alias("node"))
    found = bfs(pairs.select(F.col(a).alias("source"), F.col(b).alias("target")), root, depth, scratch).where("depth > 0")
    direct = pairs.join(root.select(F.col("node").alias("_r")), F.col(a) == F.col("_r"), "left_semi").select(F.col(b).alias("_o"), "n")
    f = g.files.select(F.col("file_id").alias("_f"), "path", "language")
    rows = found.join(direct, F.col("node") == F.col("_o"), "left").join(f, F.col("node") == F.col("_f"))
    return rows.select("path", "language", "depth", F.coalesce("n", F.lit(0)).alias("n"))


def direct_symbols(g: Graph, path: str, direction: str = "outgoing", most: int = 20) -> DataFrame:
    """(path, symbols): the names at the far ends of the imports and calls between a file and each file next to it, the first ``most`` by name."""
    n = g.located("name")
    e = g.edges.where(F.col("relation").isin(S.IMPORTS, S.CALLS)).select("source_id", "target_id")
    a, b = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    own = n.where(F.col("path") == path).select(F.col("id").alias("_own"))
    far = n.select(F.col("id").alias("_far"), "name", "path").where(F.col("path") != path)
    rows = e.join(own, F.col(a) == F.col("_own"), "left_semi").join(far, F.col(b) == F.col("_far")).select("path", "name").distinct()
    place = F.row_number().over(Window.partitionBy("path").orderBy("name"))
    return rows.withColumn("_r", place).where(F.col("_r") <= most).groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("symbols"))


def dependency_graph(g: Graph, path: str, direction: str = "outgoing", depth: int = 2) -> DataFrame:
    """The import tree without the external file and files of other language families."""
    own = g.files.where(F.col("path") == path).select(F.col("language").alias("_own"))
    rows = import_tree(g, path, direction, depth).where(F.col("path") != S.EXTERNAL)
    mine = own.first()
    lang = F.lit(mine["_own"] if mine else None).cast("string")
    return rows.where(P.compatible(F.col("language"), lang)).select("path", "depth", "n")


def trace_routes(g: Graph, text: str, depth: int = 3) -> DataFrame:
    """(handler_id, node_id, name, depth): callees of every handler of a route in one multi-source search."""
    from codeloom.operators.lookups import find_routes

    handlers = find_routes(g, text).select(F.col("node_id").alias("seed"), F.col("node_id").alias("node")).distinct()
    names = g.nodes.select(F.col("id").alias("_i"), "name")
    rows = bfs(call_steps(g, "callees"), handlers, max(1, min(depth, 20, S.MAX_GRAPH_DEPTH)))
    return rows.join(names, F.col("node") == F.col("_i")).select(F.col("seed").alias("handler_id"), F.col("node").alias("node_id"), "name", "depth")
