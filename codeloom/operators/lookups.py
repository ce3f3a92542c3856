"""Projections, lookups and filters over the graph (inventory C, D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import predicates as P
from codeloom.graph import Graph

_OUT = ["id", "name", "type", "path", "start_line", "end_line"]


def nodes_by_name(g: Graph, name: str) -> DataFrame:
    return g.located("name", "type", "start_line", "end_line").where(F.col("name") == name).select(*_OUT)


def nodes_by_ids(g: Graph, ids: DataFrame) -> DataFrame:
    """Nodes with files for the ids of a frame (column id)."""
    return g.located("name", "type", "start_line", "end_line").join(ids.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_semi").select(*_OUT)


def nodes_of_file(g: Graph, path: str) -> DataFrame:
    return g.located("name", "type", "start_line", "end_line").where(F.col("path") == path).select(*_OUT).orderBy("start_line", "id")


def first_node_id(g: Graph, name: str) -> DataFrame:
    return g.nodes.where(F.col("name") == name).agg(F.min("id").alias("id"))


def file_hashes(g: Graph) -> DataFrame:
    return g.files.select("path", "content_hash")


def caller_counts(g: Graph) -> DataFrame:
    """(target_id, callers): incoming call edges per node."""
    return g.edges.where(F.col("relation") == S.CALLS).groupBy("target_id").agg(F.count(F.lit(1)).alias("callers"))


def filtered_nodes(g: Graph, kind: str | None = None, returns: str | None = None, params: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes by type alias and substrings of return and parameter types (ASCII case ignored), most called first; an unknown alias gives none."""
    has = lambda c, t: F.contains(F.lower(c), F.lit(t.lower()))
    keep: Column = (F.col("path") != S.EXTERNAL) & (F.col("name") != S.MODULE)
    if kind is not None:
        keep = keep & F.col("type").isin(P.normalise_type(kind))
    if returns is not None:
        keep = keep & has("return_type", returns)
    if params is not None:
        keep = keep & has("param_types", params)
    rows = g.located("name", "type", "start_line", "end_line", "return_type", "param_types").where(keep)
    counts = caller_counts(g).withColumnRenamed("target_id", "_t")
    rows = rows.join(counts, F.col("id") == F.col("_t"), "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return rows.orderBy(F.desc("callers"), "path", "start_line", "id").limit(limit).select("id", "name", "type", "path", "start_line", "callers")


def neighbours(g: Graph, relation: str) -> DataFrame:
    """(node_id, direction, name, path): the other ends of the edges of one relation, both ways; path is '' where the file is unknown."""
    e = g.edges.where(F.col("relation") == relation)
    ends = e.select(F.col("source_id").alias("node_id"), F.lit("out").alias("direction"), F.col("target_id").alias("other")).unionByName(
        e.select(F.col("target_id").alias("node_id"), F.lit("in").alias("direction"), F.col("source_id").alias("other"))
    )
    n = g.nodes.select(F.col("id").alias("_n"), "name", "file_id")
    f = g.files.select(F.col("file_id").alias("_f"), "path")
    return ends.join(n, F.col("other") == F.col("_n")).join(f, F.col("file_id") == F.col("_f"), "left").select("node_id", "direction", "name", F.coalesce("path", F.lit("")).alias("path"))


def incoming_references(g: Graph, name: str | None = None, relation: str | None = None, node_id: int | None = None, path: str | None = None) -> DataFrame:
    """References to the nodes of a name (of one file where ``path`` is given), or to one node by its id: source symbol, file, relation."""
    if node_id is not None:
        targets = g.nodes.where(F.col("id") == node_id).select(F.col("id").alias("_t"))
    elif path is not None:
        targets = g.located("name").where((F.col("name") == name) & (F.col("path") == path)).select(F.col("id").alias("_t"))
    else:
        targets = g.nodes.where(F.col("name") == name).select(F.col("id").alias("_t"))
    e = g.edges if relation is None else g.edges.where(F.col("relation") == relation)
    e = e.join(targets, F.col("target_id") == F.col("_t"), "left_semi").select("source_id", "target_id", "relation")
    s = g.located("name", "type", "start_line").select(F.col("id").alias("_s"), "name", "type", "path", "start_line")
    return e.join(s, F.col("source_id") == F.col("_s")).select("target_id", "source_id", "name", "type", "path", "start_line", "relation")


def references_by_relation(g: Graph, name: str) -> DataFrame:
    """Distinct (name, path) references per relation."""
    return incoming_references(g, name).dropDuplicates(["name", "path", "relation"]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def inbound_cross_file(g: Graph, path: str) -> DataFrame:
    """Edges into the nodes of a file from nodes of other files."""
    inside = g.located("name").where(F.col("path") == path).select(F.col("id").alias("_i"), F.col("name").alias("target_name"))
    rows = g.edges.join(inside, F.col("target_id") == F.col("_i"))
    return rows.join(inside.select(F.col("_i").alias("_j")), F.col("source_id") == F.col("_j"), "left_anti").select("id", "source_id", "target_name", "relation", "metadata")


def dirty_nodes(g: Graph, changed: DataFrame) -> DataFrame:
    """Nodes outside the changed files (column path) next to a node inside, in either direction."""
    paths = changed.select(F.col("path").alias("_p")).distinct()
    inside = g.located().join(paths, F.col("path") == F.col("_p"), "left_semi").select(F.col("id").alias("_i"))
    e = g.edges.select("source_id", "target_id")
    out = e.join(inside, F.col("source_id") == F.col("_i"), "left_semi").select(F.col("target_id").alias("id"))
    into = e.join(inside, F.col("target_id") == F.col("_i"), "left_semi").select(F.col("source_id").alias("id"))
    known = g.nodes.select(F.col("id").alias("_k"))
    touched = out.unionByName(into).distinct().join(inside, F.col("id") == F.col("_i"), "left_anti")
    return touched.join(known, F.col("id") == F.col("_k"), "left_semi")


def missing_context(g: Graph, batch: int | None = None) -> DataFrame:
    """(id, name, path) of all nodes without a context; a repair job that works in batches takes the first ``batch`` by id, again until none is left."""
    rows = g.located("name", "context_string").where(F.col("context_string").isNull() & (F.col("path") != S.EXTERNAL)).select("id", "name", "path")
    return rows if batch is None else rows.orderBy("id").limit(batch)


def unembedded(g: Graph, limit: int = 100) -> DataFrame:
    """Nodes with a context and no vector, most referenced first."""
    has = g.vectors.select(F.col("node_id").alias("_v")) if g.vectors is not None else g.nodes.select(F.col("id").alias("_v")).limit(0)
    degree = g.edges.groupBy("target_id").agg(F.count(F.lit(1)).alias("degree"))
    rows = g.nodes.where("context_string is not null").select("id", "name").join(has, F.col("id") == F.col("_v"), "left_anti")
    rows = rows.join(degree, F.col("id") == F.col("target_id"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.orderBy(F.desc("degree"), "id").limit(limit).select("id", "name", "degree")


def embedding_coverage(g: Graph) -> DataFrame:
    """(embedded, embeddable) over the nodes with a context."""
    v = g.vectors.select(F.col("node_id").alias("_v")).distinct()
    rows = g.nodes.where("context_string is not null").select("id").join(v, F.col("id") == F.col("_v"), "left")
    return rows.agg(F.count("_v").alias("embedded"), F.count(F.lit(1)).alias("embeddable"))


def routes(g: Graph) -> DataFrame:
    """Route edges with their metadata parsed; broken metadata gives nulls."""
    e = g.edges.where(F.col("relation") == S.ROUTES_TO)
    parsed = F.from_json(P.valid_json(F.col("metadata")), S.ROUTE_METADATA)
    return e.withColumn("r", parsed).select(
        "id", "source_id", "target_id", F.col("r.method").alias("method"), F.col("r.path").alias("route"), F.coalesce("r.inline", F.lit(False)).alias("inline"), "r.handler_start_line", "r.handler_end_line"
    )


def find_routes(g: Graph, text: str) -> DataFrame:
    """Handlers of a route: equal path or below it, of the given method if the text names one; inline handlers show their own lines."""
    method, path = P.parse_route(text)
    hit = (F.col("route") == path) | F.startswith(F.col("route"), F.lit(path.rstrip("/") + "/"))
    if method:
        hit = hit & (F.col("method") == method)
    n = g.located("name", "type", "start_line", "end_line").select(F.col("id").alias("_n"), "name", "type", F.col("path").alias("file"), "start_line", "end_line")
    rows = routes(g).where(hit).join(n, F.col("target_id") == F.col("_n"))
    own = lambda c, other: F.when(F.col("inline") & F.col(other).isNotNull(), F.col(other)).otherwise(F.col(c)).alias(c)
    name = F.when(F.col("inline"), P.route_text(F.to_json(F.struct("method", F.col("route").alias("path"))), F.col("name"))).otherwise(F.col("name"))
    return rows.select(F.col("target_id").alias("node_id"), "method", "route", name.alias("name"), "file", own("start_line", "handler_start_line"), own("end_line", "handler_end_line"))


def containing_nodes(lines: DataFrame, g: Graph) -> DataFrame:
    """The innermost node around each (path, line): equality on the path, containment as residual, smallest span by window.

    Lines in no node come with nulls; of equal spans the least id wins.
    """
    n = g.located("name", "type", "start_line", "end_line").where(F.col("name") != S.MODULE)
    n = n.select(F.col("path").alias("_p"), F.col("id").alias("node_id"), "name", "type", "start_line", "end_line")
    inside = (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    best = F.min_by(F.struct("node_id", "name", "type"), F.struct((F.col("end_line") - F.col("start_line")), F.col("node_id")))
    hit = lines.select("path", "line").distinct().join(n, inside).groupBy(F.col("path").alias("_p"), F.col("line").alias("_l")).agg(best.alias("b"))
    out = lines.join(hit, (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")), "left")
    return out.select(*lines.columns, "b.node_id", "b.name", "b.type")


def grep(texts: DataFrame, pattern: str, key: str = "path", text: str = "text", most: int = 100) -> DataFrame:
    """(key, line, content) of the lines that match a Java regular expression, the first ``most`` lines of a text; lines count from 1.

    The lines of one text are filtered inside its row, so the cap needs no shuffle. Null texts have no lines.
    """
    split = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    numbered = F.transform(split, lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("content")))
    hits = F.slice(F.filter(numbered, lambda x: x["content"].rlike(pattern)), 1, most)
    return texts.select(key, F.explode(hits).alias("h")).select(key, "h.line", "h.content")


def safe_path(path: Column) -> Column:
    """Whether a path stays below the root: neither absolute nor with a step upwards."""
    return ~path.rlike(r"^(?:[/\\\\]|[A-Za-z]:)|(?:^|[/\\\\])\.\.(?:[/\\\\]|$)")


def source_context(spans: DataFrame, texts: DataFrame, around: int = 3) -> DataFrame:
    """``spans`` (path, start_line, end_line, ...) with ``code``: these lines of ``texts`` (path, text) and ``around`` more on either side.

    Context runs from 0 to 100 lines. Paths that leave the root, unknown paths and null texts give null.
    """
    around = max(0, min(100, around))
    t = texts.select(F.col("path").alias("_p"), F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n").alias("_lines"))
    first = F.greatest(F.lit(1), F.col("start_line") - around).cast("int")
    count = F.greatest(F.lit(0), F.col("end_line") + around - first + 1).cast("int")
    code = F.when(safe_path(F.col("path")), F.array_join(F.slice("_lines", first, count), "\n"))
    return spans.join(t, F.col("path") == F.col("_p"), "left").withColumn("code", code).drop("_p", "_lines")


def names_outside(g: Graph, paths: DataFrame) -> DataFrame:
    """(id, name, path) of the nodes that are not in the files of ``paths`` (column path)."""
    p = paths.select(F.col("path").alias("_p")).distinct()
    return g.located("name").join(p, F.col("path") == F.col("_p"), "left_anti").select("id", "name", "path")


def ignoring(df: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Rows whose path starts with none of the prefixes."""
    return df.where(~P.any_prefix(F.col(path), prefixes))


def suppressed(df: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """How many rows ``ignoring`` drops."""
    return df.agg(F.count_if(P.any_prefix(F.col(path), prefixes)).alias("suppressed"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def index_status(g: Graph) -> DataFrame:
    """One row: counts of files, nodes and edges, and the last time of indexing."""
    f = g.files.where(F.col("path") != S.EXTERNAL).agg(F.count(F.lit(1)).alias("v"), F.max("indexed_at").alias("t"))
    part = lambda name, df: df.select(F.lit(name).alias("k"), F.col("v").cast("long").alias("v"))
    rows = part("files", f).unionByName(part("last_indexed_at", f.select(F.col("t").alias("v"))))
    rows = rows.unionByName(part("nodes", g.nodes.agg(F.count(F.lit(1)).alias("v")))).unionByName(part("edges", g.edges.agg(F.count(F.lit(1)).alias("v"))))
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    return rows.agg(one("files"), one("nodes"), one("edges"), one("last_indexed_at"))
