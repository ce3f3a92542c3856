"""Aggregating analyses: statistics, impact, dead code, references (inventory E, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import predicates as P
from codeloom.graph import Graph
from codeloom.operators.lookups import caller_counts, routes
from codeloom.operators.traverse import call_reach

_KINDS = {"functions": ("function", "method"), "classes": ("class", "struct"), "interfaces": ("interface", "trait")}


def module_stats(g: Graph) -> DataFrame:
    """Per directory: files, symbols by kind, languages."""
    rows = g.located("type", "name").where((F.col("path") != S.EXTERNAL) & (F.col("name") != S.MODULE))
    of = lambda kinds: F.sum(F.when(F.col("type").isin(*kinds), 1).otherwise(0))
    return rows.groupBy(P.directory(F.col("path")).alias("dir")).agg(
        F.count_distinct("path").alias("files"),
        *[of(v).alias(k) for k, v in _KINDS.items()],
        F.count(F.lit(1)).alias("symbols"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def _called(g: Graph) -> DataFrame:
    """Call edges with production targets: target node, its path and directory."""
    t = g.located("name", "type", "is_test").where(~P.is_test_in_statistics(F.col("name"), F.col("path"), F.col("is_test")) & (F.col("name") != S.MODULE))
    e = g.edges.where(F.col("relation") == S.CALLS).select("source_id", "target_id")
    return e.join(t.select(F.col("id").alias("_t"), "name", "type", "path"), F.col("target_id") == F.col("_t"))


def key_symbols(g: Graph, top: int = 200, calls: int = 6, most: int = 8) -> DataFrame:
    """(dir, names): of the ``top`` most called symbols the first ``calls`` names a directory, then exported names up to ``most``."""
    counts = _called(g).where(F.col("type") != "module").groupBy("target_id", "name", "path").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "target_id").limit(top).withColumn("dir", P.directory(F.col("path")))
    best = best.groupBy("dir", "name").agg(F.max(F.struct("n", (-F.col("target_id")).alias("neg"))).alias("k"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("k.n"), F.desc("k.neg")))
    best = best.withColumn("r", rank.cast("long")).where(F.col("r") <= calls).select("dir", "name", "r")
    x = g.edges.where(F.col("relation") == S.EXPORTS).select(F.col("target_id").alias("_t"))
    exported = g.located("name").where(F.col("name") != S.MODULE).join(x, F.col("id") == F.col("_t"), "left_semi")
    exported = exported.select(P.directory(F.col("path")).alias("dir"), "name").distinct()
    exported = exported.join(best.select(F.col("dir").alias("_d"), F.col("name").alias("_n")), (F.col("dir") == F.col("_d")) & (F.col("name") == F.col("_n")), "left_anti")
    exported = exported.withColumn("r", F.lit(most) + F.row_number().over(Window.partitionBy("dir").orderBy("name")).cast("long")).where(F.col("r") <= 2 * most)
    both = best.unionByName(exported).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("a"))
    return both.select("dir", F.array_join(F.transform(F.slice("a", 1, most), lambda v: v["name"]), ",").alias("names"))


def module_dependencies(g: Graph) -> DataFrame:
    """(dir_from, dir_to, n): imports and calls between directories."""
    n = g.located().where(F.col("path") != S.EXTERNAL).select(F.col("id").alias("_n"), P.directory(F.col("path")).alias("_d"))
    e = g.edges.where(F.col("relation").isin(S.IMPORTS, S.CALLS)).select("source_id", "target_id")
    e = e.join(n.select(F.col("_n").alias("_a"), F.col("_d").alias("dir_from")), F.col("source_id") == F.col("_a"))
    e = e.join(n.select(F.col("_n").alias("_b"), F.col("_d").alias("dir_to")), F.col("target_id") == F.col("_b"))
    return e.where("dir_from <> dir_to").groupBy("dir_from", "dir_to").agg(F.count(F.lit(1)).alias("n"))


def hot_functions(g: Graph, limit: int = 15) -> DataFrame:
    """The functions with most production callers; test callers are counted beside."""
    s = g.located("name", "is_test").select(F.col("id").alias("_s"), P.is_test_in_statistics(F.col("name"), F.col("path"), F.col("is_test")).alias("_test"))
    rows = _called(g).where(F.col("type").isin("function", "method")).join(s, F.col("source_id") == F.col("_s"))
    rows = rows.groupBy("name", "type", "path").agg(F.count_if(~F.col("_test")).alias("callers"), F.count_if("_test").alias("test_callers"))
    return rows.where("callers > 0").orderBy(F.desc("callers"), "name", "path", "type").limit(limit)


def entry_points(g: Graph, most_routes: int = 20, most_mains: int = 5) -> DataFrame:
    """(kind, label, name, path): route handlers, or uncalled ``main`` functions where the graph has no route; decided inside the plan."""
    n = g.located("name", "type").select(F.col("id").alias("_n"), "name", "type", "path")
    r = g.edges.where(F.col("relation") == S.ROUTES_TO).join(n, F.col("target_id") == F.col("_n"))
    r = r.select(F.lit("route").alias("kind"), P.route_text(F.col("metadata"), F.col("name")).alias("label"), "name", "path", F.col("id").alias("o")).orderBy("o").limit(most_routes)
    called = caller_counts(g).select(F.col("target_id").alias("_t"))
    m = n.where((F.col("name") == "main") & (F.col("type") == "function")).join(called, F.col("_n") == F.col("_t"), "left_anti")
    m = m.select(F.lit("main").alias("kind"), F.lit("main").alias("label"), "name", "path", F.col("_n").alias("o")).orderBy("o").limit(most_mains)
    both = r.unionByName(m)  # at most most_routes + most_mains rows
    return both.withColumn("_any", F.max(F.col("kind") == "route").over(Window.partitionBy(F.lit(1)))).where("kind = 'route' or not _any").select("kind", "label", "name", "path")


def module_exports(g: Graph, prefix: str) -> DataFrame:
    """(name, type, path, callers) of the exported symbols below a path prefix; where there is none, of all symbols, the largest count of each (name, path)."""
    prefix = prefix.removeprefix("./")
    inside = F.lit(True) if prefix in ("", ".") else F.startswith("path", F.lit(prefix))
    n = g.located("name", "type").where(inside & (F.col("name") != S.MODULE) & (F.col("path") != S.EXTERNAL) & (F.col("type") != "module"))
    counts = caller_counts(g).select(F.col("target_id").alias("_t"), "callers")
    x = g.edges.where(F.col("relation") == S.EXPORTS).select(F.col("target_id").alias("_x")).distinct()
    rows = n.join(counts, F.col("id") == F.col("_t"), "left").join(x, F.col("id") == F.col("_x"), "left")
    rows = rows.select("id", "name", "type", "path", F.coalesce("callers", F.lit(0)).alias("callers"), F.col("_x").isNotNull().alias("exported"))
    some = rows.agg(F.max("exported")).first()[0]
    if some:
        return rows.where("exported").select("name", "type", "path", "callers").distinct()
    top = F.max_by(F.struct("type", "callers"), F.struct("callers", (-F.col("id")).alias("neg")))
    return rows.groupBy("name", "path").agg(top.alias("t")).select("name", "t.type", "path", "t.callers")


def module_overview(g: Graph, prefix: str, hot: int = 5, most: int = 30, names: int = 8) -> DataFrame:
    """(section, type, n, names): the hottest exports, the first active ones, and the inactive ones by type."""
    rows = module_exports(g, prefix)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("callers"), "path", "name"))
    top = rows.where("callers > 0").orderBy(F.desc("callers"), "path", "name").limit(most).withColumn("r", place)
    listed = lambda df, section, upto: df.where(F.col("r") <= upto).groupBy(F.lit(section).alias("section"), F.lit("").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda v: v["name"]), ",").alias("names")
    )
    idle = rows.where("callers = 0").withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("path", "name")))
    shown = F.collect_list(F.when(F.col("r") <= names, F.struct("r", "name")))
    idle = idle.groupBy(F.lit("inactive").alias("section"), "type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(shown), lambda v: v["name"]), ",").alias("names"))
    return listed(top, "hot", hot).unionByName(listed(top, "active", most)).unionByName(idle)


def callers_with_routes(g: Graph, name: str, depth: int = 3, path: str | None = None) -> DataFrame:
    """All callers of a symbol with the first route that leads to each."""
    rows = call_reach(g, name, "callers", depth, path)
    first = g.edges.where(F.col("relation") == S.ROUTES_TO).groupBy(F.col("source_id").alias("_s")).agg(F.min_by("metadata", "id").alias("route"))
    return rows.join(first, F.col("node_id") == F.col("_s"), "left").drop("_s")


def impact(g: Graph, name: str, depth: int = 3, removal: bool = False, path: str | None = None) -> DataFrame:
    """One row: production and test callers, direct and transitive, files, routes, risk."""
    rows = callers_with_routes(g, name, depth, path)
    flags = g.nodes.select(F.col("id").alias("_i"), "is_test")
    rows = rows.join(flags, F.col("node_id") == F.col("_i"), "left").withColumn("t", P.is_test(F.col("name"), F.col("path"), F.col("is_test")))
    caller, prod = F.col("depth") > 0, (F.col("depth") > 0) & ~F.col("t")
    out = rows.agg(
        F.count_if(prod).alias("prod_callers"),
        F.count_if(caller & F.col("t")).alias("test_callers"),
        F.count_if(prod & (F.col("depth") == 1)).alias("direct"),
        F.count_if(prod & (F.col("depth") > 1)).alias("transitive"),
        F.count_distinct(F.when(prod, F.col("path"))).alias("files"),
        F.count_if(caller & F.col("route").isNotNull()).alias("routes"),
        F.min(F.when(F.col("depth") == 0, F.col("type"))).alias("kind"),
    )
    return out.select("prod_callers", "test_callers", "direct", "transitive", "files", "routes", P.risk_level(F.col("prod_callers"), F.col("routes"), removal, F.col("kind")).alias("risk"))


def risk_by_function(g: Graph) -> DataFrame:
    """(node_id, callers, risk) of every function and method by its direct production callers."""
    n = g.located("name", "type", "is_test")
    src = n.select(F.col("id").alias("_s"), P.is_test(F.col("name"), F.col("path"), F.col("is_test")).alias("_t"))
    e = g.edges.where(F.col("relation") == S.CALLS).join(src, F.col("source_id") == F.col("_s")).where("not _t")
    counts = e.groupBy(F.col("target_id").alias("_n")).agg(F.count(F.lit(1)).alias("callers"))
    f = n.where(F.col("type").isin("function", "method")).join(counts, F.col("id") == F.col("_n"), "left")
    f = f.select(F.col("id").alias("node_id"), F.coalesce("callers", F.lit(0)).alias("callers"))
    return f.withColumn("risk", P.risk_level(F.col("callers"), F.lit(0), False))


#: What may follow a name for it to count as used in a text.
DELIMITERS = ["(", ")", ",", " ", ";", "\n", ":", "<", ".", "{", "}"]


def dead_code(g: Graph, prefix: str | None = None, kind: str | None = None, include_tests: bool = False, min_lines: int = 1, limit: int = 50) -> DataFrame:
    """Symbols nobody refers to, longest first: no incoming edge, no route, and no mention in another function of the file.

    A mention is the name directly followed by a delimiter, with no left boundary. Candidates are anti-joined on edges first, so that only
    they meet the code of their file.
    """
    keep = (F.col("type") != "module") & ~F.col("name").isin(S.MODULE, "main", "_") & (F.col("path") != S.EXTERNAL)
    keep = keep & ((F.col("end_line") - F.col("start_line") + 1) >= min_lines)
    if not include_tests:
        keep = keep & ~F.coalesce("is_test", F.lit(False))
    if kind is not None:
        keep = keep & F.col("type").isin(P.normalise_type(kind) or [kind])
    if prefix is not None:
        keep = keep & F.startswith(F.lower("path"), F.lit(prefix.lower()))
    n = g.located("name", "type", "start_line", "end_line", "is_test").where(keep)
    used = g.edges.where(F.col("relation").isin(S.CALLS, S.IMPORTS, S.INHERITS, S.IMPLEMENTS) | ((F.col("relation") == S.ROUTES_TO) & (F.col("source_id") == F.col("target_id"))))
    n = n.join(used.select(F.col("target_id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left_anti")
    other = g.nodes.where(F.col("type").isin("function", "method")).select(F.col("file_id").alias("_f"), F.col("id").alias("_o"), F.col("code_content").alias("_code"))
    said = F.lit(False)
    for d in DELIMITERS:
        said = said | F.contains("_code", F.concat("name", F.lit(d)))
    mention = (F.col("file_id") == F.col("_f")) & (F.col("id") != F.col("_o")) & (F.length("name") >= 3) & said
    n = n.join(other, mention, "left_anti")
    x = g.edges.where(F.col("relation") == S.EXPORTS).select(F.col("target_id").alias("_x")).distinct()
    n = n.join(x, F.col("id") == F.col("_x"), "left").withColumn("has_export", F.col("_x").isNotNull())
    n = n.withColumn("lines", F.col("end_line") - F.col("start_line") + 1).orderBy(F.desc("lines"), "id").limit(limit)
    return n.select("id", "name", "type", "path", "lines", "has_export")


def classified_dead_code(g: Graph, **filters) -> DataFrame:
    """``dead_code`` with category 'exported_unused' or 'orphan'."""
    rows = dead_code(g, **filters)
    head = g.nodes.select(F.col("id").alias("_i"), F.substring("code_content", 1, 4).alias("_head"))
    rows = rows.join(head, F.col("id") == F.col("_i"))
    public = F.col("has_export") | F.coalesce(F.col("_head").isin("pub ", "pub("), F.lit(False)) | (F.col("path").endswith(".go") & F.col("name").rlike(r"^\p{Lu}"))
    return rows.select("id", "name", "type", "path", "lines", F.when(public, "exported_unused").otherwise("orphan").alias("category"))


def project_map(g: Graph) -> DataFrame:
    """(dir, files, symbols, languages, key_symbols, depends_on): one row a directory."""
    deps = module_dependencies(g).groupBy(F.col("dir_from").alias("_d")).agg(F.array_join(F.array_sort(F.collect_set("dir_to")), ",").alias("depends_on"))
    keys = key_symbols(g).select(F.col("dir").alias("_k"), F.col("names").alias("key_symbols"))
    rows = module_stats(g).join(keys, F.col("dir") == F.col("_k"), "left").join(deps, F.col("dir") == F.col("_d"), "left")
    return rows.select("dir", "files", "symbols", "languages", "key_symbols", "depends_on")


def show_node(g: Graph, name: str | None = None, path: str | None = None, node_id: int | None = None) -> DataFrame:
    """A symbol, by id or by name and file, with its counts of references by relation group; ``Type.method`` means the qualified name."""
    named = F.col("id") == node_id if node_id is not None else F.col("qualified_name" if "." in name else "name") == name
    n = g.located("name", "qualified_name", "type", "start_line", "end_line", "signature").where(named & (F.lit(True) if path is None else F.col("path") == path))
    e = g.edges.groupBy(F.col("target_id").alias("_t")).agg(F.count_if(F.col("relation") == S.CALLS).alias("callers"), F.count(F.lit(1)).alias("references"))
    rows = n.join(e, F.col("id") == F.col("_t"), "left")
    return rows.select("id", "name", "type", "path", "start_line", "end_line", "signature", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("references", F.lit(0)).alias("references"))


def route_table(g: Graph) -> DataFrame:
    return routes(g).select("target_id", "method", "route", "inline")
