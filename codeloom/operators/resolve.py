"""Edge construction from parsed relations (inventory I)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import predicates as P
from codeloom.graph import Graph
from codeloom.storage import Scratch


def _key(*parts: Column) -> list[Column]:
    """128 bits of some columns, as two long columns: what strings are joined by."""
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _directory(path: Column, level: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), level), "/")


def _next(path: Column, level: Column) -> Column:
    """The bytes, in hex, of the component that follows the directory of a level."""
    return F.hex(F.encode(F.element_at(F.split(path, "/"), level + 1), "UTF-8"))


def _levels(path: Column) -> Column:
    return F.sequence(F.lit(0), F.size(F.split(path, "/")) - 1)


def _lengths(next_: Column) -> Column:
    """The lengths in hex digits of all beginnings of whole bytes, the empty one too."""
    return F.sequence(F.lit(0), F.length(next_), F.lit(2))


def query_key(name: Column, path: Column, language: Column) -> list[Column]:
    return _key(name, path, F.coalesce(F.concat(F.lit("="), language), F.lit("")))


def nearest_targets(wanted: DataFrame, symbols: DataFrame, scratch: Scratch) -> DataFrame:
    """(q1, q2, target_id), written: for each distinct (name, path, language) of ``wanted`` (its ``query_key``) the symbols of the name and a compatible language that share the longest path prefix in bytes.

    For callers outside tests those outside tests go first. The prefix is found from the deepest directory that both have, then byte by byte in
    the component that follows: each step is an equality join of 128-bit keys with the distinct (name, family, prefix) of the symbols, never with all symbols
    of a name. Only what is in the result is joined with symbols.
    """
    none, all_ = "?", "*"
    family = F.coalesce(P.language_family(F.col("language")), F.lit(none))
    sides = F.when(F.col("language").isNull(), F.array(F.lit(all_))).otherwise(F.array(family, F.lit(none)))
    on = lambda df: df.select([F.col(c).alias(f"_{c}") for c in df.columns])
    match = lambda *cs: reduce(and_, [F.col(c) == F.col(f"_{c}") for c in cs])
    keyed = lambda df, *parts: df.withColumn("k1", _key(*parts)[0]).withColumn("k2", _key(*parts)[1])

    w = wanted.select("name", "path", "language").where("name is not null and path is not null").distinct()
    names = w.select(F.col("name").alias("_n")).distinct()
    s = symbols.where("path is not null").join(names, F.col("name") == F.col("_n"), "left_semi")
    s = s.select("id", "name", "path", F.explode(F.array(family, F.lit(all_))).alias("family"), (~P.is_test_path(F.col("path"))).alias("main"))
    s = scratch.save(s)

    # is there a target at all, and one outside tests
    have = s.groupBy(F.col("name").alias("_n"), F.col("family").alias("_f")).agg(F.max("main").alias("_main"))
    q = w.withColumn("family", F.explode(sides)).join(have, (F.col("name") == F.col("_n")) & (F.col("family") == F.col("_f")))
    q = q.groupBy("name", "path", "language").agg(F.max("_main").alias("_main")).withColumn("main", F.col("_main") & ~P.is_test_path(F.col("path"))).drop("_main")
    q1, q2 = query_key(F.col("name"), F.col("path"), F.col("language"))
    q = scratch.save(q.withColumn("q1", q1).withColumn("q2", q2))
    asked = q.withColumn("family", F.explode(sides))

    # the deepest directory
    kinds = F.explode(F.when(F.col("main"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    some = s.select("id", "name", "path", "family", kinds.alias("main"))
    some = some.join(on(asked.select("name", "family", "main").distinct()), match("name", "family", "main"), "left_semi")  # what is asked for at all
    parts = (F.col("name"), F.col("family"), F.col("main"), _directory(F.col("path"), F.col("level")))
    placed = some.withColumn("level", F.explode(_levels(F.col("path"))))
    placed = scratch.save(keyed(placed, *parts).select("id", "k1", "k2", _next(F.col("path"), F.col("level")).alias("next")), replaces=s)
    tried = keyed(asked.withColumn("level", F.explode(_levels(F.col("path")))), *parts).select("q1", "q2", "level", "k1", "k2")
    level = tried.join(on(placed.select("k1", "k2").distinct()), match("k1", "k2"), "left_semi").groupBy("q1", "q2").agg(F.max("level").alias("level"))
    deep = asked.join(on(level), match("q1", "q2")).withColumn("level", F.col("_level"))
    deep = scratch.save(keyed(deep, *parts).select("q1", "q2", "k1", "k2", _next(F.col("path"), F.col("level")).alias("next")))

    # the longest beginning of the component that follows it
    begin = (F.col("k1"), F.col("k2"), F.substring(F.col("next"), F.lit(1), F.col("n")))
    near = placed.join(on(deep.select("k1", "k2").distinct()), match("k1", "k2"), "left_semi").withColumn("n", F.explode(_lengths(F.col("next"))))
    b1, b2 = _key(*begin)
    near = scratch.save(near.select("id", b1.alias("b1"), b2.alias("b2")), replaces=placed)
    tried = deep.withColumn("n", F.explode(_lengths(F.col("next")))).select("q1", "q2", "n", b1.alias("b1"), b2.alias("b2"))
    longest = tried.join(on(near.select("b1", "b2").distinct()), match("b1", "b2"), "left_semi").groupBy("q1", "q2").agg(F.max("n").alias("n"))
    best = tried.join(on(longest), match("q1", "q2", "n"), "left_semi").select("q1", "q2", "b1", "b2")
    out = scratch.save(best.join(on(near), match("b1", "b2")).select("q1", "q2", F.col("_id").alias("target_id")), replaces=near)
    for table in (deep, q):
        scratch.drop(table)
    return out


def resolve(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Targets of parsed relations by name, in tiers.

    ``relations``: rel_id, source_id, path, language, target_name, relation; ``symbols``: id, name, path, language, an id with one name and path. Tier 1 is a symbol of the same
    file, tier 2 one of a compatible language (calls of noise names stop before it), tier 3 any symbol, for relations other than calls.
    Of several tier 2 targets those outside tests are preferred for callers outside tests, then all that share the longest path prefix with
    the caller (``nearest_targets``). Self edges are only kept for routes. Noise names are filtered before the join, so they cannot make hot keys.
    """
    scratch = Scratch(relations.sparkSession)
    # repeated rows go before they are multiplied: what follows gives each pair of a relation and a target once
    symbols = scratch.save(symbols.select("id", "name", "path", "language").distinct())
    s = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("_name"), F.col("path").alias("_path"))
    call = F.col("relation") == S.CALLS
    relations = scratch.save(relations.select("rel_id", "source_id", "path", "language", "target_name", "relation").distinct())
    local = relations.join(s, (F.col("target_name") == F.col("_name")) & (F.col("path") == F.col("_path"))).withColumn("tier", F.lit(1))
    done = local.select(F.col("rel_id").alias("_done")).distinct()
    rest = relations.join(done, F.col("rel_id") == F.col("_done"), "left_anti").where(~(call & F.col("target_name").isin(P.NOISE_NAMES)))
    rest = scratch.save(rest)
    near = nearest_targets(rest.select(F.col("target_name").alias("name"), "path", "language"), symbols.select("id", "name", "path", "language"), scratch)
    q1, q2 = query_key(F.col("target_name"), F.col("path"), F.col("language"))
    rest = rest.withColumn("_a", q1).withColumn("_b", q2)
    same = (F.col("_a") == F.col("q1")) & (F.col("_b") == F.col("q2"))
    far = rest.join(near, same).withColumn("tier", F.lit(2))
    other = rest.where(~call).join(near.select("q1", "q2").distinct(), same, "left_anti")
    any_ = other.join(s.drop("_path"), F.col("target_name") == F.col("_name")).withColumn("tier", F.lit(3))
    columns = ["rel_id", "source_id", "target_id", "relation", "tier"]
    rows = local.select(*columns).unionByName(far.select(*columns)).unionByName(any_.select(*columns))
    return rows.where((F.col("source_id") != F.col("target_id")) | (F.col("relation") == S.ROUTES_TO))


def module_suffixes(files: DataFrame) -> DataFrame:
    """(module, path): every dotted suffix of the Python module of a path; ``__init__`` stands for its package."""
    p = files.where(F.col("path").endswith(".py")).select("path", F.split(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", ""), "/").alias("a"))
    p = p.where((F.size("a") > 0) & (F.element_at("a", -1) != ""))
    suffix = F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: F.array_join(F.slice("a", i, F.size("a")), "."))
    return p.select(F.explode(suffix).alias("module"), "path").distinct()


def unresolved_modules(g: Graph) -> DataFrame:
    """(module): Python modules of import edges that no file of the graph provides; they become external sentinels."""
    wanted = g.edges.where(F.col("relation") == S.IMPORTS).select(F.get_json_object("metadata", "$.python_module").alias("module")).where("module is not null").distinct()
    known = module_suffixes(g.files).select(F.col("module").alias("_m"))
    return wanted.join(known, F.col("module") == F.col("_m"), "left_anti")


def resolve_modules(imports: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, outside) of Python imports by their module.

    ``imports``: rel_id, source_id, target_name, python_module, is_module_import. Targets (rel_id, source_id, target_id) are the symbols of that name in
    the files of the module, its module node for ``import x``; ``outside`` has the imports whose module no file provides.
    """
    known = module_suffixes(files).select(F.col("module").alias("_m"), F.col("path").alias("_mp"))
    outside = imports.join(known, F.col("python_module") == F.col("_m"), "left_anti")
    s = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("_name"), F.col("path").alias("_path"))
    wanted = F.when(F.coalesce("is_module_import", F.lit(False)), F.lit(S.MODULE)).otherwise(F.col("target_name"))
    inside = imports.withColumn("_want", wanted).join(known, F.col("python_module") == F.col("_m")).join(s, (F.col("_mp") == F.col("_path")) & (F.col("_want") == F.col("_name")))
    return inside.select("rel_id", "source_id", "target_id").distinct(), outside


def sentinels(names: DataFrame, kind: str | None = None) -> DataFrame:
    """Sentinel nodes (id, file_id, type, name) under the external pseudo-file for the names (column name), all of one kind or of column kind; one node a name.

    Of several kinds of a name 'external_module' comes before 'trait' before 'module'.
    """
    kinds = F.col("kind") if kind is None else F.lit(kind)
    order = F.when(kinds == "external_module", 0).when(kinds == "trait", 1).otherwise(2)
    rows = names.select("name", kinds.alias("type"), order.alias("_o")).groupBy("name").agg(F.min_by("type", "_o").alias("type"))
    return rows.select(F.xxhash64(F.lit(S.EXTERNAL), "name").alias("id"), F.xxhash64(F.lit(S.EXTERNAL)).alias("file_id"), "type", "name")


def context_strings(g: Graph, only: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(id, context_string): the labelled text document of each node.

    Routes, calls and callers are cut to ``most`` names (calls and callers say how many more); names are sorted. ``only`` (column id) restricts the nodes.
    """
    n = g.located("type", "name", "qualified_name", "signature", "return_type", "param_types", "doc_comment", "code_content").where(F.col("path") != S.EXTERNAL)
    if only is not None:
        n = n.join(only.select(F.col("id").alias("_o")).distinct(), F.col("id") == F.col("_o"), "left_semi")
    names = g.nodes.select(F.col("id").alias("_n"), F.col("name").alias("_name"))
    e = g.edges.select("source_id", "target_id", "relation", "metadata")
    out = e.join(names, F.col("target_id") == F.col("_n")).select(
        F.col("source_id").alias("_id"),
        F.when(F.col("relation") == S.ROUTES_TO, "routes").otherwise(F.col("relation")).alias("k"),
        F.when(F.col("relation") == S.ROUTES_TO, P.route_text(F.col("metadata"), F.col("_name"))).otherwise(F.col("_name")).alias("v"),
    )
    back = e.where(F.col("relation") == S.CALLS).join(names, F.col("source_id") == F.col("_n")).select(F.col("target_id").alias("_id"), F.lit("called_by").alias("k"), F.col("_name").alias("v"))
    # names are distinct and only the first few of a group are kept, so a hot target is cut before it is gathered
    both = out.unionByName(back).distinct()
    totals = both.groupBy("_id", "k").agg(F.count(F.lit(1)).alias("total"))
    salted = both.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(32)))
    part = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_id", "k", "_s").orderBy("v"))).where((F.col("_r") <= most) | ~F.col("k").isin("routes", S.CALLS, "called_by"))
    rows = part.groupBy("_id", "k").agg(F.array_sort(F.collect_list("v")).alias("vs")).join(totals.select(F.col("_id").alias("_i2"), F.col("k").alias("_k2"), "total"), (F.col("_id") == F.col("_i2")) & (F.col("k") == F.col("_k2")))
    cut = F.when(F.col("k").isin("routes", S.CALLS, "called_by"), F.slice("vs", 1, most)).otherwise(F.col("vs"))
    more = F.when(F.col("k").isin(S.CALLS, "called_by") & (F.col("total") > most), F.concat(F.lit(" (+"), (F.col("total") - most).cast("string"), F.lit(")"))).otherwise("")
    rows = rows.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.concat(F.array_join(cut, ", "), more)))).alias("m"))
    n = n.join(rows, F.col("id") == F.col("_id"), "left")
    label = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c))
    filled = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    parts: list[Column] = [
        label("signature", F.col("signature")),
        filled("returns", F.col("return_type")),
        filled("params", F.col("param_types")),
        F.concat_ws(" ", "type", F.coalesce("qualified_name", "name")),
        F.when(F.col("language").isNotNull(), F.concat_ws(" in ", "language", "path")).otherwise(F.concat(F.lit("in "), F.col("path"))),
        *[label(k, F.element_at("m", k)) for k in ("routes", S.CALLS, "called_by", S.INHERITS, S.IMPORTS, S.IMPLEMENTS, S.EXPORTS)],
        label("doc", F.col("doc_comment")),
        label("code", F.col("code_content")),
    ]
    return n.select("id", F.concat_ws("\n", *parts).alias("context_string"))
