"""Token estimates, compression levels and compact forms (inventory L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import schema as S
from codeloom.functions import predicates as P


def size_bytes() -> Column:
    """Bytes a node is counted with: its context, else code, name and signature."""
    own = F.coalesce(F.octet_length("code_content"), F.lit(0)) + F.coalesce(F.octet_length("name"), F.lit(0)) + F.coalesce(F.octet_length("signature"), F.lit(0))
    return F.coalesce(F.octet_length("context_string"), own)


def estimate_tokens(rows: DataFrame) -> DataFrame:
    """One row with tokens: bytes by three, rounded down."""
    return rows.agg(F.floor(F.coalesce(F.sum(size_bytes()), F.lit(0)) / S.CHARS_PER_TOKEN).cast("long").alias("tokens"))


def level(tokens: Column, threshold: int = S.COMPRESSION_TOKENS) -> Column:
    return F.when(tokens <= threshold, "none").when(tokens <= 3 * threshold, "nodes").when(tokens <= 8 * threshold, "files").otherwise("directories")


def node_summaries(rows: DataFrame) -> DataFrame:
    """(id, path, summary): 'type name in path (lines a-b) signature'."""
    text = F.concat(
        "type", F.lit(" "), "name", F.lit(" in "), "path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" "), "signature"), F.lit("")),
    )
    return rows.select("id", "path", text.alias("summary"))


def by_file(rows: DataFrame) -> DataFrame:
    """(path, summary) of a bounded result: 'path: [type name, ..] (n symbols)' in id order."""
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(" ", "type", "name").alias("s")))), lambda x: x["s"])
    return rows.groupBy("path").agg(symbols.alias("a")).select(
        "path", F.concat("path", F.lit(": ["), F.array_join("a", ", "), F.lit("] ("), F.size("a").cast("string"), F.lit(" symbols)")).alias("summary")
    )


def by_directory(rows: DataFrame) -> DataFrame:
    """(path, summary): 'directory: n files, n symbols'."""
    out = rows.groupBy(P.directory(F.col("path")).alias("path")).agg(F.count_distinct("path").alias("f"), F.count(F.lit(1)).alias("s"))
    return out.select("path", F.concat("path", F.lit(": "), F.col("f").cast("string"), F.lit(" files, "), F.col("s").cast("string"), F.lit(" symbols")).alias("summary"))


def compress(rows: DataFrame, threshold: int = S.COMPRESSION_TOKENS) -> tuple[str, DataFrame]:
    """(level, frame) of a bounded result."""
    tokens = estimate_tokens(rows).select(level(F.col("tokens"), threshold).alias("l")).first()["l"]
    return tokens, {"none": lambda: rows, "nodes": lambda: node_summaries(rows), "files": lambda: by_file(rows), "directories": lambda: by_directory(rows)}[tokens]()


def head_and_tail(array: Column, most: int = 20, head: int = 10, tail: int = 5) -> Column:
    """Arrays of more than ``most`` elements cut to their first and last ones."""
    return F.when(F.size(array) > most, F.concat(F.slice(array, 1, head), F.slice(array, -tail, tail))).otherwise(array)


def truncated(text: Column, budget: Column | int, most: int = 200) -> Column:
    """Texts of more than ``most`` characters cut to the budget, with a mark."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(F.length(text) > F.greatest(F.lit(most), budget), F.concat(F.substring(text, F.lit(1), budget), F.lit("..."))).otherwise(text)


def snippet(text: Column, most: int = 500) -> Column:
    """The first ``most`` bytes, back to the last line end, or to the last whole character where there is none."""
    raw = F.encode(text, "UTF-8")
    # a cut inside a character leaves at most three bytes of it
    head = reduce(lambda out, k: F.coalesce(out, F.try_validate_utf8(F.substring(raw, F.lit(1), F.lit(most - k)).cast("string"))), range(4), F.lit(None).cast("string"))
    return F.when(F.octet_length(text) <= most, text).when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*$", "")).otherwise(head)


def shorten(rows: DataFrame, budget: int, most: int = 200, depth: int = 8) -> DataFrame:
    """A result cut to about ``budget`` characters a row: texts over ``most`` characters share what the short ones leave, in proportion to their length; arrays keep their ends.

    ``truncated_fields`` lists the columns that were cut. Structs and arrays of structs are entered down to ``depth`` levels; what is below becomes null.
    """
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    arrays = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)]
    size = {c: F.coalesce(F.length(c), F.lit(0)) for c in texts}
    short = sum((F.when(n <= most, n).otherwise(0) for n in size.values()), F.lit(0))
    long = sum((F.when(n > most, n).otherwise(0) for n in size.values()), F.lit(0))
    rest = F.greatest(F.lit(budget) - short, F.lit(0))
    out, flags = [], []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if f.name in texts:
            share = F.greatest(F.lit(most), F.floor(F.try_divide(rest * size[f.name], long)).cast("int"))
            cut = (size[f.name] > most) & (size[f.name] > share)
            flags.append(F.when(cut, f.name))
            out.append(F.when(cut, F.concat(F.substring(c, F.lit(1), share), F.lit("..."))).otherwise(c).alias(f.name))
        elif f.name in arrays:
            flags.append(F.when(F.size(c) > 20, f.name))
            out.append(_shallow(head_and_tail(c), f.dataType, depth - 1).alias(f.name))
        else:
            out.append(_shallow(c, f.dataType, depth - 1).alias(f.name))
    return rows.select(*out, F.array_compact(F.array(*flags) if flags else F.array().cast("array<string>")).alias("truncated_fields"))


def _shallow(c: Column, kind: T.DataType, depth: int) -> Column:
    """A value without what lies deeper than ``depth`` levels; arrays inside are cut to their ends."""
    nested = isinstance(kind, (T.StructType, T.ArrayType))
    if nested and depth <= 0:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.named_struct(*[x for f in kind.fields for x in (F.lit(f.name), _shallow(c[f.name], f.dataType, depth - 1))]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(head_and_tail(c), lambda x: _shallow(x, kind.elementType, depth - 1))
    return c


#: Columns of the compact form of each tool's result; a tool that is not listed gives one line a row.
COMPACT = {
    "semantic_code_search": ["id", "name", "path", "start_line", "relevance"],
    "get_call_graph": ["name", "path", "depth", "direction"],
    "get_ast_node": ["id", "name", "path", "start_line", "end_line", "signature"],
    "find_references": ["name", "path", "relation"],
    "find_dead_code": ["name", "path", "category"],
    "project_map": ["dir", "symbols", "key_symbols"],
    "module_overview": ["section", "names"],
    "dependency_graph": ["path", "depth"],
    "find_similar_code": ["node_id", "name", "similarity"],
}


def compact(rows: DataFrame, tool: str) -> DataFrame:
    """The compact form of a tool's result: its most telling columns, where present."""
    if tool in COMPACT:
        return rows.select(*[c for c in COMPACT[tool] if c in rows.columns])
    return rows.select(compact_line().alias("line"))


def compact_line() -> Column:
    """'type name path:start-end', with the signature where there is one."""
    at = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.concat_ws(" ", "type", "name", at, "signature")
