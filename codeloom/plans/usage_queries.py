"""Queries of usage logs, evaluation, streaming and extraction, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import predicates as P
from codeloom.operators import lookups as L
from codeloom.operators import usage as U
from codeloom.plans.graph_queries import graph, sql
from codeloom.plans.registry import Registry
from codeloom.sources import extract as E
from codeloom.sources import scan
from codeloom.sources.tables import table
from codeloom.storage import checkpoint_root
from codeloom.streaming import incremental as K

R = Registry()

_ONCE = 'u as (select distinct ts, dur_s, v, tools::varchar t, search, "index", tools from usage_sessions)'
_TOOLS = f"with {_ONCE}, x as (select unnest(map_entries(tools)) e from u), t as (select e.key tool, e.value s from x)"


def _sessions(spark, d):
    return U.sessions(table(spark, d, "usage_sessions"))


@R.query("usage_agg", f"{_TOOLS} select tool, sum(s.n)::bigint n, sum(s.ms)::bigint ms, sum(s.err)::bigint err, max(s.max_ms) max_ms, round(sum(s.ms) / nullif(sum(s.n), 0), 6) avg_ms from t group by 1")
def usage_agg(spark, d):
    return U.tool_usage(_sessions(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


@R.query("usage_errors", f"{_TOOLS}, k as (select unnest(map_entries(s.err_kinds)) e from t where s.err_kinds is not null) select e.key kind, sum(e.value)::bigint n from k group by 1")
def usage_errors(spark, d):
    return U.error_kinds(_sessions(spark, d))


@R.query("usage_search_quality", f'with {_ONCE} select count(*) sessions, sum(search.queries)::bigint queries, sum(search.zero)::bigint zero, round(sum(search.avg_quality * search.queries) / nullif(sum(search.queries), 0), 6) avg_quality, sum("index".incr)::bigint incr, max("index".files) files, max("index".full_ms) full_ms from u')
def usage_search_quality(spark, d):
    return U.search_quality(_sessions(spark, d)).withColumn("avg_quality", F.round("avg_quality", 6))


@R.query("usage_windows", f"with {_ONCE} select date_trunc('day', ts) as start, count(*) sessions, sum(coalesce(list_sum([coalesce(x.value.n, 0) for x in map_entries(tools)]), 0))::bigint calls from u group by 1")
def usage_windows(spark, d):
    return K.windowed_usage(_sessions(spark, d))


@R.query("latency", f"{_TOOLS} select quantile_disc(s.ms, 0.5) p50, max(s.ms) p99 from t")
def latency(spark, d):
    return U.latency(_sessions(spark, d).select(F.explode("tools").alias("tool", "s")).select(F.col("s.ms").alias("ms")))


@R.query("query_classify", r"""with q as (select text q from documents where text is not null),
  s as (select trim(regexp_replace(regexp_replace(trim(q, ' '), '^"(.*)"$', '\1'), '^''(.*)''$', '\1'), ' ') s from q),
  w as (select s, string_split_regex(s, '\s+') ws, regexp_matches(s, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') cjk from s),
  k as (select *, len(list_filter(ws, lambda t: (regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*$') and (contains(t, '_') or regexp_matches(t, '[a-z][A-Z]|[A-Z]{2,}|[0-9]'))) or (regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_:./\-]*$') and regexp_matches(t, '[:./\-]')))) / len(ws) share,
    len(list_filter(ws, lambda t: list_contains([%s], lower(t)))) > 0 nat from w),
  c as (select case when s = '' then 'empty' when len(ws) = 1 then case when regexp_matches(s, '^[A-Za-z_][A-Za-z0-9_]*$') and (contains(s, '_') or regexp_matches(s, '[a-z][A-Z]|[A-Z]{2,}|[0-9]')) then 'kw-single'
    when regexp_matches(s, '^[A-Za-z_][A-Za-z0-9_:./\-]*$') and regexp_matches(s, '[:./\-]') then 'kw-qualified' when cjk then 'concept-cjk' else 'kw-word' end
    when cjk then 'concept-cjk' when nat then 'concept-nl' when share >= 0.5 then 'kw-multi' else 'concept-mixed' end bucket from k)
  select bucket, count(*)::bigint n, round(count(*) * 100.0 / sum(count(*)) over (), 1) share from c group by 1""" % ", ".join(repr(x) for x in U.NATURAL))
def query_classify(spark, d):
    q = table(spark, d, "documents").where("text is not null").select(F.col("text").alias("q"))
    return U.query_histogram(q, "q").select("bucket", "n", "share")


@R.query("evaluation", "select round(count_if(not trap and picked is not distinct from expected) / nullif(count_if(not trap), 0), 6) recall, round(count_if(trap and not coalesce(picked in ('Grep', 'Read'), false)) / nullif(count_if(trap), 0), 6) fp_rate, "
    "round((count_if(not trap and picked is not distinct from expected) + count_if(trap and coalesce(picked in ('Grep', 'Read'), false))) / count(*), 6) overall from (select 'h' expected, event_type picked, false trap from events where false union all "
    "select case when event_type = 'view' then 'Grep' else event_type end, case when event_id % 3 = 0 then 'Read' else event_type end, event_type = 'view' from events)")
def evaluation(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "Grep").otherwise(F.col("event_type")).alias("expected"), F.when(F.col("event_id") % 3 == 0, "Read").otherwise(F.col("event_type")).alias("picked"))
    out = U.evaluation(e)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@R.query("majority_vote", "with k as (select user_id query, event_type picked, count(*) k, min(event_id) f from events group by 1, 2) select query, arg_max(picked, (k, -f)) as picked from k group by 1")
def majority_vote(spark, d):
    return U.majority(table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("run"), F.col("event_type").alias("picked")))


#: A message of every form the classes know, and some that several or none fit, with its class.
MESSAGES = [
    ("FOREIGN KEY constraint failed", "fk"), ("Ambiguous symbol 'x': FOREIGN KEY constraint failed", "fk"), ("Indexing in progress", "timeout"), ("busy, retry your request", "timeout"), ("Ambiguous symbol 'run'", "ambiguous"),
    ("Symbol 'x' not found in index", "not_found"), ("path not found in the index", "not_found"), ("query must not be empty", "empty_input"), ("Must pass a query", "empty_input"), ("Usage: grep PATTERN", "empty_input"),
    ("see Usage: grep", "other"), ("ambiguous symbol", "other"), ("", "other"),
]


@R.query("error_kinds", "select event_id, [%s][event_id %% %d + 1] as kind from events" % (", ".join(f"'{k}'" for _, k in MESSAGES), len(MESSAGES)))
def error_kinds(spark, d):
    """The class of an error message of each form, one form an event."""
    text = F.element_at(F.array(*[F.lit(m) for m, _ in MESSAGES]), (F.col("event_id") % len(MESSAGES)).cast("int") + 1)
    return table(spark, d, "events").select("event_id", P.error_kind(text).alias("kind"))


@R.query("cooldown_filter", """with recursive s as (select user_id, event_type, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id, event_type order by ts, event_id) r from events),
  w(user_id, event_type, r, t, last, keep) as (select user_id, event_type, r, t, t, true from s where r = 1
    union all select s.user_id, s.event_type, s.r, s.t, case when s.t - w.last >= 86400 then s.t else w.last end, s.t - w.last >= 86400 from w join s on s.user_id = w.user_id and s.event_type = w.event_type and s.r = w.r + 1)
  select user_id, event_type, t as "at" from w where keep""")
def cooldown_filter(spark, d):
    return K.cooldown(table(spark, d, "events"), ["user_id", "event_type"], "ts", 86_400)


@R.query("grep_documents", r"""with t as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) ls from documents where text is not null),
  x as (select doc_id, ls[i] as content, i from (select *, unnest(range(1, len(ls) + 1)) i from t)), h as (select doc_id, i line, content from x where regexp_matches(content, 'https?://') qualify row_number() over (partition by doc_id order by i) <= 100)
  select doc_id, line, md5(content) as digest from h""")
def grep_documents(spark, d):
    hits = L.grep(table(spark, d, "documents"), "https?://", key="doc_id")
    return hits.select("doc_id", "line", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@R.query("barrel_lines", r"""with f as (select id file_id, path, lower(language) lang from files where id is not null qualify row_number() over (partition by id order by indexed_at desc nulls last, last_modified desc nulls last, content_hash desc nulls last, path desc nulls last, language desc nulls last) = 1),
  n as (select * from nodes where id is not null qualify row_number() over (partition by id order by file_id) = 1),
  t as (select path, lang, string_split(regexp_replace(code_content, '\r\n?', chr(10), 'g'), chr(10))[1:1000] ls from n join f using (file_id) where name = '<module>' and code_content is not null),
  x as (select path, lang, i as line, ls[i] as content, ltrim(ls[i], ' ') as s from (select *, unnest(range(1, len(ls) + 1)) i from t))
  select path, line, content from x where (lang = 'rust' and (starts_with(s, 'pub mod ') or starts_with(s, 'mod ') or starts_with(s, 'pub use ') or starts_with(s, 'use '))) or (lang in ('typescript', 'tsx', 'javascript') and (starts_with(s, 'import ') or (starts_with(s, 'export ') and contains(s, ' from '))))
    or (lang = 'python' and (starts_with(s, 'import ') or (starts_with(s, 'from ') and contains(s, ' import ')))) or (lang in ('go', 'java', 'csharp', 'kotlin') and starts_with(s, 'import ')) or (lang = 'ruby' and (starts_with(s, 'require ') or starts_with(s, 'require_relative ')))
    or (lang = 'php' and (starts_with(s, 'use ') or starts_with(s, 'require ') or starts_with(s, 'include ')))""")
def barrel_lines(spark, d):
    g = graph(spark, d)
    t = g.located("name", "code_content").where(F.col("name") == S.MODULE)
    return scan.barrel_lines(t.select("path", "language", F.col("code_content").alias("text")))


@R.query("udtf_symbols")
def udtf_symbols(spark, d):
    """Symbols that the table function finds in the code of the graph's own functions."""
    E.register(spark)
    g = graph(spark, d)
    src = g.located("type", "code_content").where(F.col("type").isin("function", "method"))
    src.createOrReplaceTempView("codeloom_sources")
    return spark.sql("select s.id, x.node_type, x.name, x.start_line, x.end_line from codeloom_sources s, lateral extract_symbols(s.code_content, s.language) x")


@R.query("extract_relations")
def extract_relations(spark, d):
    src = graph(spark, d).located("type", "code_content").where(F.col("type").isin("function", "method"))
    rel = E.extract(src.select("path", "language", F.col("code_content").alias("source")))[1]
    return rel.groupBy("relation", "source_language").agg(F.count(F.lit(1)).alias("n"))


#: Import lines by language, as the regular expressions of the SQL: the group is the imported name.
_IMPORT_LINES = {
    "rust": r"^\s*(?:pub\s+)?use\s+(?:\w+::)*(\w+);",
    "go": r'^\s*import\s+"(?:[^"/]+/)*([^"/]+)"\s*$',
    "java": r"^\s*import\s+(?:\w+\.)*(\w+)\s*;",
    "csharp": r"^\s*using\s+(?:\w+\.)*(\w+)\s*;",
    "c": r'^\s*#include\s*[<"](?:[^>"/]+/)*([^>"/.]+)(?:\.h)?[>"]',
    "ruby": r"^\s*require(?:_relative)?\s+'(?:[^'/]+/)*([^'/]+)'",
    "python": r"^import\s+(?:\w+\.)*(\w+)\s*$",
}
_NAME_LISTS = {"python": r"^from\s+[\w.]+\s+import\s+([\w, ]+)$", **dict.fromkeys(("javascript", "typescript", "tsx"), r"""^\s*import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['"]""")}


#: Headers on a first line by language: the group is the name.
_HEADERS = {
    "python": r"^(?:async\s+)?def\s+([\p{L}\p{N}_]+)\s*\(",
    "ruby": r"^\s*def\s+(?:self\.)?([\p{L}_][\p{L}\p{N}_]*[?!=]?)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?([\p{L}\p{N}_]+)\s*\(",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([\p{L}_$][\p{L}\p{N}_$]*)",
    **dict.fromkeys(("javascript", "typescript", "tsx"), r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\p{L}_$][\p{L}\p{N}_$]*)\s*\("),
}


@R.query("udtf_headers", sql(
    " union all ".join(
        f"select id, regexp_extract(h, $r${rx}$r$, 1) as name from (select id, lang, string_split(replace(code_content, chr(13), ''), chr(10))[1] h from loc where type in ('function', 'method')) "
        f"where lang = '{lang}' and regexp_matches(h, $r${rx}$r$)"
        for lang, rx in _HEADERS.items()
    )
))
def udtf_headers(spark, d):
    """The function that the table function finds on the first line of each function's code, in seven languages."""
    found = udtf_symbols(spark, d).where((F.col("start_line") == 1) & F.col("node_type").isin("function", "method"))
    own = graph(spark, d).located("type").select(F.col("id").alias("_i"), "language").where(F.col("language").isin(*_HEADERS))
    return found.join(own, F.col("id") == F.col("_i")).select("id", "name")


@R.query("import_relations", sql(
    "ml as (select path, lang, unnest(string_split(replace(code_content, chr(13), ''), chr(10))) l from loc where type = 'module' and code_content is not null), im as ("
    + " union all ".join(
        [f"select path, regexp_extract(l, $r${rx}$r$, 1) t from ml where lang = '{lang}'" for lang, rx in _IMPORT_LINES.items()]
        + [f"select path, unnest(string_split(regexp_extract(l, $r${rx}$r$, 1), ',')) from ml where lang = '{lang}'" for lang, rx in _NAME_LISTS.items()]
    )
    + ") select path, trim(t) target_name, count(*) n from im where trim(t) <> '' group by 1, 2"
))
def import_relations(spark, d):
    """The import relations of the heads of all files, extracted by the parsers of nine languages."""
    heads = graph(spark, d).located("type", "code_content").where(F.col("type") == "module")
    rel = E.extract(heads.select("path", "language", F.col("code_content").alias("source")))[1]
    return rel.where(F.col("relation") == S.IMPORTS).groupBy("path", "target_name").agg(F.count(F.lit(1)).alias("n"))


@R.query("rebuild_graph")
def rebuild_graph(spark, d):
    """The graph built again from the texts of its own files, counted by relation: parse, ids, tiered resolution; and the files not parsed in full."""
    g = graph(spark, d)
    text = g.located("name", "start_line", "code_content").where("code_content is not null")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "code_content"))), lambda x: x["code_content"]), "\n")
    src = text.groupBy("path", "language").agg(whole.alias("source")).withColumn("content_hash", F.sha2("source", 256)).withColumn("last_modified", F.lit(0).cast("long"))
    _, nodes, edges = E.build(src)
    skipped = scan.skip_counts(E.skipped(src)).select(F.concat(F.lit("skipped: "), "skip_reason").alias("relation"), "n")
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).unionByName(nodes.agg(F.lit("nodes").alias("relation"), F.count(F.lit(1)).alias("n"))).unionByName(skipped)


@R.query("stream_usage", f"{_TOOLS.replace('distinct ', '')} select tool, sum(s.n)::bigint n, sum(s.ms)::bigint ms, sum(s.err)::bigint err, max(s.max_ms) max_ms from t group by 1")
def stream_usage(spark, d):
    """The usage table read as a file stream and aggregated to the end of what is there; its last state is the result."""
    rows = table(spark, d, "usage_sessions")
    name = f"usage_{uuid.uuid4().hex[:12]}"
    root = f"{checkpoint_root(spark)}/{name}"
    rows.write.parquet(f"{root}/in")
    out = f"{root}/out"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(out)

    q = K.usage_stream(spark, f"{root}/in").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
