"""Queries of search, vectors and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import identifiers as I
from codeloom.graph import Graph
from codeloom.operators import search as Q
from codeloom.operators.dedupe import one_per_key
from codeloom.plans.graph_queries import graph, sql, _test
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()

QUERY = "parse node index"
TERMS = ["index", "node", "parse"]
_PLAIN = "".join(I.MARKED.values())
_ASCII = "".join(c * len(ms) for c, ms in I.MARKED.items())


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({c}), '{_PLAIN}', '{_ASCII}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25(rel: str, key: str, weights: dict[str, float], forms: dict[str, str] | None = None) -> str:
    parts = " union all ".join(f"select {key}, {w} as w, unnest({_tokens(c)}) as term from {rel}" for c, w in weights.items())
    terms = ", ".join(f"'{t}'" for t in forms or TERMS)
    term = "term" if forms is None else "case " + " ".join(f"when term = '{w}' then '{s}'" for w, s in forms.items()) + " end"
    return f"""tok as ({parts}), len as (select {key}, count(*) dl from tok group by 1),
    st as (select (select count(*) from {rel}) as nn, (select sum(dl) from len) / (select count(*) from {rel}) as av),
    tf as (select {key}, {term} as term, sum(w) tw from tok where term in ({terms}) group by 1, 2), df as (select term, count(*) df from tf group by 1),
    sc as (select tf.{key}, sum(greatest(ln((nn - df + 0.5) / (df + 0.5)), 1e-6) * tw * 2.2 / (tw + 1.2 * (0.25 + 0.75 * dl / av))) score, count(*) matched from tf join df using (term) join len using ({key}), st group by 1)"""


_DOCS = "dd as (select doc_id, text from documents where doc_id is not null qualify row_number() over (partition by doc_id order by text) = 1)"


def _documents(spark, d):
    return one_per_key(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _scored_documents(spark, d):
    posts, n, average = Q.postings(_documents(spark, d), "doc_id", {"text": 1.0}, Q.exact_terms(TERMS))
    return Q.bm25(posts, "doc_id", TERMS, n, average)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@R.query("bm25_or", f"with {_DOCS}, {_bm25('dd', 'doc_id', {'text': 1.0})} select doc_id, round(score, 6) score, matched from sc order by round(score, 9) desc, doc_id limit 50")
def bm25_or(spark, d):
    return _rounded(_scored_documents(spark, d).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(50))


@R.query(
    "bm25_and",
    f"""with {_DOCS}, {_bm25('dd', 'doc_id', {'text': 1.0})}, a as (select least(count(*), 20) k from sc where matched = 3)
    select doc_id, round(score, 6) score, matched, (select k from a) < 3 as or_fallback from sc where matched = 3 or (select k from a) < 3 order by round(score, 9) desc, doc_id limit 20""",
)
def bm25_and(spark, d):
    return _rounded(Q.and_then_or(_scored_documents(spark, d), 3, 20, "doc_id"))


@R.query("bm25_columns", sql(
    f"{_bm25('n', 'id', Q.COLUMN_WEIGHTS)}, k as (select * from sc where id not in (select id from n where is_test)), a as (select least(count(*), 20) k from k where matched = 3) "
    "select id, round(score, 6) score, matched, (select k from a) < 3 as or_fallback from k where matched = 3 or (select k from a) < 3 order by round(score, 9) desc, id limit 20"
))
def bm25_columns(spark, d):
    return _rounded(Q.text_search(graph(spark, d), QUERY, 20, stemmed=False))


#: The words that have the stems of the query.
_FORMS = {w: s for s, words in {"pars": "pars parse parses parsed parsing", "node": "node nodes noded noding", "index": "index indexs indexes indexed indexing"}.items() for w in words.split()}


@R.query("porter_search", sql(
    f"{_bm25('n', 'id', Q.COLUMN_WEIGHTS, _FORMS)}, k as (select * from sc where id not in (select id from n where is_test)), a as (select least(count(*), 20) k from k where matched = 3) "
    "select id, round(score, 6) score, matched, (select k from a) < 3 as or_fallback from k where matched = 3 or (select k from a) < 3 order by round(score, 9) desc, id limit 20"
))
def porter_search(spark, d):
    return _rounded(Q.text_search(graph(spark, d), "parsing nodes indexes", 20))


@R.query("token_stats", f"with {_DOCS}, t as (select unnest({_tokens('text')}) as term from dd) select count(*) tokens, count(distinct term) terms from t")
def token_stats(spark, d):
    t = _documents(spark, d).select(F.explode(Q.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("terms"))


# --- vectors -----------------------------------------------------------------------

_ALL = "vv as (select vec_id, cast(embedding as double[]) v from embeddings), qq as (select v from vv where vec_id = (select min(vec_id) from vv))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def _query_vector(v):
    return list(v.orderBy("node_id").limit(1).first()["embedding"])


@R.query("vector_topk", f"with {_ALL} select vec_id node_id, round(list_distance(v, (select v from qq)), 5) distance from vv order by round(list_distance(v, (select v from qq)), 9), vec_id limit 20")
def vector_topk(spark, d):
    v = _vectors(spark, d)
    return Q.vector_search(v, _query_vector(v), 20).withColumn("distance", F.round("distance", 5))


@R.query("vector_cosine", f"with {_ALL} select vec_id node_id, round(1 - list_cosine_similarity(v, (select v from qq)), 5) distance from vv order by 1 - list_cosine_similarity(v, (select v from qq)), vec_id limit 20")
def vector_cosine(spark, d):
    v = _vectors(spark, d)
    return Q.vector_search(v, _query_vector(v), 20, "cosine").withColumn("distance", F.round("distance", 5))


def _many(dist: str) -> str:
    return f"""with vv as (select vec_id, cast(embedding as double[]) v from embeddings), d as (select q.vec_id query_id, a.vec_id node_id, {dist} d from vv q, vv a where q.vec_id % 50 = 0)
    select query_id, node_id, round(d, 5) distance from d qualify row_number() over (partition by query_id order by round(d, 9), node_id) <= 20"""


def _search_many(spark, d, metric):
    v = _vectors(spark, d)
    return Q.vector_search_many(v, v.where("node_id % 50 = 0"), 20, metric).withColumn("distance", F.round("distance", 5))


@R.query("vector_topk_many", _many("list_distance(a.v, q.v)"))
def vector_topk_many(spark, d):
    """The nearest vectors to every vector whose id is divisible by 50."""
    return _search_many(spark, d, "l2")


@R.query("vector_cosine_many", _many("1 - list_cosine_similarity(a.v, q.v)"))
def vector_cosine_many(spark, d):
    return _search_many(spark, d, "cosine")


@R.query("embedding_coverage", sql("select count(vec_id) embedded, count(*) embeddable from (select id from n where context_string is not null) left join (select distinct vec_id from embeddings) on vec_id = id"))
def embedding_coverage(spark, d):
    from codeloom.operators.lookups import embedding_coverage as coverage

    return coverage(graph(spark, d).with_vectors(_vectors(spark, d)))


def _with_vectors(spark, d) -> tuple[Graph, int]:
    """The graph with the embedding table as vectors of the nodes from id 1000 on, and the first node that has one."""
    g = graph(spark, d)
    vectors = _vectors(spark, d).select((F.col("node_id") + 1000).alias("node_id"), "embedding")
    some = g.located("name").where("name <> '<module>' and path <> '<external>'").join(vectors.select(F.col("node_id").alias("_v")), F.col("id") == F.col("_v"), "left_semi")
    return g.with_vectors(vectors), some.agg(F.min("id")).first()[0]


_NODE_VECTORS = """ni as (select id from loc where name <> '<module>' and path <> '<external>'), nv as (select vec_id + 1000 node_id, cast(embedding as double[]) v from embeddings),
q0 as (select node_id, v from nv where node_id = (select min(id) from ni where id in (select node_id from nv)))"""


@R.query("similar_items", sql(
    f"{_NODE_VECTORS}, near as (select nv.node_id, list_distance(nv.v, (select v from q0)) dist from nv order by 2, 1 limit 31), c as (select node_id, dist, count_if(dist > 1.5) over () dropped from near where node_id <> (select node_id from q0)) "
    f"select c.node_id, name, path, round(1 / (1 + dist), 4) similarity, dropped cutoff_dropped from c join loc on loc.id = c.node_id where dist <= 1.5 and name <> '<module>' and path <> '<external>' and not {_test('name', 'path', 'is_test')} order by dist, c.node_id limit 10"
))
def similar_items(spark, d):
    g, first = _with_vectors(spark, d)
    return Q.similar_nodes(g, first, 10, cutoff=1.5)


_RRF = f"""{_DOCS}, {_bm25('dd', 'doc_id', {'text': 1.0})}, {_ALL},
tx as (select doc_id id, 1.0 w, row_number() over (order by score desc, doc_id) - 1 rk, score as raw from (select doc_id, round(score, 9) score from sc order by round(score, 9) desc, doc_id limit 40)),
vx as (select vec_id id, 1.2 w, row_number() over (order by s desc, vec_id) - 1 rk, s as raw from (select vec_id, round(1 - list_distance(v, (select v from qq)), 9) s from vv order by s desc, vec_id limit 40)),
u as (select *, max(raw) over () mx from tx union all select *, max(raw) over () from vx),
fu as (select id, sum(w / (30 + rk + 1) + 0.5 / (31 * 32) * w * case when mx > 0 then greatest(raw, 0) / mx else 0 end) score from u group by 1)"""


def _fused(spark, d, k):
    text = _scored_documents(spark, d).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(40)
    v = _vectors(spark, d)
    near = Q.vector_search(v, _query_vector(v), 40).select(F.col("node_id").alias("id"), F.round(F.lit(1.0) - F.col("distance"), 9).alias("score"))
    lists = Q.ranked(text.withColumnRenamed("doc_id", "id"), "text", 1.0).unionByName(Q.ranked(near.orderBy(F.desc("score"), "id").limit(40), "vector", 1.2))
    return Q.rrf(lists, k)


@R.query("rrf_fusion", f"with {_RRF} select id, round(score, 7) score from fu order by score desc, id limit 40")
def rrf_fusion(spark, d):
    return _fused(spark, d, 40).withColumn("score", F.round("score", 7))


@R.query("hybrid_rerank", sql(
    f"{_RRF}, top as (select id, score from fu order by score desc, id limit 40), m as (select max(score) mx from top), "
    "j as (select top.id, score, least(2.0, 1 + 0.3 * (cast(contains(lower(name), 'index') as int) + cast(contains(lower(name), 'node') as int) + cast(contains(lower(name), 'parse') as int))) boost, end_line - start_line + 1 ln, lang, (select max(score) from top join loc on loc.id = top.id) mx from top join loc on loc.id = top.id) "
    "select id, round(score / mx * 0.85 * 1.0 * boost * case when ln > 100 then 1 / (1 + 0.4 * ln(ln / 100.0)) else 1 end * case when coalesce(lang, '') = 'markdown' then 0.4 else 1 end * 100) / 100 as relevance from j order by relevance desc, score desc, id limit 20"
))
def hybrid_rerank(spark, d):
    g = graph(spark, d)
    n = g.located("name", "start_line", "end_line").withColumnRenamed("id", "_i")
    return Q.rerank(_fused(spark, d, 40).join(n, F.col("id") == F.col("_i")), QUERY, 1.0, 20).select("id", "relevance")


_HYBRID = f"""{_bm25('n', 'id', Q.COLUMN_WEIGHTS, _FORMS)}, {_ALL},
k as (select * from sc where id not in (select id from n where is_test)), a as (select least(count(*), 40) k from k where matched = 3),
th as (select id, score, (select k from a) < 4 as fb from k where matched = 3 or (select k from a) < 4 order by round(score, 9) desc, id limit 40),
vh as (select vec_id + 1000 id, 1 - list_distance(v, (select v from qq)) score from vv order by list_distance(v, (select v from qq)), vec_id limit 40),
li as (select id, 1.0 w, row_number() over (order by score desc, id) - 1 rk, score as raw, max(score) over () mx from th
  union all select id, 1.2, row_number() over (order by score desc, id) - 1, score, max(score) over () from vh),
fu as (select id, sum(w / (30 + rk + 1) + 0.5 / (31 * 32) * w * case when mx > 0 then greatest(raw, 0) / mx else 0 end) score from li group by 1 order by score desc, id limit 40),
nn as (select (select count(*) from th) t, (select count(*) from vh) v, (select count(*) from th join vh using (id)) b, (select coalesce(bool_or(fb), false) from th) o),
cf as (select case when t = 0 and v > 0 then 0.35 else 1.0 end * case when o then 0.6 else 1.0 end
  * case when (case when t > 0 then t else v end) / 40.0 < 0.1 then 0.5 when (case when t > 0 then t else v end) / 40.0 < 0.25 then 0.65 when (case when t > 0 then t else v end) / 40.0 < 0.5 then 0.8 else 1.0 end
  * case when t > 0 and v > 0 and b / least(t, v) < 0.2 then 0.75 else 1.0 end as c from nn),
hr as (select fu.id, fu.score, name, type, path, start_line, end_line, lang, end_line - start_line + 1 ln, max(fu.score) over () ms,
  least(2.0, 1 + 0.3 * (cast(contains(lower(name), 'index') as int) + cast(contains(lower(name), 'node') as int) + cast(contains(lower(name), 'parse') as int))) boost
  from fu join loc on loc.id = fu.id where name <> '<module>' and path <> '<external>' and not {_test('name', 'path', 'is_test')}),
re as (select *, round(score / ms * 0.85 * (select c from cf) * boost * case when ln > 100 then 1 / (1 + 0.4 * ln(ln / 100.0)) else 1 end * case when coalesce(lang, '') = 'markdown' then 0.4 else 1 end * 100) / 100 as relevance from hr)
select id, name, type, path, start_line, end_line, relevance, cast((select c from cf) as double) as confidence from re order by relevance desc, score desc, id limit 10"""


@R.query("hybrid_search", sql(_HYBRID))
def hybrid_search(spark, d):
    g, _ = _with_vectors(spark, d)
    return Q.hybrid_search(g, QUERY, _query_vector(_vectors(spark, d)), 10)


# --- names -------------------------------------------------------------------------

_LIVE = f"k as (select id, name, path, lower(name) low, name_tokens from loc where name <> '<module>' and path <> '<external>' and not {_test('name', 'path', 'is_test')})"


@R.query("fuzzy_name", sql(
    f"{_LIVE} select id, name, path, case when low = 'getnode' then 0 when starts_with(low, 'getnode') then 1 else 2 end as rank from k where contains(low, 'getnode') or coalesce(contains(lower(name_tokens), 'getnode'), false) order by rank, length(name), id limit 10"
))
def fuzzy_name(spark, d):
    return Q.fuzzy_names(graph(spark, d), "getNode")


@R.query("levenshtein_topk", sql(f"{_LIVE} select id, name, path, levenshtein(low, 'upadte') as rank from k where levenshtein(low, 'upadte') <= 2 order by rank, length(name), id limit 10"))
def levenshtein_topk(spark, d):
    return Q.fuzzy_names(graph(spark, d), "upadte")


@R.query("resolve_name", sql(f"k as (select * from loc where not {_test('name', 'path', 'is_test')} and name = 'update') select case when count(*) = 1 then 'Unique' else 'Ambiguous' end as status, count(*) candidates, case when count(*) = 1 then min(id) end as id from k"))
def resolve_name(spark, d):
    return Q.resolve_name(graph(spark, d), "update")


@R.query("query_quality", "with " + _DOCS + ", s as (select doc_id, string_split_regex(trim(split_part(coalesce(text, ''), chr(10), 1)), '\\s+') w from dd), "
    f"k as (select doc_id, len(list_filter(w, lambda t: not list_contains([{', '.join(repr(x) for x in I.STOP_WORDS)}], lower(t)) and octet_length(encode(t)) >= 2)) k from s) "
    "select doc_id, case when k = 0 then 0.3 when k = 1 then 0.4 when k = 2 then 0.7 when k = 3 then 0.85 else 1.0 end as quality from k")
def query_quality(spark, d):
    """The quality factor of the first line of every document taken as a query."""
    words = F.split(F.trim(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))), r"\s+")
    k = F.size(F.filter(words, lambda t: ~F.lower(t).isin(I.STOP_WORDS) & (F.octet_length(t) >= 2)))
    out = F.when(k == 0, 0.3).when(k == 1, 0.4).when(k == 2, 0.7).when(k == 3, 0.85).otherwise(1.0)
    return _documents(spark, d).select("doc_id", out.alias("quality"))
