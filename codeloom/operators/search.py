"""Text search, vectors and ranking (inventory G)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import identifiers as I
from codeloom.functions import predicates as P
from codeloom.graph import Graph
from codeloom.storage import Scratch

#: Weight of each indexed column in the text score.
COLUMN_WEIGHTS = {"name": 5.0, "qualified_name": 3.0, "code_content": 2.0, "context_string": 2.0, "doc_comment": 1.0, "name_tokens": 5.0, "return_type": 1.0, "param_types": 1.0}
K1, B = 1.2, 0.75
RRF_K = 30


def tokens(text: Column) -> Column:
    """The alphanumeric tokens of a text in lower case without marks."""
    return F.filter(F.split(I.fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """Porter stems in Arrow batches."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(I.porter)

    return stems(word)


def _weighted(weights: dict[str, float], wanted=None):
    """(arrays, length, occurrences): the token arrays of a row by column weight, and what gives from them its tokens and its (term, w), of the wanted terms alone where given."""
    arrays = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias("t")) for c, w in weights.items()])
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.size(x["t"]))
    some = (lambda t: t) if wanted is None else (lambda t: F.filter(t, wanted))
    flat = lambda a: F.flatten(F.transform(a, lambda x: F.transform(some(x["t"]), lambda t: F.struct(t.alias("term"), x["w"].alias("w")))))
    return arrays, length, flat


def postings(docs: DataFrame, key: str, weights: dict[str, float], wanted=None, scratch: Scratch | None = None) -> tuple[DataFrame, int, float]:
    """((key, term, tf, tf_w, length), rows, average length): occurrences of each term per row, weighted by column, and the row's tokens over all columns.

    ``wanted`` says which terms are needed; others are dropped inside the row, before anything is exploded. Texts are read once: rows and
    average cover the whole collection and are observed while the occurrences are written.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    arrays, length, flat = _weighted(weights, wanted)
    rows = docs.select(key, arrays.alias("_a")).select(key, length(F.col("_a")).alias("length"), flat(F.col("_a")).alias("_p"))
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    held = scratch.save(rows.where(F.size("_p") > 0))
    n, total = int(seen.get["n"]), int(seen.get["total"] or 0)
    out = held.select(key, "length", F.explode("_p").alias("p")).groupBy(key, "p.term", "length").agg(F.count(F.lit(1)).alias("tf"), F.sum("p.w").alias("tf_w"))
    return out, n, total / n if n and total else 1.0


def exact_terms(terms: list[str]):
    return lambda t: t.isin(terms)


def terms_with_stems(stems: list[str]):
    """Terms that may have one of the stems: a stem differs from its words by their ends, so all but its last two letters begin the word."""
    return lambda t: reduce(or_, [F.startswith(t, F.lit(s[: max(1, len(s) - 2)])) for s in stems])


def stemmed_postings(posts: DataFrame, key: str, stems: list[str]) -> DataFrame:
    """``postings`` of words brought to those of stems; the stemmer sees each distinct candidate word once."""
    known = posts.select(F.col("term").alias("_raw")).distinct().withColumn("_stem", stem(F.col("_raw"))).where(F.col("_stem").isin(stems))
    rows = posts.join(known, F.col("term") == F.col("_raw"))
    return rows.groupBy(key, F.col("_stem").alias("term"), "length").agg(F.sum("tf").alias("tf"), F.sum("tf_w").alias("tf_w"))


@dataclass(frozen=True)
class TextIndex:
    """A kept postings table: (id, term, stem, tf, tf_w, length) in ranges of the stem, so that a query reads the row groups of its terms only."""

    posts: DataFrame
    rows: int
    average: float

    @staticmethod
    def build(g: Graph, folder: str, ranges: int = 64) -> "TextIndex":
        posts, n, average = postings(g.texts(*COLUMN_WEIGHTS), "id", COLUMN_WEIGHTS)
        known = posts.select(F.col("term").alias("_raw")).distinct().withColumn("stem", stem(F.col("_raw")))
        rows = posts.join(known, F.col("term") == F.col("_raw")).drop("_raw")
        rows.repartitionByRange(ranges, "stem", "id").sortWithinPartitions("stem", "id").write.mode("overwrite").parquet(f"{folder}/postings.parquet")
        spark = g.nodes.sparkSession
        spark.createDataFrame([(n, float(average))], "n long, average double").write.mode("overwrite").parquet(f"{folder}/postings_stats.parquet")
        return TextIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "TextIndex":
        stats = spark.read.parquet(f"{folder}/postings_stats.parquet").first()
        return TextIndex(spark.read.parquet(f"{folder}/postings.parquet"), stats["n"], stats["average"])

    def terms(self, terms: list[str], stemmed: bool) -> DataFrame:
        column = "stem" if stemmed else "term"
        rows = self.posts.where(F.col(column).isin(terms))
        return rows.groupBy("id", F.col(column).alias("term"), "length").agg(F.sum("tf").alias("tf"), F.sum("tf_w").alias("tf_w"))


def bm25(posts: DataFrame, key: str, terms: list[str], rows: int, average: float) -> DataFrame:
    """(key, score, matched): weighted BM25 of the rows with at least one term.

    ``rows`` and ``average`` (tokens a row) cover the whole collection. Document frequencies come from the same filtered postings in one aggregate.
    """
    hits = posts.where(F.col("term").isin(terms))
    freq = hits.groupBy(F.col("term").alias("_t")).agg(F.count(F.lit(1)).alias("df"))  # at most as many rows as terms
    hits = hits.join(F.broadcast(freq), F.col("term") == F.col("_t"))
    idf = F.greatest(F.log((F.lit(float(rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average))
    score = idf * F.col("tf_w") * (K1 + 1) / (F.col("tf_w") + norm)
    return hits.groupBy(key).agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("matched"))


def and_then_or(scored: DataFrame, n_terms: int, limit: int, key: str) -> DataFrame:
    """Rows with all terms where there are enough of them (at least max(3, limit / 10) after the limit), else rows with any; or_fallback says which.

    Decided inside the plan from one aggregate row.
    """
    total = scored.agg(F.least(F.count_if(F.col("matched") == n_terms), F.lit(limit)).alias("_all"))
    enough = (F.col("_all") >= max(3, limit // 10)) if n_terms > 1 else F.lit(True)
    rows = scored.join(F.broadcast(total.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"))  # one row
    rows = rows.where(~enough | (F.col("matched") == n_terms)).withColumn("or_fallback", ~enough)
    return rows.orderBy(F.desc(F.round("score", 9)), key).limit(limit).select(key, "score", "matched", "or_fallback")


def text_search(g: Graph, query: str, limit: int = 20, include_tests: bool = False, stemmed: bool = True, index: TextIndex | None = None) -> DataFrame:
    """(id, score, matched, or_fallback) of a query over the indexed columns; test rows are dropped before the limit, statistics cover all rows.

    With a kept ``index`` no text is read; without one the texts are read once and only occurrences of the query's terms leave their rows.
    """
    terms = [t for w in I.query_terms(query) for t in w.lower().split("_") if t]
    terms = sorted({I.porter(t) for t in terms} if stemmed else set(terms))
    spark = g.nodes.sparkSession
    if not terms:
        return spark.createDataFrame([], "id long, score double, matched long, or_fallback boolean")
    if index is not None:
        posts, n, average = index.terms(terms, stemmed), index.rows, index.average
    else:
        posts, n, average = postings(g.texts(*COLUMN_WEIGHTS), "id", COLUMN_WEIGHTS, terms_with_stems(terms) if stemmed else exact_terms(terms))
        posts = stemmed_postings(posts, "id", terms) if stemmed else posts
    scored = bm25(posts, "id", terms, n, average)
    if not include_tests:
        tests = g.nodes.where("is_test").select(F.col("id").alias("_i"))
        scored = scored.join(tests, F.col("id") == F.col("_i"), "left_anti")
    return and_then_or(Scratch(spark).save(scored), len(terms), limit, "id")


def distance(column: Column, query: list[float], metric: str = "l2") -> Column:
    """L2 or cosine distance of an array column from a vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.sqrt(add(F.zip_with(column, q, lambda a, b: (a - b) * (a - b))))
    norm = math.sqrt(sum(x * x for x in query))
    return F.lit(1.0) - add(F.zip_with(column, q, lambda a, b: a * b)) / (F.sqrt(add(F.transform(column, lambda a: a * a))) * norm)


def vector_search(vectors: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(node_id, distance): the k nearest vectors, ties by id; vectors of another dimension are ignored."""
    rows = vectors.where(F.size("embedding") == len(query)).select("node_id", distance(F.col("embedding").cast("array<double>"), query, metric).alias("distance"))
    return rows.orderBy("distance", "node_id").limit(k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = 2048, query_block: int = 256) -> DataFrame:
    """(query_id, node_id, distance): the k nearest of ``vectors`` to every vector of ``queries`` (both node_id, embedding), ties by id at nine digits.

    Blocks of vectors meet blocks of queries; each pair of blocks keeps its k best a query, and these are merged. Vectors of another dimension than
    the query, and for cosine vectors of length zero, are left out.
    """

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        rows = rows.where("embedding is not null").select("node_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = max(1, -(-rows.count() // size))
        return rows.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(n)), F.size("embedding")).agg(F.collect_list("node_id").alias(f"{name}_id"), F.collect_list("embedding").alias(name)).select(f"{name}_id", name)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for vi, v, qi, q in zip(b["v_id"], b["v"], b["q_id"], b["q"]):
                if len(v[0]) != len(q[0]):
                    continue
                ids, all_v = np.asarray(vi), np.stack(list(v))
                norms = np.sqrt((all_v * all_v).sum(1))
                for one, x in zip(qi, q):
                    if metric == "l2":
                        dist = np.sqrt(((all_v - x) ** 2).sum(1))
                    else:
                        with np.errstate(invalid="ignore", divide="ignore"):
                            dist = 1.0 - all_v @ x / (norms * np.sqrt(x @ x))
                    near = np.lexsort((ids, np.round(dist, 9)))[:k]
                    out += [(int(one), int(ids[j]), float(dist[j])) for j in near if np.isfinite(dist[j])]
            yield pd.DataFrame(out, columns=["query_id", "node_id", "distance"])

    pairs = blocks(vectors, block, "v").crossJoin(blocks(queries, query_block, "q"))
    rows = pairs.mapInPandas(best, "query_id long, node_id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "node_id"))
    return rows.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def normalised(vectors: DataFrame) -> DataFrame:
    """Vectors of length one; zero vectors stay."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("_n", norm).withColumn("embedding", F.when(F.col("_n") > 0, F.transform("embedding", lambda x: (x / F.col("_n")).cast("float"))).otherwise(F.col("embedding"))).drop("_n")


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of the stored dimension; others are dropped so that they are computed again."""
    return vectors.where(F.size("embedding") == dimension)


class Embedder:
    """What turns texts into vectors; subclasses give ``dimension`` and ``embed``."""

    dimension = S.EMBEDDING_DIM

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


class HashEmbedder(Embedder):
    """Signed feature hashing of tokens, length one; needs no model."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed_nodes(rows: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(node_id, embedding, error) of (id, context_string): Arrow batches, one by one where a batch fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            order = sorted(range(len(b)), key=lambda i: len(b["context_string"].iloc[i]))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                texts = [b["context_string"].iloc[i] for i in part]
                try:
                    vectors: list = list(embedder.embed(texts))
                    errors: list = [None] * len(part)
                except Exception:  # noqa: BLE001
                    vectors, errors = [], []
                    for t in texts:
                        try:
                            vectors.append(embedder.embed([t])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors.append(str(e))
                out += [(b["id"].iloc[i], v, e) for i, v, e in zip(part, vectors, errors)]
            yield pd.DataFrame(out, columns=["node_id", "embedding", "error"])

    return rows.where("context_string is not null").select("id", "context_string").mapInPandas(run, "node_id long, embedding array<float>, error string")


def ranked(scored: DataFrame, source: str, weight: float, key: str = "id", score: str = "score") -> DataFrame:
    """(key, source, weight, rank, raw): a bounded result list numbered from 0 by score."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), key)) - 1
    return scored.select(F.col(key), F.lit(source).alias("source"), F.lit(weight).alias("weight"), rank.alias("rank"), F.col(score).alias("raw"))


def rrf(lists: DataFrame, top_k: int, k: int = RRF_K, key: str = "id") -> DataFrame:
    """Weighted reciprocal rank fusion of rows from ``ranked``; raw scores only break ties below the gap of two ranks."""
    most = F.max("raw").over(Window.partitionBy("source"))
    share = F.when(most > 0, F.greatest(F.col("raw"), F.lit(0.0)) / most).otherwise(0.0)
    gap = 0.5 / ((k + 1) * (k + 2))
    score = F.col("weight") / (F.lit(k) + F.col("rank") + 1) + F.lit(gap) * F.col("weight") * share
    return lists.withColumn("_s", score).groupBy(key).agg(F.sum("_s").alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def query_quality(query: str) -> float:
    """How much a query says: 0.3, 0.4, 0.7, 0.85 or 1.0 for 0, 1, 2, 3 and more meaningful words."""
    n = sum(1 for w in query.split() if w.lower() not in I.STOP_WORDS and len(w.encode()) >= 2)
    return (0.3, 0.4, 0.7, 0.85)[n] if n < 4 else 1.0


def source_weights(query: str) -> tuple[float, float]:
    """(text, vector): 2.0 and 0.8 for queries of at most three short words of capitals and digits, else 1.0 and 1.2."""
    words = query.split()
    acronyms = 0 < len(words) <= 3 and all(len(w) <= 5 and all(c.isupper() or c.isdigit() for c in w) for w in words)
    return (2.0, 0.8) if acronyms else (1.0, 1.2)


def match_confidence(text_hits: int, vector_hits: int, or_fallback: bool, overlap: float, wanted: int) -> float:
    """Product of penalties: vector hits only, OR fallback, few hits, little overlap of both lists."""
    out = 0.35 if not text_hits and vector_hits else 1.0
    if or_fallback:
        out *= 0.6
    share = (text_hits or vector_hits) / max(wanted, 1)
    out *= 0.5 if share < 0.1 else 0.65 if share < 0.25 else 0.8 if share < 0.5 else 1.0
    return out * (0.75 if text_hits and vector_hits and overlap < 0.2 else 1.0)


def rerank(rows: DataFrame, query: str, confidence: float, top_k: int) -> DataFrame:
    """Fused rows with name, path and lines: quality and confidence, a boost for names that hold query terms, damping of long nodes and of headings."""
    terms = [t.lower() for t in I.query_terms(query)]
    hits = sum((F.contains(F.lower("name"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    boost = F.least(F.lit(2.0), F.lit(1.0) + F.lit(0.3) * hits)
    lines = F.col("end_line") - F.col("start_line") + 1
    damp = F.when(lines > 100, F.lit(1.0) / (F.lit(1.0) + F.lit(0.4) * F.log(lines / 100.0))).otherwise(1.0)
    heading = F.when(F.coalesce(F.col("language"), F.lit("")) == "markdown", 0.4).otherwise(1.0)
    base = F.col("score") / F.max("score").over(Window.partitionBy(F.lit(1)))  # a bounded list
    score = F.round(base * query_quality(query) * confidence * boost * damp * heading * 100) / 100
    return rows.withColumn("relevance", score).orderBy(F.desc("relevance"), F.desc("score"), "id").limit(top_k)


def hybrid_search(g: Graph, query: str, query_vector: list[float] | None = None, top_k: int = 10, kind: str | None = None, language: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Text and vector hits fused, filtered, re-ranked and cut; both lists fetch max(4 top_k, 20) before the filters."""
    top_k = max(1, min(100, top_k))
    fetch = max(4 * top_k, 20)
    wt, wv = source_weights(query)
    scratch = Scratch(g.nodes.sparkSession)
    text = scratch.save(text_search(g, query, fetch, index=index))
    lists = ranked(text, "text", wt)
    flags = text.agg(F.count(F.lit(1)).alias("n"), F.max("or_fallback").alias("o")).first()
    found, both = 0, 0
    if query_vector is not None and g.vectors is not None:
        near = scratch.save(vector_search(g.vectors, query_vector, fetch).select(F.col("node_id").alias("id"), (F.lit(1.0) - F.col("distance")).alias("score")))
        lists = lists.unionByName(ranked(near, "vector", wv))
        hits = near.join(text.select(F.col("id").alias("_t")), F.col("id") == F.col("_t"), "left").agg(F.count(F.lit(1)).alias("n"), F.count("_t").alias("both")).first()  # two bounded lists
        found, both = hits["n"], hits["both"]
    fused = rrf(lists, fetch)
    n = g.located("name", "type", "start_line", "end_line", "is_test").withColumnRenamed("id", "_i")
    rows = fused.join(n, F.col("id") == F.col("_i")).where((F.col("name") != S.MODULE) & (F.col("path") != S.EXTERNAL))
    rows = rows.where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test")))
    if kind is not None:
        rows = rows.where(F.col("type").isin(P.normalise_type(kind)))
    if language is not None:
        rows = rows.where(F.col("language") == language)
    overlap = both / min(flags["n"], found) if flags["n"] and found else 0.0
    confidence = match_confidence(flags["n"], found, bool(flags["o"]), overlap, fetch)
    out = rerank(rows, query, confidence, top_k).select("id", "name", "type", "path", "start_line", "end_line", "relevance")
    return out.withColumn("confidence", F.lit(float(confidence)))


def fuzzy_names(g: Graph, name: str, limit: int = 10) -> DataFrame:
    """(id, name, path, rank): names that hold the text (exact, prefix, other; short first), or where there is none names at small edit distance.

    The distance may be 1, 2 or 3 for up to 3, up to 7 or more bytes; test symbols are left out.
    """
    n = g.located("name", "name_tokens", "is_test").where((F.col("name") != S.MODULE) & (F.col("path") != S.EXTERNAL))
    n = n.where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test")))
    low = F.lower("name")
    t = name.lower()
    holds = F.contains(low, F.lit(t)) | F.coalesce(F.contains(F.lower("name_tokens"), F.lit(t)), F.lit(False))
    rank = F.when(low == t, 0).when(low.startswith(t), 1).otherwise(2)
    one = n.where(holds).withColumn("rank", rank).orderBy("rank", F.length("name"), "id").limit(limit).select("id", "name", "path", "rank")
    size = len(name.encode())
    most = 1 if size <= 3 else 2 if size <= 7 else 3
    two = n.withColumn("rank", F.levenshtein(low, F.lit(t), most)).where(F.col("rank") >= 0)
    two = two.orderBy("rank", F.length("name"), "id").limit(limit).select("id", "name", "path", "rank")
    both = one.withColumn("_p", F.lit(0)).unionByName(two.withColumn("_p", F.lit(1)))  # at most 2 * limit rows
    return both.withColumn("_m", F.min("_p").over(Window.partitionBy(F.lit(1)))).where("_p = _m").drop("_p", "_m")


def resolve_name(g: Graph, name: str, path: str | None = None) -> DataFrame:
    """One row: status Unique, Ambiguous or NotFound, and how many candidates; exact names beat fuzzy ones, ``Type.method`` means the qualified name, ``path`` restricts the exact ones to a file."""
    n = g.located("name", "qualified_name", "is_test").where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test")))
    if path is not None:
        n = n.where(F.col("path") == path)
    same = F.col("qualified_name") == name if "." in name else F.col("name") == name
    exact = n.where(same).agg(F.count(F.lit(1)).alias("exact"), F.min("id").alias("id"))
    fuzzy = fuzzy_names(g, name.rsplit(".", 1)[-1]).agg(F.count(F.lit(1)).alias("fuzzy"), F.min("id").alias("fuzzy_id"))
    rows = exact.withColumn("_k", F.lit(1)).join(fuzzy.withColumn("_j", F.lit(1)), F.col("_k") == F.col("_j"))  # one row each
    count = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("fuzzy"))
    status = F.when(count == 0, "NotFound").when(count == 1, "Unique").otherwise("Ambiguous")
    return rows.select(status.alias("status"), count.alias("candidates"), F.when(count == 1, F.coalesce("id", "fuzzy_id")).alias("id"))


def similar_nodes(g: Graph, node_id: int, top_k: int = 10, cutoff: float = 0.8) -> DataFrame:
    """(node_id, name, path, similarity, cutoff_dropped) of the nearest nodes to a node's own vector, itself, tests and modules left out."""
    own = g.vectors.where(F.col("node_id") == node_id).select("embedding").first()
    if own is None:
        return g.nodes.sparkSession.createDataFrame([], "node_id long, name string, path string, similarity double, cutoff_dropped long")
    near = vector_search(g.vectors, list(own["embedding"]), 3 * top_k + 1).where(F.col("node_id") != node_id)
    near = near.withColumn("cutoff_dropped", F.count_if(F.col("distance") > cutoff).over(Window.partitionBy(F.lit(1)))).where(F.col("distance") <= cutoff)
    n = g.located("name", "is_test").withColumnRenamed("id", "_i").where((F.col("name") != S.MODULE) & (F.col("path") != S.EXTERNAL))
    rows = near.join(n, F.col("node_id") == F.col("_i")).where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test")))
    rows = rows.orderBy("distance", "node_id").limit(top_k)
    return rows.select("node_id", "name", "path", F.round(F.lit(1.0) / (F.lit(1.0) + F.col("distance")), 4).alias("similarity"), "cutoff_dropped")


def candidates(g: Graph, name: str, limit: int = 10) -> DataFrame:
    """(id, name, path) of the symbols a name may mean: the exact ones outside tests, or the fuzzy ones where there is none."""
    n = g.located("name", "qualified_name", "is_test").where(~P.is_test(F.col("name"), F.col("path"), F.col("is_test")))
    exact = n.where(F.col("qualified_name" if "." in name else "name") == name).select("id", "name", "path", F.lit(0).alias("_p"))
    both = exact.orderBy("id").limit(limit).unionByName(fuzzy_names(g, name.rsplit(".", 1)[-1], limit).select("id", "name", "path", F.lit(1).alias("_p")))
    return both.withColumn("_m", F.min("_p").over(Window.partitionBy(F.lit(1)))).where("_p = _m").select("id", "name", "path")  # at most 2 * limit rows


def low_confidence(hits: DataFrame, query: str, confidence: float) -> DataFrame:
    """One row (warning): whether a hybrid result needs one: little confidence and none of the first five has a name of the query."""
    words = [w.lower() for w in query.split()]
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("relevance"), "id"))  # a bounded list
    top = hits.withColumn("_r", place).where("_r <= 5").agg(F.count_if(F.lower("name").isin(words)).alias("named"))
    return top.select(((F.col("named") == 0) & F.lit(confidence < 0.5)).alias("warning"))


def strip_outer_generic(text: str) -> str:
    """What stands inside the outermost generic, its last argument: 'Result<Vec<A>, B>' gives 'B'."""
    a, b = text.find("<"), text.rfind(">")
    return text[a + 1 : b].rsplit(",", 1)[-1].strip() if 0 <= a < b else text


def zero_result_hint(query: str) -> str | None:
    """Why a query may have no hit."""
    if any(c in query for c in "(){}[];=<>"):
        return "syntax"
    if not query.isascii():
        return "non-ascii"
    return "generic" if not I.query_terms(query) or query_quality(query) <= 0.4 else None
