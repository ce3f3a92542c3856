import math
import sqlite3

import pytest
from graphs import graph, node
from pyspark.sql import functions as F

from codeloom.functions import identifiers as I
from codeloom.operators import search as Q

CASES = {
    "validateToken": "validate Token validateToken", "PascalCase": "Pascal Case PascalCase", "get_user_by_id": "get user by id get_user_by_id",
    "HTMLParser": "HTML Parser HTMLParser", "hello": "hello", "x": "x", "MAX_SIZE": "MAX SIZE MAX_SIZE",
}


def test_split_identifier(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "name string")
    assert [r[0] for r in df.select(I.split_column(F.col("name"))).collect()] == list(CASES.values())
    assert [I.split_identifier(k) for k in CASES] == list(CASES.values())


def test_query_terms():
    assert I.query_terms("the RRF of a") == ["RRF", "fusion", "rank", "reciprocal"]
    assert I.query_terms("") == [] and I.query_terms("NOT token") == ["NOT", "token"]


def ranks(spark, *lists, k, top):
    out = None
    for name, (weight, ids) in enumerate(lists):
        df = spark.createDataFrame([(i, float(raw)) for i, raw in ids], "id long, score double")
        df = Q.ranked(df, str(name), weight)
        out = df if out is None else out.unionByName(df)
    return [r["id"] for r in Q.rrf(out, top, k).collect()]


def test_fusion(spark):
    assert ranks(spark, (1.0, [(1, 3), (2, 2), (3, 1)]), (1.0, [(2, 3), (4, 2), (1, 1)]), k=60, top=3)[:2] == [2, 1]
    assert ranks(spark, (2.0, [(1, 1)]), (1.0, [(9, 1)]), k=30, top=2) == [1, 9]


@pytest.mark.parametrize("k", [10, 30, 60, 100])
def test_raw_scores_never_flip_ranks(spark, k):
    rows = [(1, 0, 0.0001), (2, 1, 1000.0)]
    df = spark.createDataFrame(rows, "id long, rank int, raw double").select("id", F.lit("a").alias("source"), F.lit(1.0).alias("weight"), "rank", "raw")
    assert Q.rrf(df, 1, k).first()["id"] == 1


def test_weighted_scores_match_the_text_index_of_sqlite(spark):
    texts = ["parse json and tokens", "json parser parses jsons", "nothing here", "parsing of parsed things in JSON", "café tokens"]
    g = graph(spark, [node(i + 1, f"n{i}", code=t, name_tokens=f"word{i} parse" if i % 2 else None) for i, t in enumerate(texts)], [])
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, qualified_name, code_content, context_string, doc_comment, name_tokens, return_type, param_types, tokenize='porter unicode61')")
    for i, t in enumerate(texts):
        con.execute("insert into t(rowid, name, code_content, name_tokens) values (?, ?, ?, ?)", (i + 1, f"n{i}", t, f"word{i} parse" if i % 2 else None))
    want = dict(con.execute("select rowid, -bm25(t, 5, 3, 2, 2, 1, 5, 1, 1) from t where t match 'parse OR json'").fetchall())
    got = {r["id"]: r["score"] for r in Q.text_search(g, "parse json", 20).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-6) for i in got)


def test_stems():
    words = "caresses ponies cats agreed plastered motoring sing conflated hopping falling filing happy relational conditional digitizer triplicate formative adjustment replacement adoption effective bowdlerize probate controll".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter')")
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    for w in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (w,))
        assert con.execute("select term from v").fetchone()[0] == I.porter(w), w


def test_and_needs_enough_rows(spark):
    g = graph(spark, [node(i, f"f{i}", code="parse json" if i < 5 else "parse only") for i in range(1, 6)], [])
    rows = Q.text_search(g, "parse json", 20).collect()
    assert len(rows) == 4 and not rows[0]["or_fallback"]
    assert all(r["or_fallback"] for r in Q.text_search(g, "parse json", 2).collect())
    assert Q.text_search(g, "the", 5).count() == 0


def test_tests_are_left_out(spark):
    g = graph(spark, [node(1, "validateToken", code="token"), node(2, "test_token", code="token", is_test=True)], [])
    assert [r["id"] for r in Q.text_search(g, "token", 5).collect()] == [1]


def test_vectors(spark):
    g = graph(spark, [node(i, f"n{i}") for i in (1, 2, 3)], [], vectors=[(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0]), (4, [1.0])])
    assert [r["node_id"] for r in Q.vector_search(g.vectors, [1.0, 0, 0, 0], 2).collect()] == [1, 3]
    assert [r["node_id"] for r in Q.similar_nodes(g, 1).collect()] == [3]
    assert Q.similar_nodes(g, 99).count() == 0
    assert [len(v) for v in Q.HashEmbedder().embed(["a b", ""])] == [384, 384]


def test_fuzzy_and_resolution(spark):
    g = graph(spark, [node(1, "formatDate"), node(2, "formatDateTime"), node(3, "parse"), node(4, "run"), node(5, "run")], [])
    assert [r["id"] for r in Q.fuzzy_names(g, "formatDate").collect()] == [1, 2]
    assert [r["id"] for r in Q.fuzzy_names(g, "prase").collect()] == [3]
    assert [Q.resolve_name(g, n).first()["status"] for n in ("formatDate", "run", "zzzzzzzzzzzz")] == ["Unique", "Ambiguous", "NotFound"]


def test_scalar_rules():
    assert [Q.query_quality(q) for q in ("the", "a token", "parse json", "x1 y1 z1 w1")] == [0.3, 0.4, 0.7, 1.0]
    assert Q.source_weights("RRF") == (2.0, 0.8) and Q.source_weights("parse json") == (1.0, 1.2)
    assert Q.strip_outer_generic("Result<Vec<A>, B>") == "B" and Q.strip_outer_generic("A") == "A"
    assert Q.zero_result_hint("a(b)") == "syntax"


def test_many_vector_queries_equal_single_ones(spark):
    import random

    from codeloom.operators import search

    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.randrange(-3, 4) + 0.5 for _ in range(4)]) for i in range(60)] + [(99, [1.0])], "node_id long, embedding array<float>")
    queries = v.where("node_id % 7 = 0 and node_id < 60")
    for metric in ("l2", "cosine"):
        got = {(r["query_id"], r["node_id"]): round(r["distance"], 9) for r in search.vector_search_many(v, queries, 5, metric, block=16, query_block=4).collect()}
        assert len(got) == 9 * 5
        for q in queries.where("node_id in (0, 21, 56)").collect():
            want = sorted(round(r["distance"], 9) for r in search.vector_search(v, list(q["embedding"]), 5, metric).collect())
            assert sorted(x for (i, _), x in got.items() if i == q["node_id"]) == want
