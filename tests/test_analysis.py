import pytest
from graphs import graph, node
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.operators import analysis as A
from codeloom.operators import lookups as L


@pytest.fixture(scope="module")
def app(spark):
    nodes = [
        node(1, "main", start=1, end=10), node(2, "used_fn", start=11, end=20), node(3, "orphan_fn", start=21, end=40), node(4, "exported_unused", start=41, end=55),
        node(5, "app", kind="module", start=0, end=100), node(6, "test_something", start=60, end=70, is_test=True), node(7, "handle_login", start=71, end=85),
        node(8, "caller", start=86, end=90, code="run(callback_fn)"), node(9, "callback_fn", start=91, end=105), node(10, "_", kind="constant", start=110, end=115),
        node(11, "<module>", kind="module", start=0, end=0),
    ]
    return graph(spark, nodes, [(8, 2, "calls"), (11, 4, "exports"), (7, 7, "routes_to"), (2, 8, "calls")], ((1, "src/app.ts", "typescript"),))


def names(df):
    return [r["name"] for r in df.collect()]


def test_dead_code(app):
    rows = A.dead_code(app).collect()
    assert [(r["name"], r["lines"], r["has_export"]) for r in rows] == [("orphan_fn", 20, False), ("exported_unused", 15, True)]
    assert "test_something" in names(A.dead_code(app, include_tests=True))
    assert names(A.dead_code(app, prefix="lib/")) == []
    assert names(A.dead_code(app, min_lines=18)) == ["orphan_fn"]
    assert {r["name"]: r["category"] for r in A.classified_dead_code(app).collect()} == {"orphan_fn": "orphan", "exported_unused": "exported_unused"}


def test_filter_orders_by_callers(spark):
    nodes = [node(1, "cold_fn"), node(2, "hot_fn", file_id=2), node(3, "a"), node(4, "b")]
    g = graph(spark, nodes, [(1, 1, "calls"), (1, 2, "calls"), (3, 2, "calls"), (4, 2, "calls")], ((1, "a/early.rs", "rust"), (2, "z/late.rs", "rust")))
    assert names(L.filtered_nodes(g, "fn", limit=1)) == ["hot_fn"]
    assert names(L.filtered_nodes(g, "nonsense")) == []


def test_exports_and_fallback(app, spark):
    assert names(A.module_exports(app, "src/")) == ["exported_unused"]
    g = graph(spark, [node(1, "f"), node(2, "f"), node(3, "c")], [(3, 2, "calls")])
    assert {(r["name"], r["callers"]) for r in A.module_exports(g, "./").collect()} == {("f", 1), ("c", 0)}


def test_entry_points_fall_back_to_main(spark):
    g = graph(spark, [node(1, "main"), node(2, "x")], [])
    assert [(r["kind"], r["label"]) for r in A.entry_points(g).collect()] == [("main", "main")]


def test_test_predicate(spark):
    rows = [("test_x", "a.py"), ("FooTests", "a.py"), ("f", "tests/a.py"), ("f", "a/__tests__/b"), ("f", "a.spec.ts"), ("f", "a_test.go"), ("f", "a/tests/b.py"), (None, None), ("f", "")]
    df = spark.createDataFrame(rows, "name string, path string")
    assert [r[0] for r in df.select(P.is_test_symbol(F.col("name"), F.col("path"))).collect()] == [True] * 6 + [False] * 3


def test_languages_and_directories(spark):
    df = spark.createDataFrame([("a/b.tsx",), (".gitignore",), ("x.PY",), ("m.markdown",), ("top",), (None,)], "p string")
    assert [r[0] for r in df.select(P.file_language(F.col("p"))).collect()] == ["tsx", None, None, "markdown", None, None]
    assert [r[0] for r in df.select(P.directory(F.col("p"))).collect()][:2] == ["a", "."]


def test_innermost_node(spark):
    g = graph(spark, [node(1, "outer", start=1, end=20), node(2, "inner", start=5, end=8), node(3, "same", start=5, end=8)], [])
    lines = spark.createDataFrame([("src/a.ts", 6), ("src/a.ts", 15), ("src/a.ts", 99)], "path string, line long")
    assert [(r["line"], r["name"]) for r in L.containing_nodes(lines, g).orderBy("line").collect()] == [(6, "inner"), (15, "outer"), (99, None)]


def test_grep_numbers_and_cap(spark):
    df = spark.createDataFrame([("a", "x\r\nhit 1\nhit 2\nhit 3"), ("b", None), ("c", "")], "path string, text string")
    assert [(r["path"], r["line"]) for r in L.grep(df, "hit", most=2).collect()] == [("a", 2), ("a", 3)]


def test_clashing_columns_and_repeats(spark):
    g = graph(spark, [node(1, "a"), node(1, "a"), node(2, "b")], [(1, 2, "calls"), (1, 2, "CALLS"), (None, 2, "calls"), (1, None, "calls")])
    g = type(g)(g.files.withColumn("name", F.lit("clash")).withColumn("_t", F.lit(1)), g.nodes, g.edges.withColumn("_s", F.lit(1)))
    assert [tuple(r) for r in L.caller_counts(g).collect()] == [(2, 1)]
    assert L.nodes_by_name(g, "a").count() == 1
