import random

import pytest
from graphs import graph, node

from codeloom.operators import analysis as A
from codeloom.operators import traverse as T


def depths(df):
    return {r["name"]: r["depth"] for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    nodes = [node(i + 1, n) for i, n in enumerate("ABCD")]
    return graph(spark, nodes, [(1, 2, "calls"), (2, 3, "calls"), (4, 2, " Calls ")])


def test_callees_callers_and_both(small):
    assert depths(T.call_graph(small, "A", "callees", 2)) == {"A": 0, "B": 1, "C": 2}
    assert depths(T.call_graph(small, "B", "callers", 2)) == {"B": 0, "A": 1, "D": 1}
    both = T.call_graph(small, "B", "both", 2).collect()
    assert {r["name"] for r in both} == set("ABCD")
    assert sorted(r["direction"] for r in both if r["name"] == "B") == ["callees", "callers"]


def test_parents(small):
    rows = {r["name"]: r["parent_id"] for r in T.call_graph(small, "C", "callers", 2).collect()}
    assert rows == {"C": None, "B": 3, "A": 2, "D": 2}


def test_cycle_ends(spark):
    g = graph(spark, [node(1, "A"), node(2, "B")], [(1, 2, "calls"), (2, 1, "calls")])
    assert depths(T.call_graph(g, "A", "callees", 10)) == {"A": 0, "B": 1}


def test_unknown_name_and_empty_graph(spark, small):
    assert T.call_graph(small, "nobody").count() == 0
    assert T.call_graph(graph(spark, [], [], files=()), "A").count() == 0


def test_bfs_against_brute_force(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    steps = spark.createDataFrame(sorted(pairs) * 2, "source long, target long")
    seeds = spark.createDataFrame([(0, 0), (0, 1), (7, 7), (7, 7)], "seed long, node long")
    got = {(r["seed"], r["node"]): r["depth"] for r in T.bfs(steps, seeds, 5).collect()}
    want = {}
    for seed, start in ((0, [0, 1]), (7, [7])):
        level, d = set(start), 0
        while level and d <= 5:
            want |= {(seed, x): d for x in level}
            level = {t for s, t in pairs if s in level} - {n for (s, n) in want if s == seed}
            d += 1
    assert got == want


def test_import_tree(spark):
    nodes = [node(1, "funcA1"), node(2, "funcA2"), node(3, "funcB1", file_id=2), node(4, "funcB2", file_id=2)]
    g = graph(spark, nodes, [(1, 3, "imports"), (2, 4, "calls")], files=((1, "src/a.ts", "typescript"), (2, "src/b.ts", "typescript")))
    assert [tuple(r) for r in T.import_tree(g, "src/a.ts").select("path", "depth", "n").collect()] == [("src/b.ts", 1, 2)]
    assert [tuple(r) for r in T.import_tree(g, "src/b.ts", "incoming").select("path", "depth", "n").collect()] == [("src/a.ts", 1, 2)]


def test_dependency_graph_keeps_language_families(spark):
    nodes = [node(i, f"n{i}", file_id=i) for i in (1, 2, 3)]
    files = ((1, "a.ts", "typescript"), (2, "b.js", "javascript"), (3, "c.rs", "rust"))
    g = graph(spark, nodes, [(1, 2, "calls"), (1, 3, "calls")], files)
    assert [r["path"] for r in T.dependency_graph(g, "a.ts").collect()] == ["b.js"]


def test_impact(spark):
    nodes = [node(1, "formatDate"), node(2, "createReport"), node(3, "createLog"), node(4, "handleRequest", file_id=2), node(5, "Shape", kind="struct")]
    g = graph(spark, nodes, [(2, 1, "calls"), (3, 1, "calls"), (4, 2, "calls")], ((1, "src/u.ts", "typescript"), (2, "src/h.ts", "typescript")))
    r = A.impact(g, "formatDate").first()
    assert (r["prod_callers"], r["direct"], r["transitive"], r["files"], r["risk"]) == (3, 2, 1, 2, "LOW")
    assert A.impact(g, "formatDate", removal=True).first()["risk"] == "HIGH"
    assert A.impact(g, "Shape").first()["risk"] == "UNKNOWN"


def test_routes(spark):
    nodes = [node(1, "handler"), node(2, "caller")]
    meta = '{"method":"GET","path":"/api/test"}'
    g = graph(spark, nodes, [(2, 1, "calls"), (2, 2, "routes_to", meta), (1, 1, "routes_to", "{broken")])
    rows = {r["name"]: r["route"] for r in A.callers_with_routes(g, "handler").collect()}
    assert rows["caller"] == meta
    assert [(r["name"], r["depth"]) for r in T.trace_routes(g, "GET /api").orderBy("depth").collect()] == [("caller", 0), ("handler", 1)]
    assert T.trace_routes(g, "POST /api").count() == 0


def test_row_limit_cuts_listings_only(spark):
    nodes = [node(i, "seed") for i in range(1, 206)] + [node(300 + i, f"caller{i}", file_id=2) for i in range(250)] + [node(900, "test_seed")]
    edges = [(300 + i, 1 + i % 205, "calls") for i in range(250)] + [(900, 1, "calls")]
    g = graph(spark, nodes, edges, ((1, "src/a.ts", "typescript"), (2, "src/b.ts", "typescript")))
    r = A.impact(g, "seed").first()
    assert (r["prod_callers"], r["test_callers"], r["files"], r["risk"]) == (250, 1, 1, "HIGH")
    assert T.call_graph(g, "seed", "callers").count() == 200
    assert T.call_graph_tool(g, "seed", "callers").count() == 200
    assert [(x["path"], x["n"], x["min_depth"]) for x in T.rollup(T.callers_and_callees(g, "seed", "callers")).collect()] == [("src/b.ts", 250, 1)]
