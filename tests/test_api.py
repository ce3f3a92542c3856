import json

import pytest
from graphs import graph, node
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.api import CodeLoom
from codeloom.graph import Graph
from codeloom.operators import lookups, mutation, search, shaping
from codeloom.streaming import incremental

FILES = ((1, "src/a.ts", "typescript"), (2, "src/b.ts", "typescript"), (3, "tests/c.test.ts", "typescript"))


@pytest.fixture(scope="module")
def loom(spark):
    nodes = [
        node(1, "parseNode", code="function parseNode() {\n  load();\n}"), node(2, "loadIndex", file_id=2, code="function loadIndex() {}"), node(3, "update", file_id=2), node(4, "update"),
        node(5, "checks", file_id=3), node(6, "Store", kind="class"), node(7, "<module>", kind="module"),
    ]
    g = graph(spark, nodes, [(1, 2, "calls"), (5, 2, "calls"), (3, 6, "imports"), (7, 2, "imports")], FILES)
    texts = spark.createDataFrame([("src/a.ts", "\n".join(f"line {i}" for i in range(1, 31))), ("src/b.ts", None)], "path string, text string")
    return CodeLoom(g, texts=texts)


def test_call_graph_answers(loom):
    many = loom.get_call_graph("update")
    assert many.notes["status"] == "Ambiguous" and {r["id"] for r in many.collect()} == {3, 4}
    one = loom.get_call_graph("loadIndex", "callers")
    assert {r["name"] for r in one.collect()} == {"parseNode"} and one.notes["hidden_tests"] == 1
    assert loom.get_call_graph("loadIndx", "callers").notes["fuzzy"] == "loadIndex"
    with pytest.raises(ValueError):
        loom.get_call_graph("x", "sideways")


def test_references(loom):
    assert {r["source_id"] for r in loom.find_references("loadIndex").collect()} == {1, 7}
    assert {r["source_id"] for r in loom.find_references(node_id=2, include_tests=True, relation="calls").collect()} == {1, 5}
    assert loom.find_references("update", path="src/b.ts").count() == 0
    assert "type" in loom.find_references("Store").notes["note"]
    assert loom.find_references("loadIndex", compact=True).columns == ["name", "path", "relation"]


def test_nodes_with_context(spark, loom):
    row = loom.get_ast_node("parseNode", context_lines=1, references=True, impact=True)
    first = row.first()
    assert first["code"].startswith("line 1") and "references" in row.notes and row.notes["impact"].count() == 1
    assert loom.get_ast_node(node_id=2).first()["name"] == "loadIndex"
    spans = spark.createDataFrame([("src/a.ts", 5, 6), ("../etc/passwd", 1, 1), ("/etc/passwd", 1, 1), ("src/b.ts", 1, 2)], "path string, start_line long, end_line long")
    texts = spark.createDataFrame([("src/a.ts", "a\r\nb\nc\nd\ne\nf\ng\nh"), ("../etc/passwd", "x"), ("/etc/passwd", "x"), ("src/b.ts", None)], "path string, text string")
    got = {r["path"]: r["code"] for r in lookups.source_context(spans, texts, 1).collect()}
    assert got == {"src/a.ts": "d\ne\nf\ng", "../etc/passwd": None, "/etc/passwd": None, "src/b.ts": None}
    assert {r["name"] for r in lookups.names_outside(loom.graph, spark.createDataFrame([("src/a.ts",), ("tests/c.test.ts",)], "path string")).collect()} == {"loadIndex", "update"}


def test_searches_say_what_they_lack(loom):
    hit = loom.semantic_code_search("loadIndex")
    assert hit.first()["name"] == "loadIndex" and 0 < hit.notes["confidence"] <= 1
    assert loom.semantic_code_search("qqqzzz(").notes["hint"] == "syntax"
    assert loom.ast_search(query="loadIndex", returns="Nothing").count() == 0
    assert loom.ast_search(returns="Result<Vec<A>, B>").notes["hint"] == "B"


def test_dependencies_and_status(loom):
    deps = loom.dependency_graph("src/a.ts")
    assert {r["path"]: r["symbols"] for r in deps.collect()} == {"src/b.ts": ["loadIndex"]}
    assert loom.dependency_graph("src").notes["hint"] == "directory"
    status = loom.project_summary()
    assert status["nodes"] == 7 and status["watching"] is False and loom.stop_watch() is False
    assert loom.find_dead_code(min_lines=1, ignore=["src/a"]).notes["suppressed"] >= 1
    assert loom.project_map() is loom.project_map()


def test_shaping(spark):
    rows = spark.createDataFrame([(1, "short", "x" * 900, "é" * 600, list(range(30)), [(1, [1] * 30)])], "id long, a string, b string, c string, d array<int>, e array<struct<k:int, v:array<int>>>")
    out = shaping.shorten(rows, 1000).first()
    assert out["a"] == "short" and 200 < len(out["b"]) < 900 and out["d"] == [*range(10), *range(25, 30)] and set(out["truncated_fields"]) == {"b", "c", "d"}
    assert shaping.shorten(rows, 1000, depth=3).first()["e"][0]["v"] is None
    cut = rows.select(shaping.snippet(F.col("c")).alias("c"), shaping.snippet(F.lit("ab\n" * 300)).alias("d"), shaping.snippet(F.lit("ok")).alias("e")).first()
    assert cut["c"] == "é" * 250 and cut["d"].endswith("ab") and len(cut["d"]) < 500 and cut["e"] == "ok"


def test_text_index_gives_the_same_hits(spark, tmp_path):
    g = graph(spark, [node(i, n, code=f"{n} parsing nodes {i}") for i, n in enumerate(["parseNode", "loadIndex", "nodeParser", "other"], 1)], [], FILES)
    index = search.TextIndex.build(g, str(tmp_path))
    for stemmed in (True, False):
        a, b = [[(r["id"], round(r["score"], 9), r["matched"]) for r in search.text_search(g, "parsing nodes", stemmed=stemmed, index=x).collect()] for x in (None, index)]
        assert a == b and a


def test_small_helpers(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0])], "node_id long, embedding array<float>")
    assert [r["node_id"] for r in search.check_dimension(v, 2).collect()] == [1, 2]
    assert search.normalised(v.where("node_id = 1")).first()["embedding"] == pytest.approx([0.6, 0.8])
    g = graph(spark, [{**node(1, "a"), "context_string": "a b"}, {**node(2, "b"), "context_string": "b"}, node(3, "c")], [], FILES)
    full = incremental.embed_missing(g, search.HashEmbedder())
    assert {r["node_id"] for r in full.vectors.collect()} == {1, 2}
    assert {r["node_id"] for r in incremental.embed_missing(full, search.HashEmbedder()).vectors.collect()} == {1, 2}
    made = mutation.update_contexts(g.nodes, spark.createDataFrame([(3, "new")], "id long, context_string string"))
    assert {r["id"]: r["context_string"] for r in made.collect()} == {1: "a b", 2: "b", 3: "new"}
    rows = spark.sql("select timestamp'2024-01-02 00:00:00' ts, 1 n union all select timestamp'2023-01-01 00:00:00', 2")
    mutation.flush_metrics(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    import datetime

    assert mutation.retain(rows, datetime.datetime(2024, 1, 1)).count() == 1


def test_rebuild_and_command_line(spark, tmp_path):
    root = tmp_path / "code"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "util.py").write_text("def helper(x):\n    return x\n\ndef other():\n    return helper(1)\n")
    (root / "bad.py").write_text("def broken(:\n")
    loom = CodeLoom(graph(spark, [node(1, "a")], [], FILES))
    with pytest.raises(ValueError):
        loom.rebuild_index(str(root), str(tmp_path / "g"))
    done = loom.rebuild_index(str(root), str(tmp_path / "g"), confirm=True)
    assert done.first()["files"] == 2 and done.notes["skipped"] == {"parse": 1}
    assert {r["name"] for r in loom.get_call_graph("helper", "callers").collect()} == {"other"}
    assert "helper" in loom.graph.nodes.where("name = 'other'").first()["context_string"]
    out = cli.run(spark, ["get_call_graph", "--graph", str(tmp_path / "g"), "--name", "helper", "--direction", "callers"])
    assert [r["name"] for r in out.collect()] == ["other"]
    assert cli.run(spark, ["build_index", "--graph", str(tmp_path / "g")]) == {"built": str(tmp_path / "g")}
    assert cli.run(spark, ["text_search", "--graph", str(tmp_path / "g"), "--query", "helper"]).count() >= 1
    assert json.loads(json.dumps(cli.run(spark, ["project_summary", "--graph", str(tmp_path / "g")]), default=str))["files"] == 2


def test_file_events(spark):
    files = spark.createDataFrame([(1, "a", "h1", 1, "go", 1), (2, "b", "h1", 1, "go", 1)], "file_id long, path string, content_hash string, last_modified long, language string, indexed_at long")
    events = spark.createDataFrame([(2, "b", "h2", 2, "go", 2, "data"), (2, "b", "h3", 3, "go", 3, "remove"), (3, "c", "h", 1, "go", 2, "create"), (1, "a", "x", 9, "go", 9, "access")], "file_id long, path string, content_hash string, last_modified long, language string, indexed_at long, kind string")
    assert {(r["path"], r["content_hash"]) for r in incremental.latest(files, events).collect()} == {("a", "h1"), ("c", "h")}
    assert isinstance(Graph(files, files, files), Graph)


def test_ignore_files(spark, tmp_path):
    from codeloom.sources import scan

    for path in ("a.py", "build/x.py", "src/build/y.py", "src/gen_a.py", "src/keep/gen_b.py", "docs/z.py", "src/docs/z.py", "logs.py/q.py", "src/__init__.py", "src/_in/b.py", "build/_x.py", ".hid/a.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# comment\nbuild/\n/docs\n\nsrc/**/gen_*\n")
    (tmp_path / "src" / "keep").mkdir(parents=True, exist_ok=True)
    (tmp_path / "src" / "keep" / ".gitignore").write_text("!gen_b.py\n")
    got = {r["path"] for r in scan.scan_directory(spark, str(tmp_path)).select("path").collect()}
    assert got == {"a.py", "src/keep/gen_b.py", "src/docs/z.py", "logs.py/q.py", "src/__init__.py", "src/_in/b.py"}
    assert len(scan.scan_directory(spark, str(tmp_path), gitignore=False).select("path").collect()) == 11
    assert scan.ignore_rules(None) == [] == scan.ignore_rules("")
