import random
import time

from graphs import graph, node
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.graph import Graph
from codeloom.operators import lookups, mutation, resolve, shaping, usage
from codeloom.operators.components import connected_components
from codeloom.operators.ranking import running_sum
from codeloom.sources import extract, scan
from codeloom.streaming import incremental as K


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "1"), ("d", None)], "path string, content_hash string")
    assert {tuple(r) for r in mutation.snapshot_diff(old, new).collect()} == {("b", "changed"), ("c", "deleted"), ("e", "new")}


def test_delete_cascades(spark):
    g = graph(spark, [node(1, "a"), node(2, "b", file_id=2), node(3, "c")], [(1, 2, "calls"), (1, 3, "calls")], ((1, "a.ts", "typescript"), (2, "b.ts", "typescript")), vectors=[(1, [1.0]), (2, [1.0])])
    k = mutation.delete_files(g, spark.createDataFrame([("b.ts",)], "path string"))
    assert (k.files.count(), k.nodes.count(), k.edges.count(), k.vectors.count()) == (1, 2, 1, 1)


def test_resolution_stays_in_the_language(spark):
    symbols = spark.createDataFrame([(1, "update", "helper.js", "javascript"), (2, "caller_js", "helper.js", "javascript"), (3, "caller_rs", "hasher.rs", "rust")], "id long, name string, path string, language string")
    rel = spark.createDataFrame([(1, 3, "hasher.rs", "rust", "update", "calls"), (2, 2, "helper.js", "javascript", "update", "calls"), (3, 3, "hasher.rs", "rust", "update", "imports")], "rel_id long, source_id long, path string, language string, target_name string, relation string")
    assert {(r["rel_id"], r["target_id"], r["tier"]) for r in resolve.resolve(rel, symbols).collect()} == {(2, 1, 1), (3, 1, 3)}


def test_resolution_prefers_close_production_code(spark):
    symbols = spark.createDataFrame([(1, "readJson", "pkg/scripts/lifecycle.js", "javascript"), (2, "readJson", "tests/helpers.test.js", "javascript"), (3, "new", "x/new.js", "javascript")], "id long, name string, path string, language string")
    rel = spark.createDataFrame([(1, 9, "pkg/scripts/session-init.js", "javascript", "readJson", "calls"), (2, 9, "pkg/scripts/session-init.js", "javascript", "new", "calls")], "rel_id long, source_id long, path string, language string, target_name string, relation string")
    assert [(r["rel_id"], r["target_id"]) for r in resolve.resolve(rel, symbols).collect()] == [(1, 1)]


def test_module_suffixes(spark):
    f = spark.createDataFrame([("myapp/utils.py",), ("myapp/__init__.py",), ("src/myapp/models.py",), ("a.rs",)], "path string")
    got = {r["module"] for r in resolve.module_suffixes(f).collect()}
    assert {"myapp.utils", "utils", "myapp", "myapp.models"} <= got


SOURCES = [
    ("pkg/util.py", "python", "def helper(x):\n    '''Doc.'''\n    return x\n\nclass Base:\n    pass\n\nclass Kid(Base):\n    def go(self):\n        return helper(1)\n"),
    ("pkg/main.py", "python", "from pkg.util import helper\n\n@app.get('/users')\ndef users():\n    return helper(2)\n"),
    ("web/app.ts", "typescript", "import { pretty } from './fmt';\nexport function start(a: string): void {\n  pretty(a);\n}\napp.get('/login', start);\nclass Admin extends User implements Named {\n  log(x: number): string {\n    return pretty(x);\n  }\n}\n"),
    ("web/fmt.ts", "typescript", "export const pretty = (x: any) => String(x);\n"),
    ("srv/lib.rs", "rust", "pub struct Foo;\nimpl Display for Foo {\n    fn show(&self) -> String {\n        render(self)\n    }\n}\nfn render(f: &Foo) -> String {\n    todo()\n}\n"),
    ("srv/m.go", "go", "package m\nfunc Run(a int) error {\n\thelp(a)\n\treturn nil\n}\nfunc help(a int) {\n}\n"),
    ("doc.md", "markdown", "# Top\ntext\n## Sub\n\nLast\n====\n"),
    ("bad.py", "python", "def broken(:\n"),
    ("null.py", "python", None),
]


def test_extraction_and_build(spark):
    rows = [(p, lang, s, f"h{i}", 1) for i, (p, lang, s) in enumerate(SOURCES)]
    src = spark.createDataFrame(rows, "path string, language string, source string, content_hash string, last_modified long")
    symbols, relations = extract.extract(src)
    got = {(r["path"], r["node_type"], r["qualified_name"]) for r in symbols.collect()}
    assert {("pkg/util.py", "method", "Kid.go"), ("web/app.ts", "method", "Admin.log"), ("srv/lib.rs", "function", "Foo.show"), ("srv/m.go", "function", "Run"), ("doc.md", "h2", "Sub"), ("doc.md", "h1", "Last")} <= got
    rel = {(r["source_name"], r["target_name"], r["relation"]) for r in relations.collect()}
    assert {("Kid", "Base", "inherits"), ("Kid.go", "helper", "calls"), ("<module>", "pretty", "imports"), ("Admin", "User", "inherits"), ("Admin", "Named", "implements"), ("start", "start", "routes_to"), ("<module>", "start", "exports"), ("Foo", "Display", "implements"), ("Run", "help", "calls"), ("users", "users", "routes_to")} <= rel
    files, nodes, edges = extract.build(src)
    n = {r["id"]: (r["name"], r["qualified_name"]) for r in nodes.collect()}
    links = {(n[r["source_id"]][1], n[r["target_id"]][0], r["relation"]) for r in edges.collect()}
    assert {("Kid.go", "helper", "calls"), ("users", "helper", "calls"), ("Admin.log", "pretty", "calls"), ("Run", "help", "calls")} <= links
    assert sorted(r["path"] for r in files.collect()) == sorted([S.EXTERNAL, *[p for p, _, _ in SOURCES]])  # the pseudo-file holds the sentinels of unresolved supertypes
    again = extract.build(src)[2]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in edges.collect()}


def test_udtf(spark):
    extract.register(spark)
    rows = spark.sql("select * from extract_symbols('def f(a):\n    return a', 'python')").collect()
    assert [(r["node_type"], r["name"]) for r in rows] == [("function", "f")]


def test_context_string(spark):
    g = graph(spark, [node(1, "f", signature="(a)", return_type="int", code="body", doc_comment="says", qualified_name="M.f"), node(2, "g")], [(1, 2, "calls"), (2, 1, "calls"), (1, 1, "routes_to", '{"method":"GET","path":"/x"}')])
    text = {r["id"]: r["context_string"] for r in resolve.context_strings(g).collect()}
    assert text[1] == "signature: (a)\nreturns: int\nfunction M.f\ntypescript in src/a.ts\nroutes: GET /x\ncalls: g\ncalled_by: g\ndoc: says\ncode: body"


def test_compression_levels(spark):
    assert [spark.range(1).select(shaping.level(F.lit(t))).first()[0] for t in (2000, 2001, 6000, 6001, 16000, 16001)] == ["none", "nodes", "nodes", "files", "files", "directories"]
    a = spark.createDataFrame([(list(range(30)),), ([1],)], "a array<int>").select(shaping.head_and_tail(F.col("a")).alias("a")).collect()
    assert a[0]["a"] == [*range(10), *range(25, 30)] and a[1]["a"] == [1]


def usage_rows(spark, rows):
    out = []
    for i, (tools, quality, queries) in enumerate(rows):
        t = {k: {"n": n, "ms": ms, "err": e, "max_ms": m, "err_kinds": None} for k, (n, ms, e, m) in tools.items()}
        out.append({"ts": None, "dur_s": i, "v": None, "tools": t, "search": {"queries": queries, "zero": 4, "avg_quality": quality, "fts_only": 0, "hybrid": 0}, "index": {"full_ms": None, "incr": 4, "files": 60, "nodes": 1}})
    return spark.createDataFrame([tuple(r.values()) for r in out], S.USAGE)


def test_usage(spark):
    df = usage_rows(spark, [({"get_call_graph": (2, 200, 0, 150), "project_map": (1, 10, 0, 10)}, 0.8, 10), ({"get_call_graph": (3, 900, 1, 500)}, 0.6, 5)])
    got = {r["tool"]: (r["n"], r["ms"], r["err"], r["max_ms"]) for r in usage.tool_usage(df).collect()}
    assert got["get_call_graph"] == (5, 1100, 1, 500) and got["project_map"][0] == 1
    q = usage.search_quality(df).first()
    assert round(q["avg_quality"], 4) == 0.7333 and (q["zero"], q["incr"], q["files"]) == (8, 8, 60)


def test_evaluation_and_majority(spark):
    v = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "b"), ("r", 1, "x"), ("r", 2, "y")], "query string, run long, picked string")
    assert {r["query"]: r["picked"] for r in usage.majority(v).collect()} == {"q": "b", "r": "x"}
    e = spark.createDataFrame([("a", "a"), ("b", "c"), ("Grep", "Read"), ("Read", None)], "expected string, picked string")
    assert [round(x, 2) for x in usage.evaluation(e).first()] == [0.5, 0.5, 0.5]


def test_scan(spark, tmp_path):
    for p, t in {"src/a.py": "x = 1", ".hidden/b.py": "", "vendor/c.py": "", "src/d.bin": "", "skip/e.py": "", "big.py": "x" * 50}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = scan.scan_directory(spark, str(tmp_path), ["skip/"], max_bytes=20)
    assert {(r["path"], r["language"], r["skip_reason"]) for r in rows.collect()} == {("src/a.py", "python", None), ("big.py", "python", "size")}
    assert scan.changed_since(rows, rows.select("path", "last_modified")).count() == 0
    log = tmp_path / "log.jsonl"
    log.write_text('{"dur_s": 3, "v": "1"}\nbroken\n')
    assert sorted((r["dur_s"] or 0, r["_corrupt"]) for r in scan.usage_log(spark, str(log)).collect()) == [(0, "broken"), (3, None)]


def test_incremental_is_idempotent(spark):
    g = graph(spark, [node(1, "a"), node(2, "b", file_id=2)], [(1, 2, "calls")], ((1, "a.ts", "typescript"), (2, "b.ts", "typescript")))
    files = g.files.withColumn("content_hash", F.when(F.col("path") == "b.ts", "new").otherwise(F.col("content_hash")))
    made = spark.createDataFrame([tuple(node(2, "b2", file_id=2)[c.split()[0]] for c in S.NODES.split(", "))], S.NODES)

    def rebuild(paths):
        some = made.where(F.lit(paths.count() > 0))
        return some, g.edges.limit(0)

    new, dirty = K.incremental(g, files, rebuild)
    assert [r["id"] for r in dirty.collect()] == [1]
    assert {r["name"] for r in new.nodes.collect()} == {"a", "b2"}
    twice, dirty = K.incremental(Graph(new.files, new.nodes, new.edges), files, rebuild)
    assert dirty.count() == 0 and {r["name"] for r in twice.nodes.collect()} == {"a", "b2"}


def test_stream_cooldown(spark, tmp_path):
    rows = [("k", float(t)) for t in (0, 10, 35, 40, 70)]
    spark.createDataFrame(rows, "key string, t double").select("key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = K.cooldown(spark.read.parquet(str(tmp_path / "in")), ["key"], "ts", 30)
    assert sorted(r["at"] for r in batch.collect()) == [0.0, 35.0, 70.0]
    stream = K.cooldown(spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in")), ["key"], "ts", 30)
    q = stream.writeStream.format("memory").queryName("cooled").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).start()
    # timeouts keep such a query running, so it is stopped once its output is there
    for _ in range(90):
        if spark.table("cooled").count() >= 3 or not q.isActive:
            break
        time.sleep(0.5)
    q.stop()
    assert sorted(r["at"] for r in spark.table("cooled").collect()) == [0.0, 35.0, 70.0]


def test_migrations(spark):
    old = spark.createDataFrame([(1,)], "id long")
    assert {"context_string", "name_tokens", "is_test"} <= set(S.migrate(old, "nodes", 1).columns)
    assert S.migrate(old, "nodes", 7).columns == ["id"]


def test_running_sum_over_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = running_sum(df, ["k"], F.col("v"), [F.col("id")], "s", rows_per_bucket=30).collect()
    assert len(got) == 400
    for key in ("a", None):
        part = sorted((r["s"], r["v"] == 0, r["v"]) for r in got if r["k"] == key)
        ends = sorted((r["s"], r["s"] + r["v"]) for r in got if r["k"] == key)
        assert ends[0][0] == 0 and max(e for _, e in ends) == sum(v for _, _, v in part)
        assert all(a[1] <= b[0] or b[0] == a[0] for a, b in zip(ends, ends[1:]))
    assert running_sum(df.limit(0), ["k"], F.col("v"), [F.col("id")], "s").count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_missing_and_unembedded(spark):
    g = graph(spark, [node(1, "a"), node(2, "b", context_string="c"), node(3, "c", context_string="d")], [(1, 3, "calls")], vectors=[(2, [1.0])])
    assert [r["id"] for r in lookups.missing_context(g).collect()] == [1]
    assert [r["id"] for r in lookups.unembedded(g).collect()] == [3]
    assert tuple(lookups.embedding_coverage(g).first()) == (1, 2)


def test_bitmap_filter_keeps_every_member(spark):
    from codeloom.operators.bitmaps import maybe_in

    rows = spark.range(3000).withColumn("_map", F.lit("clash")).drop("_map")
    members = spark.createDataFrame([(7 * i,) for i in range(60)] + [(None,), (-5,)], "m long")
    got = {r["id"] for r in maybe_in(rows, F.col("id"), members, F.col("m"), bits=16).collect()}
    assert {7 * i for i in range(60)} <= got and len(got) < 90
    assert maybe_in(rows, F.col("id"), members.limit(0), F.col("m")).count() == 0


def test_python_with_errors_keeps_its_sound_parts(spark):
    broken = """import json
class Empty:

@app.get("/x")
def sound(a: int) -> str:
    return helper(a)
class Box(Base):
    def open(self):
        = 1
        self.turn()
from import import
DATA = [
1,
]
enum Kind:
    a: 1
def last(x):
    return sound(x) + "cut...
"""
    symbols, relations = extract.parse_python(broken)
    assert {(s[0], s[2]) for s in symbols} == {("class", "Empty"), ("function", "sound"), ("class", "Box"), ("method", "Box.open"), ("constant", "DATA"), ("function", "last")}
    assert {s[2]: (s[3], s[4]) for s in symbols}["sound"] == (4, 6)
    found = {r[:3] for r in relations}
    assert found >= {("<module>", "json", "imports"), ("sound", "helper", "calls"), ("sound", "sound", "routes_to"), ("Box", "Base", "inherits"), ("Box.open", "turn", "calls"), ("last", "sound", "calls")}
    rows = spark.createDataFrame([("a.py", "python", broken), ("b.py", "python", "def f():\n    pass"), ("c.txt", None, "x")], "path string, language string, source string")
    assert [(r["path"], r["skip_reason"]) for r in extract.skipped(rows).collect()] == [("a.py", "parse")]
    assert [tuple(r) for r in scan.skip_counts(extract.skipped(rows)).collect()] == [("parse", 1)]


def test_missing_context_is_whole(spark):
    columns = ", ".join(f"cast(null as {c.split()[1]}) {c.split()[0]}" if c.split()[0] not in ("id", "file_id", "name") else "id" if c == "id long" else "1L file_id" if c.startswith("file_id") else "'n' name" for c in S.NODES.split(", "))
    files = spark.createDataFrame([(1, "a.py", "h", 1, "python", 1)], S.FILES)
    g = Graph.clean(files, spark.range(10_050).selectExpr(*columns.split(", ")), spark.createDataFrame([], S.EDGES))
    assert lookups.missing_context(g).count() == 10_050
    assert [r["id"] for r in lookups.missing_context(g, batch=2).collect()] == [0, 1]


def test_imports_keep_to_their_module_or_lead_outside(spark):
    rows = [
        ("pkg/util.py", "h", 1, "python", "def load():\n    pass"), ("other/util2.py", "h", 1, "python", "def load():\n    pass"),
        ("app.py", "h", 1, "python", "from pkg.util import load\nimport pkg.util\nfrom requests import get\nimport os.path"),
        ("a.rs", "h", 1, "rust", "struct Out;\nimpl Write for Out {\n}"), ("b.js", "h", 1, "javascript", "const fs = require('fs')"),
    ]
    files, nodes, edges = extract.build(spark.createDataFrame(rows, "path string, content_hash string, last_modified long, language string, source string"))
    n = {r["id"]: (r["path"], r["type"], r["name"]) for r in nodes.join(files.select(F.col("id").alias("f"), "path"), F.col("file_id") == F.col("f")).collect()}
    got = {(n[e["source_id"]][0], e["relation"], *n[e["target_id"]]) for e in edges.where("relation in ('imports', 'implements')").collect()}
    assert got == {
        ("app.py", "imports", "pkg/util.py", "function", "load"), ("app.py", "imports", "pkg/util.py", "module", "<module>"),
        ("app.py", "imports", "<external>", "external_module", "requests"), ("app.py", "imports", "<external>", "external_module", "os.path"),
        ("a.rs", "implements", "<external>", "trait", "Write"), ("b.js", "imports", "<external>", "module", "fs"),
    }


def test_long_texts_are_classified(spark, tmp_path):
    from codeloom.plans import usage_queries

    rows = [(1, "how to " + "parse " * 60), (2, "update_node"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r["bucket"], r["n"], r["share"]) for r in usage_queries.query_classify(spark, str(tmp_path)).collect()} == {("concept-nl", 1, 50.0), ("kw-single", 1, 50.0)}


def test_snapshot_query_takes_every_path(spark, tmp_path):
    from codeloom.plans import graph_queries

    paths = ["a" * 7, "b" * 11, "c" * 77, "d"]  # lengths divisible by 7, by 11, by both and by neither
    rows = [(i, p, f"h{t}" if p != "b" * 11 else "same", t, "python", t) for i, p in enumerate(paths) for t in (1, 2)]
    spark.createDataFrame(rows, S.FILES).write.parquet(str(tmp_path / "files.parquet"))
    for name, kind in (("nodes", S.NODES), ("edges", S.EDGES)):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {tuple(r) for r in graph_queries.snapshot_diff(spark, str(tmp_path)).collect()} == {("a" * 7, "changed"), ("c" * 77, "changed"), ("d", "changed")}
    old = spark.createDataFrame([("a" * 7, "1"), ("b" * 11, "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a" * 7, "1"), ("c" * 77, "1")], "path string, content_hash string")
    assert {tuple(r) for r in mutation.snapshot_diff(old, new).collect()} == {("b" * 11, "deleted"), ("c" * 77, "new")}


def test_nearest_targets_against_all_pairs(spark):
    from codeloom.functions.predicates import language_family  # noqa: F401

    rng = random.Random(8)
    part = lambda: rng.choice(["a", "ab", "abc", "b", "src", "tests", "é", "è"])
    path = lambda: "/".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice([".js", ".test.js", ".py", ""])
    langs = ["javascript", "typescript", "python", None]
    symbols = [(i, rng.choice("xyz"), path(), rng.choice(langs)) for i in range(150)]
    rel = [(i, 1000 + i, path(), rng.choice(langs), rng.choice("xyzw"), rng.choice(["calls", "imports"])) for i in range(120)]
    family = lambda x: "js" if x in ("javascript", "typescript") else x
    test = lambda p: p.startswith("tests/") or any(x in p for x in (".test.", "/tests/"))

    def common(a, b):
        a, b = a.encode(), b.encode()
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = set()
    for r, _, p, lang, name, kind in rel:
        same = [s for s in symbols if s[1] == name]
        if local := [s for s in same if s[2] == p]:
            want |= {(r, s[0], 1) for s in local}
            continue
        near = [s for s in same if lang is None or s[3] is None or family(s[3]) == family(lang)]
        if not test(p) and any(not test(s[2]) for s in near):
            near = [s for s in near if not test(s[2])]
        most = max((common(p, s[2]) for s in near), default=0)
        want |= {(r, s[0], 2) for s in near if common(p, s[2]) == most}
        if not near and kind != "calls":
            want |= {(r, s[0], 3) for s in same}
    got = resolve.resolve(
        spark.createDataFrame(rel, "rel_id long, source_id long, path string, language string, target_name string, relation string"),
        spark.createDataFrame(symbols, "id long, name string, path string, language string"),
    )
    assert {(r["rel_id"], r["target_id"], r["tier"]) for r in got.collect()} == want


def test_a_name_with_many_definitions(spark):
    """100,000 definitions and 20,000 callers of one name: each caller meets its own repository's definition alone."""
    symbols = spark.range(100_000).select("id", F.lit("update").alias("name"), F.format_string("repo%06d/src/m.js", "id").alias("path"), F.lit("javascript").alias("language"))
    rel = spark.range(20_000).select(F.col("id").alias("rel_id"), (F.col("id") + 10**6).alias("source_id"), F.format_string("repo%06d/src/z.js", F.col("id") * 5).alias("path"), F.lit("javascript").alias("language"), F.lit("update").alias("target_name"), F.lit("calls").alias("relation"))
    begin = time.perf_counter()
    got = resolve.resolve(rel, symbols)
    assert got.count() == 20_000 and got.where("target_id <> rel_id * 5").count() == 0
    assert time.perf_counter() - begin < 120


def test_statements_over_several_lines():
    targets = lambda text, lang: [r[1] for r in extract.parse(text, lang)[1] if r[2] == "imports"]
    assert targets("import {\n  a,\n  type B,\n  c as d,\n} from './x';\nimport e, { f } from 'y';\nimport * as g from 'z';\nexport {\n  h\n} from 'q'\n", "typescript") == ["a", "B", "c", "e", "f", "g", "h"]
    assert targets("use a::{b, c::{d as e, self}, f::*};\npub use x::y;\nuse m::{\n    n,\n    o::p,\n};\n", "rust") == ["b", "d", "c", "y", "n", "p"]
    assert targets("import {\n  never\nconst x = 1;\nimport { ok } from 'k';\n", "javascript") == ["ok"]
    names = lambda text, lang: [r[1] for r in extract.parse(text, lang)[0]]
    assert names("export function long(\n  a: string,\n  b: number,\n): void {\n  go(a);\n}\nconst p = (x) => x, q = (y) => y;\n", "typescript") == ["long", "p", "q"]
    assert names("public void put(\n    int a,\n    int b) {\n}\n", "java") == ["put"]
    assert names("pub fn load(\n    path: &Path,\n) -> Result<()> {\n}\nfn next() {}\n", "rust") == ["load", "next"]
    assert names("function broken(\nfunction fine(a) {\n}\n", "javascript")[-1] == "fine"
