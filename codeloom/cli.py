"""``python -m codeloom.cli TOOL --graph FOLDER [arguments]``: every tool of the API, and reports, from the command line.

The commands and their options follow from the signatures of ``CodeLoom``; results are printed as JSON lines.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.api import Answer, CodeLoom, open_graph
from codeloom.graph import Graph
from codeloom.operators import lookups, search, usage
from codeloom.sources import scan

TOOLS = [
    "semantic_code_search", "get_call_graph", "trace_http_chain", "get_ast_node", "get_index_status", "impact_analysis", "module_overview", "dependency_graph", "find_similar_code", "project_map",
    "hot_functions", "entry_points", "ast_search", "find_references", "find_dead_code", "resolve", "rebuild_index", "project_summary",
]


def _option(p: inspect.Parameter) -> dict:
    kind = str(p.annotation)
    if kind.startswith("bool"):
        return {"action": "store_true"}
    type_: Callable = float if "float" in kind and "list" not in kind else int if kind.startswith("int") else str
    return {"type": (lambda s: s.split(",")) if "list" in kind else type_, "default": None if p.default is p.empty else p.default, "required": p.default is p.empty}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeloom")
    sub = out.add_subparsers(dest="tool", required=True)
    for name in TOOLS:
        tool = sub.add_parser(name, help=(inspect.getdoc(getattr(CodeLoom, name)) or "").split("\n")[0])
        tool.add_argument("--graph", required=True)
        for p in list(inspect.signature(getattr(CodeLoom, name)).parameters.values())[1:]:
            tool.add_argument("--" + p.name.replace("_", "-"), **_option(p))
    for name, options in {"grep": ("graph", "pattern"), "text_search": ("graph", "query"), "build_index": ("graph",), "stats": ("log",), "benchmark": ("graph", "query"), "scan": ("root",)}.items():
        tool = sub.add_parser(name)
        for o in options:
            tool.add_argument(f"--{o}", required=True)
    return out


def run(spark: SparkSession, argv: list[str]) -> Answer | DataFrame | dict:
    """The result of one command."""
    a = vars(parser().parse_args(argv))
    tool, folder = a.pop("tool"), a.pop("graph", None)
    if tool in TOOLS:
        return getattr(open_graph(spark, folder), tool)(**a)
    if tool == "scan":
        return scan.scan_directory(spark, a["root"]).drop("source")
    if tool == "stats":
        return usage.tool_usage(usage.sessions(scan.usage_log(spark, a["log"])))
    g = Graph.load(spark, folder)
    if tool == "build_index":
        search.TextIndex.build(g, folder)
        return {"built": folder}
    if tool == "grep":
        texts = g.located("code_content").select("path", F.col("code_content").alias("text"))
        return lookups.grep(texts, a["pattern"])
    if tool == "text_search":
        return search.text_search(g, a["query"], 20)
    import time

    took = []
    for _ in range(5):
        begin = time.perf_counter()
        search.text_search(g, a["query"], 10).collect()
        took.append((time.perf_counter() - begin) * 1000)
    return {"p50_ms": sorted(took)[2], "max_ms": max(took)}


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    out = run(spark, sys.argv[1:] if argv is None else argv)
    rows = out.rows if isinstance(out, Answer) else out
    if isinstance(rows, dict):
        print(json.dumps(rows, default=str))
        return 0
    for line in rows.toJSON().toLocalIterator():
        print(line)
    if isinstance(out, Answer) and out.notes:
        print(json.dumps({k: v for k, v in out.notes.items() if not isinstance(v, DataFrame)}, default=str), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
