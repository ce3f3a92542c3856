"""Small graphs as rows."""

from __future__ import annotations

from codeloom import schema as S
from codeloom.graph import Graph

FILE_COLUMNS = ["id", "path", "content_hash", "last_modified", "language", "indexed_at"]


def node(id, name, kind="function", file_id=1, start=1, end=2, code="", **more):
    row = dict(
        id=id, file_id=file_id, type=kind, name=name, qualified_name=None, start_line=start, end_line=end, code_content=code, signature=None, doc_comment=None,
        context_string=None, name_tokens=None, return_type=None, param_types=None, is_test=False,
    )
    return row | more


def graph(spark, nodes, edges, files=((1, "src/a.ts", "typescript"),), vectors=None):
    """edges: (source, target, relation[, metadata]); files: (id, path, language)."""
    names = [c.strip().split()[0] for c in S.NODES.split(", ")]
    f = spark.createDataFrame([(i, p, f"h{i}", 1, lang, 1) for i, p, lang in files], S.FILES)
    n = spark.createDataFrame([tuple(x[c] for c in names) for x in nodes], S.NODES)
    e = spark.createDataFrame([(i + 1, *x[:3], x[3] if len(x) > 3 else None) for i, x in enumerate(edges)], S.EDGES)
    v = None if vectors is None else spark.createDataFrame(vectors, S.VECTORS)
    return Graph.clean(f, n, e, v)
