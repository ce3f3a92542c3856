"""Relations of the code graph: schemas, labels and the constants that fix semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 7

FILES = "id long, path string, content_hash string, last_modified long, language string, indexed_at long"
NODES = (
    "id long, file_id long, type string, name string, qualified_name string, start_line long, end_line long, code_content string, signature string, "
    "doc_comment string, context_string string, name_tokens string, return_type string, param_types string, is_test boolean"
)
EDGES = "id long, source_id long, target_id long, relation string, metadata string"
VECTORS = "node_id long, embedding array<float>"
ROUTE_METADATA = "method string, path string, inline boolean, handler_start_line long, handler_end_line long"
IMPORT_METADATA = "python_module string, is_module_import boolean"
USAGE = (
    "ts timestamp, dur_s long, v string, tools map<string, struct<n: long, ms: long, err: long, max_ms: long, err_kinds: map<string, long>>>, "
    "search struct<queries: long, zero: long, avg_quality: double, fts_only: long, hybrid: long>, index struct<full_ms: long, incr: long, files: long, nodes: long>"
)

CALLS, IMPORTS, INHERITS, IMPLEMENTS, EXPORTS, ROUTES_TO = "calls", "imports", "inherits", "implements", "exports", "routes_to"
EXTERNAL = "<external>"
MODULE = "<module>"

# fixed values
CHARS_PER_TOKEN = 3
COMPRESSION_TOKENS = 2000
MAX_GRAPH_DEPTH = 10
MAX_GRAPH_ROWS = 200
MAX_CODE_BYTES = 4096
MAX_FILE_BYTES = 1 << 20
EMBEDDING_DIM = 384

#: Column added by each schema version with its default; a migration is a projection.
MIGRATIONS: dict[int, dict[str, list[tuple[str, str, object]]]] = {
    2: {"nodes": [("context_string", "string", None)]},
    3: {"nodes": [("name_tokens", "string", None)]},
    4: {"nodes": [("return_type", "string", None), ("param_types", "string", None)]},
    5: {"edges": [("metadata", "string", None)]},
    6: {"nodes": [("is_test", "boolean", False)]},
    7: {"files": [("indexed_at", "long", 0)]},
}


def migrate(df: DataFrame, relation: str, version: int) -> DataFrame:
    """The relation of schema ``version`` brought to the current one; a newer version than known is an error."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"schema version {version} is newer than {SCHEMA_VERSION}")
    for step in range(version + 1, SCHEMA_VERSION + 1):
        for name, kind, default in MIGRATIONS.get(step, {}).get(relation, []):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(default).cast(kind))
    return df
