"""File sources: directory scans, hashes, logs (inventory A)."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import predicates as P


def relative(path: str, root: str) -> str:
    return path.replace("\\", "/").removeprefix("file:").removeprefix(root.rstrip("/")).lstrip("/")


def ignore_rules(text: str | None, folder: str = "") -> list[tuple[str, bool]]:
    """(regular expression over paths, ignored) of the lines of an ignore file in a folder, in order; comments, blank and null texts give none.

    A pattern with a slash in it or before it is tied to the folder, others hold at any depth below; what lies below an ignored folder is ignored;
    ``!`` takes back.
    """
    out = []
    for line in (text or "").replace("\r", "").split("\n"):
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        taken = line.startswith("!")
        pattern = line[1:] if taken else line
        only_folders = pattern.endswith("/")
        pattern = pattern.rstrip("/")
        tied = "/" in pattern
        body, i, pattern = "", 0, pattern.lstrip("/")
        while i < len(pattern):
            if pattern.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif pattern.startswith("**", i):
                body, i = body + ".*", i + 2
            elif pattern[i] in "*?":
                body, i = body + ("[^/]*" if pattern[i] == "*" else "[^/]"), i + 1
            elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
                j = pattern.index("]", i + 2)
                body, i = body + "[" + pattern[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            else:
                body, i = body + re.escape(pattern[i]), i + 1
        if body:
            out.append((f"^{re.escape(folder + '/') if folder else ''}{'' if tied else '(?:.*/)?'}{body}{'/.*' if only_folders else '(?:/.*)?'}$", not taken))
    return out


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _listed(root: str) -> list[fs.FileInfo]:
    """The files below a folder that the session's file sources pass over: names, or folders, that begin with a dot or an underscore."""
    system, base = _filesystem(root)
    below = len(base.rstrip("/")) + 1
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return [x for x in found if x.type == fs.FileType.File and any(part[:1] in "._" for part in x.path[below:].split("/"))]


def ignore_files(root: str, listed: list[fs.FileInfo]) -> list[tuple[str, bool]]:
    """The rules of the ``.gitignore`` files among the listed ones, upper folders first: a list for the driver, one entry a line of these files."""
    system, base = _filesystem(root)
    below = len(base.rstrip("/")) + 1
    out = []
    for x in sorted((x for x in listed if x.base_name == ".gitignore"), key=lambda x: (x.path.count("/"), x.path)):
        with system.open_input_stream(x.path) as f:
            out += ignore_rules(f.read().decode(errors="replace"), x.path[below:].rpartition("/")[0])
    return out


def _underscored(spark: SparkSession, root: str, listed: list[fs.FileInfo], max_bytes: int) -> DataFrame:
    """(path, last_modified, length, content) of files such as ``__init__.py``: listed by the driver as all files are, read where the rows are."""
    base = _filesystem(root)[1]
    below = len(base.rstrip("/")) + 1
    rows = [(x.path[below:], int(x.mtime.timestamp()) if x.mtime else 0, x.size) for x in listed if not re.search(r"(^|/)\.", x.path[below:])]
    names = spark.createDataFrame(rows, "path string, last_modified long, length long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, home = _filesystem(root)
        for b in batches:
            content = []
            for p, n in zip(b["path"], b["length"]):
                if n > max_bytes:
                    content.append(b"")
                    continue
                with system.open_input_stream(f"{home.rstrip('/')}/{p}") as f:
                    content.append(f.read())
            yield b.assign(content=content)

    return names.mapInPandas(read, "path string, last_modified long, length long, content binary")


def scan_directory(spark: SparkSession, root: str, ignored: list[str] | None = None, max_bytes: int = S.MAX_FILE_BYTES, gitignore: bool = True) -> DataFrame:
    """(path, content_hash, last_modified, language, source, skip_reason) of the source files below a folder.

    Hidden files and folders, ``.git`` and ``vendor``, ignored globs, what ``.gitignore`` files name and unknown extensions are left out; too large files keep a row with
    skip_reason 'size' and no source. The listing and the path filters run before any content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(root)
    base = root.rstrip("/") + "/"
    full = F.regexp_replace(F.translate("path", "\\", "/"), "^file:/+", "/")
    rel = F.substring(full, len(base) + 1, 1 << 20)
    listed = _listed(root)
    rows = raw.select(rel.alias("path"), F.unix_timestamp("modificationTime").alias("last_modified"), "length", "content")
    rows = rows.unionByName(_underscored(spark, root, listed, max_bytes))
    rows = rows.where(~F.col("path").rlike(r"(^|/)(\.|vendor/)")).withColumn("language", P.file_language(F.col("path"))).where("language is not null")
    for g in ignored or []:
        rows = rows.where(~F.col("path").rlike(fnmatch.translate(g.rstrip("/") + ("/*" if g.endswith("/") else "")).replace("(?s:", "(?s)(?:")))
    out = F.lit(False)
    for rx, ignore in ignore_files(root, listed) if gitignore else []:  # the last rule that matches counts
        out = F.when(F.col("path").rlike(rx), F.lit(ignore)).otherwise(out)
    rows = rows.where(~out)
    big = F.col("length") > max_bytes
    return rows.select(
        "path", F.sha2("content", 256).alias("content_hash"), "last_modified", "language",
        F.when(~big, F.decode("content", "UTF-8")).alias("source"), F.when(big, "size").alias("skip_reason"),
    )


def changed_since(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Scanned files that the cache (path, last_modified) does not hold with the same time; only they need a hash."""
    c = cache.select(F.col("path").alias("_p"), F.col("last_modified").alias("_m"))
    return scan.join(c, (F.col("path") == F.col("_p")) & (F.col("last_modified") == F.col("_m")), "left_anti")


def skip_counts(scan: DataFrame) -> DataFrame:
    return scan.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Session records of JSON lines; malformed lines keep their text in ``_corrupt``."""
    from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

    fields = _parse_datatype_string(S.USAGE).fields
    schema = StructType([*fields, StructField("_corrupt", StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


#: How re-export lines start, by language.
BARRELS = {
    "rust": ["pub mod ", "mod ", "pub use ", "use "],
    "typescript": ["import "], "tsx": ["import "], "javascript": ["import "],
    "python": ["import "],
    "go": ["import "], "java": ["import "], "csharp": ["import "], "kotlin": ["import "],
    "ruby": ["require ", "require_relative "],
    "php": ["use ", "require ", "include "],
}


def barrel_lines(texts: DataFrame, most: int = 1000) -> DataFrame:
    """(path, line, content) of import and re-export lines among the first ``most`` lines of (path, language, text)."""
    lines = F.slice(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), 1, most)
    rows = texts.select("path", "language", F.posexplode(lines).alias("i", "content")).withColumn("t", F.ltrim("content"))
    hit = F.lit(False)
    for lang, starts in BARRELS.items():
        for s in starts:
            hit = hit | ((F.col("language") == lang) & F.col("t").startswith(s))
    hit = hit | (F.col("language").isin("typescript", "tsx", "javascript") & F.col("t").startswith("export ") & F.col("t").contains(" from "))
    hit = hit | ((F.col("language") == "python") & F.col("t").startswith("from ") & F.col("t").contains(" import "))
    return rows.where(hit).select("path", (F.col("i") + 1).alias("line"), "content")
