"""Generated, minified, vendored and data files among source files.

Three sources of evidence are joined per file:

* attribute files (``.gitattributes``): their ``linguist-generated`` and ``linguist-vendored`` rules become rows, joined with the files by
  directory and resolved like the version control system does it: for each attribute the file in the deepest directory
  wins, inside one file the last matching line. Below all of them lies a general attribute file (a parameter), as
  the version control system knows one for each user; it speaks for repositories that declare nothing themselves;
* the content of the file's nodes: generator and bundling marks in the head, line
  directives, the shape of minified code, constants that are bulk data;
* path patterns (directory names, name suffixes) mined from the files that declarations of repositories or content mark: for each kind of
  origin a pattern is taken over where the lower bound of its share of marked files (Wilson, ``deviations`` standard errors) is at
  least ``min_lift`` times that of all files, over ``min_repositories`` repositories or more. The bound makes the test
  behave alike at every size: rare patterns need purer evidence.

A repository whose attribute files speak about a path keeps their word. Pattern counts are aggregated with map-side
combine and joined back by pattern; nothing is gathered per repository, and only the four counts of marked files go to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.storage import Scratch

KINDS = ("generated", "vendored", "minified", "data")

#: Lines of the head that only a tool writes (fixed values, several languages).
_GENERATED = re.compile(
    r"(?im)^\W*@generated\b(?! from)[^\n\"']*$|<auto-?generated>|\b(?:code|file|source|module|class) (?:was |is |has been )?(?:automatically |auto-?)?generated (?:by|from|with)\b"
    r"|\b(?:automatically|auto)[- ]?generated (?:by|from|with|file|code)\b|^\W*auto-?generated\b|generated by [^\n]*\bdo not (?:edit|modify)|do not (?:edit|modify)[^\n]*\bgenerated by"
    r"|manual changes will be lost|changes (?:to this file )?will be (?:lost|overwritten)|^\W*regenerate with:|^\W*\( ?\S+ \d[\d.]* output ?\)"
    r"|^\W*this code was produced by |^\W*produced from \S+\.\w+\s*[;,]|automatisch (?:erzeugt|generiert)|nicht von hand (?:ändern|bearbeiten)"
    r"|généré automatiquement|ne pas modifier (?:à la main|ce fichier)|generado automáticamente|no (?:editar|modificar) (?:a mano|este)|gerado automaticamente|não edite"
    r"|generato automaticamente|non modificare|自动生成|自動生成|请勿(?:手动)?(?:编辑|修改)|編集しないで|сгенерирован[оа]? автоматически|автоматически сгенерирован|не редактировать"
)
_PLUGIN = re.compile(r"(?im)^\W*source: *\S+\.(?:proto|thrift|xsd|xml|idl|g4|avdl|fbs|graphql|wsdl|ya?ml|json)\b")
_PLUGIN_BY = re.compile(r"(?im)^\W*plugin: *\S+")
#: Marks of copies of other projects' code; a group names the owner where the mark has one.
_COPIED = re.compile(
    r"(?im)^\W*vendored from \S+|bundled copy\b[^\n]*\b(?:upstream|in step)|this third-party sou|^\W*this is \S+ \(release [^)]*\), written by the|imported from upstream|\bdo not modify; upstream"
)
_OWNED = re.compile(
    r"(?im)copyright\s+(?:\(c\)|©)?\s*[\d,\- ]*\s*(?:by\s+)?(?:the\s+)?([\w.\-]+(?: [A-Z]\w+)?)\s+(?:authors|project|developers|contributors|team|software|inc|gmbh|foundation|labs|ltd)\b"
    r"|\(c\)\s*(?:\d[\d,\- ]*)?(?:the\s+)?([\w.\-]+)\s+(?:contributors|authors)\b"
)
_DIRECTIVE = re.compile(r"(?m)^\s*(?://|#|/\*|--)\s*line \d+ \"[^\"\n]+\"")

#: Customary paths of generated and vendored files in lower case, as an attribute file.
GENERAL_ATTRIBUTES = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/site-packages/** linguist-vendored
**/wp-includes/** linguist-vendored
**/vendor/** linguist-vendored
**/vendors/** linguist-vendored
**/vendored/** linguist-vendored
**/_vendor/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/3rdparty/** linguist-vendored
**/3rd_party/** linguist-vendored
**/pods/** linguist-vendored
**/carthage/** linguist-vendored
**/godeps/** linguist-vendored
**/external/** linguist-vendored
**/extern/** linguist-vendored
**/deps/** linguist-vendored
**/[a-z]*[-@][0-9].[0-9]*/** linguist-vendored
**/[a-z]*[-@][0-9][0-9].[0-9]*/** linguist-vendored
**/[a-z]*[-@]v[0-9].[0-9]*/** linguist-vendored
**/generated/** linguist-generated
**/__generated__/** linguist-generated
**/dist/** linguist-generated
*.min.* linguist-generated
*-min.* linguist-generated
*.bundle.* linguist-generated
*.chunk.* linguist-generated
*.packed.* linguist-generated
*.generated.* linguist-generated
*_generated.* linguist-generated
*.gen.* linguist-generated
*_gen.* linguist-generated
*.g.* linguist-generated
*.designer.* linguist-generated
*_pb2.* linguist-generated
*_pb2_grpc.* linguist-generated
*_grpc.* linguist-generated
*_pb.* linguist-generated
*.pb.* linguist-generated
"""


def _data_like(code: str) -> bool:
    """Whether a long constant is a list of values rather than text or settings."""
    body = code.split("=", 1)[-1]
    n = len(body)
    marks = len(re.findall(r"[\d,;|{}\[\]()\"'.:\\\s+\-]|0x|[0-9a-fA-F]{2}(?=[,\s])", body))
    longest = max((len(x) for x in re.findall(r"[A-Za-z0-9+/=]+", body)), default=0)
    rows = len(re.findall(r"(?m)^.{6,}[,\\n]", body)) + body.count("\\n")
    return marks >= 0.45 * n or longest >= 200 or rows >= 15


def content_evidence(kind: str | None, name: str | None, code: str | None, bulk_chars: int, long_line: int) -> list[tuple[str, str]]:
    """(evidence, owner) of one node; the owner is empty where the mark needs none. Null and empty code has none."""
    if not code:
        return []
    out = []
    if kind == "module":
        if _GENERATED.search(code) or (_PLUGIN.search(code) and _PLUGIN_BY.search(code)):
            out.append(("generated", ""))
        if _COPIED.search(code):
            out.append(("vendored", ""))
        for m in _OWNED.finditer(code):
            out.append(("vendored", (m.group(1) or m.group(2)).lower()))
    if kind == "constant":
        if len(code) >= bulk_chars and _data_like(code):
            out.append(("data", ""))
        return out
    if len(_DIRECTIVE.findall(code)) >= 2:
        out.append(("generated", ""))
    if len(code) >= long_line:
        for line in code.split("\n"):
            if len(line) >= long_line and line.count(" ") < 0.08 * len(line) and len(re.findall(r"[;{}(),=]", line)) > 0.1 * len(line):
                out.append(("minified", ""))
                break
    return out


def glob_regex(pattern: str) -> str | None:
    """The attribute-file glob as a regular expression over the path below the file's directory; None for directory-only and empty patterns."""
    if not pattern or pattern.endswith("/"):
        return None
    anchored = "/" in pattern.rstrip("/")
    p, out, i = pattern.lstrip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + r"\z"


def attribute_rules(text: str | None) -> list[tuple[str, str, bool]]:
    """(regular expression, attribute, value) of an attribute file's lines in order; comments, blank and malformed lines are skipped."""
    rules = []
    for line in (text or "").replace("\r", "").split("\n"):
        parts = line.strip().split()
        if len(parts) < 2 or parts[0].startswith("#") or (rx := glob_regex(parts[0].strip('"'))) is None:
            continue
        for a in parts[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", a)
            if m:
                rules.append((rx, m.group(2), not m.group(1) and (m.group(3) or "true").lower() not in ("false", "0", "no")))
    return rules


def _folders(path: Column) -> Column:
    """The directories above a path, from none (the empty name) downwards."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def declarations(current: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, generated, vendored): what the attribute files say of the files of ``current`` (file_id, path); null where no rule of an attribute matches, no row where none does at all.

    The text of an attribute file is the code of its nodes, in the order of their lines.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (f, start if start == start else 0, i, k, *rule)
                for f, start, i, code in zip(b["file_id"], b["start_line"], b["id"], b["code_content"])
                for k, rule in enumerate(attribute_rules(code))
            ]
            yield pd.DataFrame(rows, columns=["_f", "start", "node", "line", "rx", "attribute", "value"]).astype({"_f": "int64", "start": "int64", "node": "int64", "line": "int64", "value": "bool"})

    texts = nodes.where(F.col("file_id").isNotNull() & F.col("id").isNotNull() & F.contains("code_content", F.lit("linguist-"))).select("file_id", F.coalesce("start_line", F.lit(0)).alias("start_line"), "id", "code_content")
    rules = texts.mapInPandas(read, "_f long, start long, node long, line long, rx string, attribute string, value boolean")
    homes = current.where(F.col("path").rlike(r"(^|/)\.gitattributes\z")).select(F.col("file_id").alias("_h"), F.regexp_replace("path", r"/?\.gitattributes\z", "").alias("folder"))
    rules = rules.join(homes, F.col("_f") == F.col("_h")).drop("_f", "_h")
    above = current.select("file_id", "path", F.posexplode(_folders(F.col("path"))).alias("depth", "_folder"))
    below = F.expr("if(_folder = '', path, substring(path, length(_folder) + 2))")
    hits = above.withColumn("below", below).join(rules, (F.col("_folder") == F.col("folder")) & F.expr("regexp_like(below, concat('^', rx))"))
    last = hits.groupBy("file_id", "attribute").agg(F.max(F.struct("depth", "start", "node", "line", "value"))["value"].alias("value"))
    said = [F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in ("generated", "vendored")]
    return last.groupBy(F.col("file_id").alias("id")).agg(*said)


def general(path: Column, text: str, attribute: str) -> Column:
    """What a general attribute file says of a path below its repository, in lower case: the last matching line counts, null where none matches."""
    out: Column = F.lit(None).cast("boolean")
    for value, run in _runs([(rx, v) for rx, a, v in attribute_rules(text) if a == attribute]):
        out = F.when(path.rlike("^(?:" + "|".join(run) + ")"), F.lit(value)).otherwise(out)
    return out


def _runs(rules: list[tuple[str, bool]]) -> list[tuple[bool, list[str]]]:
    """Neighbouring rules of one value put together."""
    out: list[tuple[bool, list[str]]] = []
    for rx, value in rules:
        if out and out[-1][0] == value:
            out[-1][1].append(rx)
        else:
            out.append((value, [rx]))
    return out


def path_features(path: str | None) -> list[str]:
    """Directory names (below the repository, versions unified) and name suffixes of a path, in lower case."""
    parts = (path or "").lower().split("/")
    stem = parts[-1].rsplit(".", 1)[0] if "." in parts[-1][1:] else parts[-1]
    out = {f"dir:{'#-version' if re.fullmatch(r'[a-z][\w.]*[-@]v?[0-9]+([.][0-9]+)+', s) else s}" for s in parts[1:-1] if s}
    at = [m.start() for m in re.finditer(r"[._\-]", stem) if m.start() > 0]
    out |= {f"suffix:{stem[i:]}" for i in at[-2:]}
    return sorted(out)


def current_files(files: DataFrame) -> DataFrame:
    """One row per file id, that with the latest ``indexed_at`` (ties: the largest path); rows without an id are dropped."""
    last = F.max(F.struct("indexed_at", "path")).alias("_m")
    return files.where("id is not null").groupBy("id").agg(last).select("id", F.col("_m.path").alias("path"))


def origins(
    files: DataFrame,
    nodes: DataFrame,
    bulk_chars: int = 1000,
    long_line: int = 300,
    min_lift: float = 4.0,
    deviations: float = 3.0,
    min_repositories: int = 3,
    general_attributes: str = GENERAL_ATTRIBUTES,
    external: str = "<external>",
) -> DataFrame:
    """(file_id, path, reasons) of the files that are not hand-written; reasons is a sorted array of declared, general, the kinds of content evidence and mined patterns (``path:...``).

    Every node of every type is read whole. Null paths and null contents give no evidence; repeated
    rows count once; the pseudo-file of external symbols is no file. Empty tables give no rows.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, k, o)
                for i, kind, name, code in zip(b["file_id"], b["type"], b["name"], b["code_content"])
                for k, o in content_evidence(kind, name, code, bulk_chars, long_line)
            ]
            yield pd.DataFrame(rows, columns=["_f", "kind", "owner"]).astype({"_f": "int64"})

    scratch = Scratch(nodes.sparkSession)
    current = current_files(files).where(F.col("path").isNotNull() & (F.col("path") != external)).select(F.col("id").alias("file_id"), "path")
    repo = F.lower(F.split_part("path", F.lit("/"), F.lit(1)))
    texts = nodes.where(F.col("file_id").isNotNull() & (F.length("code_content") > 0)).select("file_id", "type", "name", "code_content")
    seen = texts.mapInPandas(look, "_f long, kind string, owner string").distinct()
    foreign = (F.col("owner") == "") | ((F.col("owner") != repo) & ~F.startswith(repo, F.concat("owner", F.lit("-"))))
    flags = [F.max(F.col("kind") == k).alias(f"c_{k}") for k in KINDS]
    content = current.join(seen, F.col("file_id") == F.col("_f")).where(foreign).groupBy(F.col("file_id").alias("_c")).agg(*flags)
    said = declarations(current, nodes)

    @F.pandas_udf("array<string>")
    def features_of(path: pd.Series) -> pd.Series:
        return path.map(path_features)

    below = F.lower(F.expr("substring(path, instr(path, '/') + 1)"))
    rows = current.join(content, F.col("file_id") == F.col("_c"), "left").join(said, F.col("file_id") == F.col("id"), "left")
    rows = rows.select(
        "file_id", "path", repo.alias("repo"), *[F.coalesce(f"c_{k}", F.lit(False)).alias(f"c_{k}") for k in KINDS], F.col("generated").alias("d_generated"), F.col("vendored").alias("d_vendored"),
        general(below, general_attributes, "generated").alias("g_generated"), general(below, general_attributes, "vendored").alias("g_vendored"), features_of("path").alias("features"),
    )
    rows = scratch.save(rows)

    marks = {k: F.coalesce(f"d_{k}", f"c_{k}") if k in ("generated", "vendored") else F.col(f"c_{k}") for k in KINDS}
    total = rows.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(m).alias(k) for k, m in marks.items()]).collect()[0]
    each = rows.select("file_id", "repo", *[m.cast("long").alias(k) for k, m in marks.items()], F.explode("features").alias("feature"))
    counts = each.groupBy("feature", "repo").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in KINDS])
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"), *[F.sum(k).alias(k) for k in KINDS])

    def surely(k: str) -> Column:
        z2, n, p = deviations**2, F.col("n"), F.col(k) / F.col("n")
        low = (p + z2 / (2 * n) - deviations * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        return (F.col(k) > 0) & (low >= min_lift * total[k] / max(total["all"], 1))

    mined = counts.where(F.col("repositories") >= min_repositories).where(surely(KINDS[0]) | surely(KINDS[1]) | surely(KINDS[2]) | surely(KINDS[3])).select(F.col("feature").alias("_f"))
    by_path = each.select("file_id", "feature").join(mined, F.col("feature") == F.col("_f"), "left_semi").groupBy(F.col("file_id").alias("_id")).agg(F.collect_set("feature").alias("patterns"))
    out = rows.join(by_path, F.col("file_id") == F.col("_id"), "left")
    declared, denied = [F.coalesce(F.col("d_generated") == v, F.lit(False)) | F.coalesce(F.col("d_vendored") == v, F.lit(False)) for v in (True, False)]
    by_general = F.coalesce("d_generated", "g_generated", F.lit(False)) | F.coalesce("d_vendored", "g_vendored", F.lit(False))
    found = F.concat(
        F.array_compact(F.array(F.when(declared, "declared"), F.when(by_general & ~declared, "general"), *[F.when(F.col(f"c_{k}"), k) for k in KINDS])),
        F.coalesce(F.transform("patterns", lambda x: F.concat(F.lit("path:"), x)), F.array().cast("array<string>")),
    )
    reasons = F.when(denied & ~declared & ~by_general, F.array().cast("array<string>")).otherwise(found)
    return out.select("file_id", "path", F.array_sort(reasons).alias("reasons")).where(F.size("reasons") > 0)
