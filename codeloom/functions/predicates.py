"""Predicates of the code graph as Column expressions (never UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import schema as S

# fixed values
EXTENSIONS = {
    "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "py": "python", "pyi": "python", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "html": "html", "htm": "html", "css": "css", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "php": "php",
    "swift": "swift", "dart": "dart", "md": "markdown", "mdx": "markdown", "markdown": "markdown",
}
TYPE_ALIASES = {
    "fn": ["function", "method"], "func": ["function", "method"], "function": ["function", "method"], "method": ["function", "method"],
    "class": ["class"], "struct": ["struct"], "enum": ["enum"],
    "interface": ["interface", "trait"], "iface": ["interface", "trait"], "trait": ["interface", "trait"],
    "type": ["type", "type_alias"], "type_alias": ["type", "type_alias"],
    "const": ["constant"], "constant": ["constant"], "var": ["variable"], "variable": ["variable"], "module": ["module"],
}
NOISE_NAMES = (
    "new default from into as_str to_string clone fmt display drop try_from try_into as_ref as_mut borrow borrow_mut deref deref_mut eq ne cmp partial_cmp hash "
    "serialize deserialize next iter into_iter build builder len is_empty unwrap unwrap_or unwrap_or_else unwrap_or_default expect ok err map map_err and_then "
    "or_else filter flatten push pop insert remove contains get to_owned to_vec collect join flush close read write"
).split()


def normalised_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_language(path: Column) -> Column:
    """Language by extension; dotfiles and unknown extensions give null."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


def is_test_symbol(name: Column, path: Column) -> Column:
    named = name.startswith("test_") | name.endswith("Test") | name.endswith("Tests")
    placed = path.startswith("tests/") | path.startswith("test/") | path.contains("__tests__/")
    for end in ("_test.go", "_test.rs", ".test.ts", ".test.js", ".test.tsx", ".test.jsx", ".spec.ts", ".spec.js"):
        placed = placed | path.endswith(end)
    return F.coalesce(named, F.lit(False)) | F.coalesce(placed, F.lit(False))


def is_test(name: Column, path: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | is_test_symbol(name, path)


def is_test_in_statistics(name: Column, path: Column, flag: Column) -> Column:
    """The narrower predicate of module statistics and hot functions; LIKE there ignores ASCII case."""
    low, p = F.lower(name), F.lower(path)
    return F.coalesce(flag, F.lit(False)) | F.coalesce(low.startswith("test_"), F.lit(False)) | F.coalesce(p.startswith("tests/") | p.contains("_test."), F.lit(False))


def is_test_path(path: Column) -> Column:
    """The predicate of edge resolution."""
    out = path.startswith("tests/") | path.startswith("test/")
    for part in (".test.", "_test.", "/tests/", "/test/", ".spec."):
        out = out | path.contains(part)
    return F.coalesce(out, F.lit(False))


def normalise_type(alias: str) -> list[str]:
    """Canonical node types of a filter word; an unknown word has none."""
    return TYPE_ALIASES.get(alias.lower(), [])


def language_family(language: Column) -> Column:
    return F.when(language.isin("javascript", "typescript", "tsx"), "js").when(language.isin("c", "cpp"), "c").otherwise(language)


def compatible(a: Column, b: Column) -> Column:
    """Same family, or a language is unknown."""
    return a.isNull() | b.isNull() | (language_family(a) == language_family(b))


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def any_prefix(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def directory(path: Column) -> Column:
    """The part before the last slash, '.' where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def valid_json(text: Column) -> Column:
    """The text where it parses as a whole, else null."""
    return F.when(F.get_json_object(text, "$").isNotNull(), text)


def route(metadata: Column, field: str) -> Column:
    return F.get_json_object(valid_json(metadata), f"$.{field}")


def route_text(metadata: Column, name: Column) -> Column:
    """'METHOD path', or the name where the metadata has none."""
    return F.coalesce(F.concat(route(metadata, "method"), F.lit(" "), route(metadata, "path")), name)


def parse_route(text: str) -> tuple[str | None, str]:
    """'GET /x' as (method, path); a bare path has no method."""
    head, _, rest = text.strip().partition(" ")
    if rest and head.upper() in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"):
        return head.upper(), rest.strip()
    return None, text.strip()


def error_kind(message: Column) -> Column:
    """Class of an error message, in order of preference."""
    c = lambda t: message.contains(t)
    return (
        F.when(c("FOREIGN KEY constraint failed"), "fk")
        .when(c("Indexing in progress") | c("retry your request"), "timeout")
        .when(c("Ambiguous symbol"), "ambiguous")
        .when(c("not found in index") | c("not found in the index"), "not_found")
        .when(c("must not be empty") | c("Must pass") | message.startswith("Usage:"), "empty_input")
        .otherwise("other")
    )


def risk_level(prod_callers: Column, routes: Column, removal: bool, kind: Column | None = None) -> Column:
    """HIGH, MEDIUM, LOW; UNKNOWN for what is no function and has no production caller."""
    level = F.when((prod_callers > 10) | (routes >= 3) | F.lit(removal), "HIGH").when((prod_callers > 3) | (routes > 0), "MEDIUM").otherwise("LOW")
    if kind is None:
        return level
    return F.when(~kind.isin("function", "method") & (prod_callers == 0), "UNKNOWN").otherwise(level)
