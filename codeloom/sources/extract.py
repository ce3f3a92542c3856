"""Symbols and relations of source texts as table functions (inventory A6 to A8, N, O).

The engine's contract starts at the symbol and relation rows. Python is parsed with the
standard library, block by block where a text has errors; the other languages, and what
stays broken of Python, by line lexers that know declarations, calls, imports,
supertypes, exports and routes. A parser is a function of (source) that gives
(symbols, relations); ``PARSERS`` can be extended.
"""

from __future__ import annotations

import ast
import json
import keyword
import re
import textwrap
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from codeloom import schema as S
from codeloom.storage import Scratch

SYMBOL = "node_type string, name string, qualified_name string, start_line int, end_line int, code_content string, signature string, doc_comment string, return_type string, param_types string, is_test boolean"
RELATION = "source_name string, target_name string, relation string, metadata string, source_language string"
HTTP = ("get", "post", "put", "delete", "patch", "head", "options")

Parser = Callable[[str], tuple[list[tuple], list[tuple]]]


def cut(code: str) -> str:
    """Code of at most 4096 bytes, cut at a character, with a mark where it was longer."""
    raw = code.encode()
    return code if len(raw) <= S.MAX_CODE_BYTES else raw[: S.MAX_CODE_BYTES].decode(errors="ignore") + "..."


_UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)
_GOES_ON = re.compile(r"[)\]}]|(?:else|elif|except|finally)\b")
_STARTS = re.compile(r"(?:async\s+def|def|class|import|from)\b|@")


def python_parts(source: str) -> Iterator[tuple[int, int, ast.Module | None]]:
    """(first line, line after the last, tree) of the parts of a text, lines from 0: the whole text, or its top-level blocks where it has an error.

    A block runs to the next line without indent, decorators and ``else`` parts included, and further while a bracket or string stays open; a
    block that is no Python has no tree. Trees have the line numbers of the text.
    """
    lines = source.split("\n")
    try:
        yield 0, len(lines), ast.parse(source)
        return
    except _UNPARSED:
        pass
    starts: list[int] = []
    for i, line in enumerate(lines):
        if not line.strip() or (line[0] in " \t" and starts) or _GOES_ON.match(line):
            continue
        last = next((k for k in range(i - 1, -1, -1) if lines[k].strip()), None)
        if last is None or not lines[last].startswith("@"):
            starts.append(i)
    ends = [*starts[1:], len(lines)]
    k = 0
    while k < len(starts):
        tree, j = None, k
        while True:
            try:
                tree = ast.increment_lineno(ast.parse(textwrap.dedent("\n".join(lines[starts[k] : ends[j]]))), starts[k])
            except _UNPARSED as e:
                if re.search("never closed|unterminated triple", str(e)) and j + 1 < len(starts) and not _STARTS.match(lines[starts[j + 1]]) and j < k + 50:
                    j += 1
                    continue
            break
        j = j if tree else k
        yield starts[k], ends[j], tree
        k = j + 1


_PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*(\(.*\))?\s*(?:->\s*([^:]+))?")
_PY_CLASS = re.compile(r"^(\s*)class\s+(\w+)\s*(?:\(([^)]*)\))?")
_PY_ROUTE = re.compile(rf"^\s*@[\w.]+\.({'|'.join(HTTP)}|route)\(\s*['\"]([^'\"]+)['\"](.*)", re.I)
_PY_IMPORT = re.compile(r"^\s*import\s+(.+)")
_PY_FROM = re.compile(r"^\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)")


def lex_python(lines: list[str], first: int, last: int) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of the lines from ``first`` to before ``last`` by line rules and indents, for blocks that the grammar rejects."""
    symbols: list[tuple] = []
    relations: list[tuple] = []
    scopes: list[tuple[int, str, str]] = []  # indent, kind, qualified name
    routes: list[tuple[str, str]] = []
    width = lambda x: len(x) - len(x.lstrip())
    for i in range(first, last):
        line = lines[i]
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line.lstrip().startswith((")", "]", "}")):
            scopes = [x for x in scopes if x[0] < width(line)]
        declared = None
        if m := _PY_ROUTE.match(line):
            given = re.search(r"methods\s*=\s*[\[(]([^\])]*)", m.group(3))
            verbs = re.findall(r"\w+", given.group(1)) if given else ["GET"]
            routes += [(v, m.group(2)) for v in (verbs if m.group(1).lower() == "route" else [m.group(1).upper()])]
        if m := _PY_DEF.match(line) or _PY_CLASS.match(line):
            is_class = m.re is _PY_CLASS
            end = next((k for k in range(i + 1, last) if lines[k].strip() and width(lines[k]) <= width(line)), last)
            while not lines[end - 1].strip():
                end -= 1
            top, above = i, []
            for k in range(i - 1, -1, -1):
                if not lines[k].strip().startswith(("#", "@")):
                    break
                if lines[k].strip().startswith("@"):
                    top = k
                else:
                    above.insert(0, lines[k].strip())
            declared = m.group(2)
            code = cut("\n".join(lines[top:end]))
            if is_class:
                qualified = declared
                symbols.append(("class", declared, declared, i + 1, end, cut("\n".join(lines[i:end])), None, "\n".join(above) or None, None, None, declared.startswith("Test")))
                bases = [x.strip().split("[")[0].rsplit(".", 1)[-1] for x in (m.group(3) or "").split(",") if x.strip() and "=" not in x]
                relations.extend((declared, x, S.INHERITS, None, "python") for x in bases)
            else:
                owner = scopes[-1][2] if scopes and scopes[-1][1] == "class" else None
                qualified = f"{owner}.{declared}" if owner else declared
                params, back = m.group(3), (m.group(4) or "").strip() or None
                signature = None if params is None else params + (f" -> {back}" if back else "")
                symbols.append(("method" if owner else "function", declared, qualified, top + 1, end, code, signature, "\n".join(above) or None, back, params, declared.startswith("test_") or declared == "test"))
                relations.extend((qualified, declared, S.ROUTES_TO, json.dumps({"method": v, "path": p}), "python") for v, p in routes)
            routes = []
            scopes.append((width(line), "class" if is_class else "function", qualified))
        elif (m := _PY_FROM.match(line)) and m.group(2):
            names = [x.strip(" ()").split(" as ")[0].strip() for x in m.group(3).split("#")[0].split(",")]
            relations.extend((S.MODULE, x, S.IMPORTS, json.dumps({"python_module": m.group(2)}), "python") for x in names if re.fullmatch(r"\w+|\*", x))
        elif m := _PY_IMPORT.match(line):
            names = [x.strip().split(" as ")[0].strip() for x in m.group(1).split("#")[0].split(",")]
            relations.extend((S.MODULE, x.rsplit(".", 1)[-1], S.IMPORTS, json.dumps({"python_module": x, "is_module_import": True}), "python") for x in names if re.fullmatch(r"\w+(?:\.\w+)*", x))
        elif (m := re.match(r"([A-Za-z_]\w*)\s*=(?!=)", line)) and m.group(1).isupper():
            symbols.append(("constant", m.group(1), m.group(1), i + 1, i + 1, cut(line), None, None, None, None, False))
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*", "\"\"", line)
        scope = scopes[-1][2] if scopes else S.MODULE
        relations.extend((scope, x, S.CALLS, None, "python") for x in re.findall(r"([A-Za-z_]\w*)\s*\(", code) if x != declared and not keyword.iskeyword(x))
    return symbols, relations


def parse_python(source: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of Python; of a text with errors block by block, by line rules where a block cannot be parsed."""
    lines = source.split("\n")
    symbols: list[tuple] = []
    relations: list[tuple] = []

    def callee(f: ast.expr) -> str | None:
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def visit(node: ast.AST, scope: str, owner: str | None, tree: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            inner, inside = scope, owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = child.name
                inner = f"{owner}.{name}" if owner else name
                first = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                params = ast.unparse(child.args)
                back = ast.unparse(child.returns) if child.returns else None
                code = cut("\n".join(lines[first - 1 : child.end_lineno]))
                above = []
                for k in range(first - 2, -1, -1):
                    if not lines[k].strip().startswith("#"):
                        break
                    above.insert(0, lines[k].strip())
                symbols.append(
                    ("method" if owner else "function", name, inner, first, child.end_lineno, code, f"({params})" + (f" -> {back}" if back else ""), "\n".join(above) or ast.get_docstring(child), back, f"({params})", name.startswith("test_") or name == "test")
                )
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        verb = d.func.attr.lower()
                        verbs = [verb.upper()] if verb in HTTP else []
                        if verb == "route":
                            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                            verbs = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]
                        relations.extend((inner, name, S.ROUTES_TO, json.dumps({"method": v, "path": d.args[0].value}), "python") for v in verbs)
                inside = None
            elif isinstance(child, ast.ClassDef):
                inner, inside = child.name, child.name
                symbols.append(("class", child.name, child.name, child.lineno, child.end_lineno, cut("\n".join(lines[child.lineno - 1 : child.end_lineno])), None, ast.get_docstring(child), None, None, child.name.startswith("Test")))
                relations.extend((child.name, b, S.INHERITS, None, "python") for b in map(callee, child.bases) if b)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    relations.append((S.MODULE, a.name.rsplit(".", 1)[-1], S.IMPORTS, json.dumps({"python_module": a.name, "is_module_import": True}), "python"))
            elif isinstance(child, ast.ImportFrom) and child.module:
                for a in child.names:
                    relations.append((S.MODULE, a.name, S.IMPORTS, json.dumps({"python_module": child.module}), "python"))
            elif isinstance(child, ast.Call) and (name := callee(child.func)):
                relations.append((scope or S.MODULE, name, S.CALLS, None, "python"))
            elif isinstance(child, ast.Assign) and node is tree:
                for t in child.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        symbols.append(("constant", t.id, t.id, child.lineno, child.end_lineno, cut("\n".join(lines[child.lineno - 1 : child.end_lineno])), None, None, None, None, False))
            visit(child, inner, inside, tree)

    for first, last, tree in python_parts(source):
        if tree is None:
            some, more = lex_python(lines, first, last)
            symbols.extend(some)
            relations.extend(more)
        else:
            visit(tree, "", None, tree)
    return symbols, relations


def unparsed_lines(source: str | None, language: str | None) -> int:
    """How many lines with text no grammar covers: of Python those of rejected blocks, which only line rules saw; all where a parser fails."""
    f = PARSERS.get((language or "").lower())
    if f is None or not source:
        return 0
    lines = source.split("\n")
    spans = [(0, len(lines))]
    try:
        if f is parse_python:
            spans = [(a, b) for a, b, tree in python_parts(source) if tree is None]
            f(source)
        else:
            f(source)
            spans = []
    except Exception:  # noqa: BLE001
        spans = [(0, len(lines))]
    return sum(1 for a, b in spans for x in lines[a:b] if x.strip())


_WORD = r"(?:[^\W\d]|\$)[\w$]*"
_DECLARE = {
    "js": [
        ("function", re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_WORD})\s*(?:<[^>]*>)?\s*(\([^)]*\))(?:\s*:\s*([^{{]+))?")),
        ("function", re.compile(rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(\([^)]*\))(?:\s*:\s*([^=]+?))?\s*=>")),
        ("class", re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORD})")),
        ("interface", re.compile(rf"^\s*(?:export\s+)?interface\s+({_WORD})")),
        ("type", re.compile(rf"^\s*(?:export\s+)?type\s+({_WORD})\s*(?:<[^=]*>)?\s*=")),
        ("enum", re.compile(rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+({_WORD})")),
        ("method", re.compile(rf"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*({_WORD})\s*(?:<[^>]*>)?\s*(\([^)]*\))(?:\s*:\s*([^{{]+?))?\s*\{{")),
    ],
    "rust": [
        ("function", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+({_WORD})\s*(?:<[^(]*>)?\s*(\([^)]*\))(?:\s*->\s*([^{{;]+))?")),
        ("struct", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+({_WORD})")),
        ("enum", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+({_WORD})")),
        ("interface", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({_WORD})")),
        ("constant", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?({_WORD})\s*()(?::\s*([^=;]+))?")),
    ],
    "go": [
        ("method", re.compile(rf"^func\s+\([^)]*\)\s*({_WORD})\s*(\([^)]*\))\s*([^{{]*)")),
        ("function", re.compile(rf"^func\s+({_WORD})\s*(?:\[[^\]]*\])?\s*(\([^)]*\))\s*([^{{]*)")),
        ("struct", re.compile(rf"^type\s+({_WORD})\s+struct\b")),
        ("interface", re.compile(rf"^type\s+({_WORD})\s+interface\b")),
    ],
    "jvm": [
        ("class", re.compile(rf"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|data|open|partial)\s+)*(?:class|object|record)\s+({_WORD})")),
        ("interface", re.compile(rf"^\s*(?:(?:public|private|protected|internal|static|sealed|partial)\s+)*(?:interface|protocol|trait)\s+({_WORD})")),
        ("struct", re.compile(rf"^\s*(?:(?:public|private|internal|readonly|ref|partial)\s+)*struct\s+({_WORD})")),
        ("enum", re.compile(rf"^\s*(?:(?:public|private|protected|internal|static)\s+)*enum\s+(?:class\s+)?({_WORD})")),
        ("function", re.compile(rf"^\s*(?:(?:public|private|protected|internal|open|override|suspend|inline|static|mutating|final|abstract)\s+)*(?:fun|func|function)\s+(?:<[^>]*>\s*)?({_WORD})\s*(\([^)]*\))(?:\s*(?::|->)\s*([^{{=]+))?")),
        ("method", re.compile(rf"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized|sealed|unsafe)\s+)+(?:[\w<>\[\],.?]+\s+)?({_WORD})\s*(\([^)]*\))()")),
    ],
    "c": [
        ("function", re.compile(rf"^(?!\s*(?:if|for|while|switch|return|else)\b)(?:[A-Za-z_][\w<>:,\s*&]*?[\s*&])({_WORD})\s*(\([^;{{)]*\))\s*()(?:const\s*)?\{{")),
        ("struct", re.compile(rf"^\s*(?:typedef\s+)?struct\s+({_WORD})\s*\{{?")),
        ("class", re.compile(rf"^\s*class\s+({_WORD})")),
        ("enum", re.compile(rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?({_WORD})")),
    ],
    "ruby": [
        ("method", re.compile(r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)\s*(\([^)]*\))?()")),
        ("class", re.compile(r"^\s*class\s+([A-Z]\w*)")),
        ("interface", re.compile(r"^\s*module\s+([A-Z]\w*)")),
    ],
}
_FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js", "rust": "rust", "go": "go", "java": "jvm", "csharp": "jvm", "kotlin": "jvm", "swift": "jvm", "php": "jvm", "dart": "jvm", "c": "c", "cpp": "c", "ruby": "ruby"}
_NOT_CALLS = frozenset("if for while switch catch return function fn func def match sizeof typeof when elif super new await yield assert print unless until in and or not".split())
_CALL = re.compile(rf"({_WORD}[?!]?)\s*\(")
_ROUTE = re.compile(rf"\b(?:app|router|server|api)\.({'|'.join(HTTP)})\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*,(?:[^,()]*,)*\s*(?:({_WORD}(?:\.{_WORD})*)\s*[,)]|(async\b|function\b|\())", re.I)
_GO_ROUTE = re.compile(rf"\.(?:HandleFunc|Handle)\(\s*\"(?:([A-Z]+) )?([^\"]+)\"\s*,\s*(?:{_WORD}\.)*({_WORD})")
_IMPORTS = {
    "js": re.compile(r"^\s*(?:import|export)\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+(\w+))?\s*from\s*['\"]([^'\"]+)|^\s*(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\(\s*['\"]([^'\"]+)"),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([^;]+);"),
    "go": re.compile(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "jvm": re.compile(r"^\s*(?:import|using|use)\s+(?:static\s+)?([\w.\\]+)"),
    "c": re.compile(r"^\s*#include\s*[<\"]([^>\"]+)"),
    "ruby": re.compile(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"),
}
_MORE_ARROWS = re.compile(rf"[,;]\s*(?:const\s+|let\s+|var\s+)?({_WORD})\s*=\s*(?:async\s*)?(\([^()]*\))\s*(?::\s*[\w<>\[\]| ]+)?=>")
_SUPER = re.compile(rf"\b(?:class|interface|struct|record|object)\s+({_WORD})\s*(?:<[^>{{]*>)?\s*(?:\([^)]*\))?\s*(?:extends\s+([\w.<>, ]+?))?\s*(?:implements\s+([\w.<>, ]+?))?\s*(?::\s*([\w.<>, ()]+?))?\s*(?:\{{|$)")
_RUBY_SUPER = re.compile(r"^\s*class\s+([A-Z]\w*)\s*<\s*([A-Z][\w:]*)")
_IMPL = re.compile(rf"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?({_WORD})")


def _end(lines: list[str], at: int, family: str) -> int:
    """Last line (from 0) of the declaration that begins at a line: closing brace, or 'end' at the same indent."""
    if family == "ruby":
        indent = len(lines[at]) - len(lines[at].lstrip())
        for k in range(at + 1, len(lines)):
            if re.match(rf"^\s{{{indent}}}end\b", lines[k]):
                return k
        return at
    depth, seen = 0, False
    for k in range(at, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[k])
        for c in bare:
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
        if seen and depth <= 0:
            return k
        if not seen and bare.rstrip().endswith(";"):
            return k
    return at if not seen else len(lines) - 1


_STATEMENT = {"js": re.compile(r"^\s*(?:import|export)\b[^'\";]*$"), "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\b[^;]*$"), "go": re.compile(r"^import\s*\($")}


def _whole(lines: list[str], at: int, family: str) -> str:
    """The statement that begins at a line: imports up to their end, headers up to the bracket that closes their parameters. What never closes is its first line."""
    line = lines[at]
    if family in ("js", "rust") and _STATEMENT[family].match(line) and (family == "rust" or "{" in line or "*" in line or line.split()[0] == "import"):
        end = ";" if family == "rust" else None
        text = line
        for k in range(at + 1, len(lines)):
            text += " " + lines[k].strip()
            if end in text if end else re.search(r"from\s*['\"][^'\"]+['\"]", text):
                return text
            if end is None and re.match(r"^\s*(?:import|export|const|let|var|function|class)\b", lines[k]):
                return line  # an export list, or an import that is never closed
        return line
    open_ = line.count("(") - line.count(")")
    if open_ > 0 and re.search(r"\b(?:function|fn|func|fun|def|const|let|var|public|private|protected|internal|static|void|int|class)\b", line):
        text = line
        for k in range(at + 1, len(lines)):
            text += " " + lines[k].strip()
            open_ += lines[k].count("(") - lines[k].count(")")
            if open_ <= 0:
                return text
            if re.match(r"^\s*(?:export\s+)?(?:async\s+)?(?:pub\s+)?(?:function|fn|func|fun|def|class|struct|interface)\b", lines[k]):
                return line
    return line


def use_leaves(tree: str) -> list[str]:
    """The names a use tree brings in: 'a::{b, c::{d as e, self}}' gives b, d and c; globs give none."""
    out: list[str] = []

    def walk(text: str, parent: str) -> None:
        depth, start, parts = 0, 0, []
        for i, ch in enumerate(text + ","):
            depth += (ch == "{") - (ch == "}")
            if ch == "," and depth == 0:
                parts.append(text[start:i].strip())
                start = i + 1
        for part in filter(None, parts):
            head, brace, rest = part.partition("{")
            if brace:
                walk(rest.rsplit("}", 1)[0], head.strip().rstrip(":").rsplit("::", 1)[-1] or parent)
                continue
            name = part.split(" as ")[0].strip().rsplit("::", 1)[-1]
            if name == "self":
                name = parent
            if name and name != "*":
                out.append(name)

    walk(tree.strip().rstrip(";"), "")
    return out


def lex(source: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations by line rules; what the rules do not know is skipped."""
    family = _FAMILY[language]
    lines = source.replace("\r\n", "\n").split("\n")
    symbols: list[tuple] = []
    relations: list[tuple] = []
    scopes: list[tuple[int, str, str]] = []  # last line, kind, name
    tests_until = -1
    for i, line in enumerate(lines):
        scopes = [s for s in scopes if s[0] >= i]
        owner = next((s[2] for s in reversed(scopes) if s[1] in ("class", "interface", "struct", "impl")), None)
        if family == "rust" and (m := _IMPL.match(line)):
            end = _end(lines, i, family)
            scopes.append((end, "impl", m.group(2)))
            if m.group(1):
                trait = m.group(1).rsplit("::", 1)[-1]
                relations.append((m.group(2), trait, S.IMPLEMENTS, None, language))
                for k in range(i + 1, end):
                    if f := re.match(rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+({_WORD})", lines[k]):
                        relations.append((trait, f.group(1), S.IMPLEMENTS, None, language))
        if (family == "rust" and re.match(r"^\s*mod\s+tests\b", line)) or (family == "js" and re.match(r"^\s*(?:describe|it|test)\s*\(", line)):
            tests_until = max(tests_until, _end(lines, i, family))
        declared = None
        whole = _whole(lines, i, family)
        for kind, rx in _DECLARE[family]:
            m = rx.match(whole)
            if not m or (kind == "method" and family == "js" and owner is None):
                continue
            if m.group(1) in _NOT_CALLS and (family == "c" or (kind == "method" and family in ("js", "jvm"))):
                continue  # no keyword says that this is a declaration: it may be a statement
            groups = [*m.groups(), None, None]
            name, params, back = groups[0], groups[1] or None, (groups[2] or "").strip() or None
            end = _end(lines, i, family)
            if kind == "function" and owner and family not in ("rust", "go", "c"):
                kind = "method"
            qualified = f"{owner}.{name}" if owner and kind in ("method", "function") else name
            above = []
            for k in range(i - 1, -1, -1):
                if not re.match(r"^\s*(?://|/\*|\*|#(?!\[))", lines[k]):
                    if re.match(r"^\s*(?:#\[|@)", lines[k]):
                        continue
                    break
                above.insert(0, lines[k].strip())
            marked = any(re.match(r"^\s*#\[(?:tokio::)?(?:test|cfg\(test\))", lines[k]) for k in range(max(0, i - 3), i))
            signature = None if params is None else params + (f" -> {back}" if back else "")
            symbols.append((kind, name, qualified, i + 1, end + 1, cut("\n".join(lines[i : end + 1])), signature, "\n".join(above) or None, back, params, i <= tests_until or marked))
            scopes.append((end, "class" if kind in ("class", "interface", "struct") else kind, qualified if kind in ("function", "method") else name))
            if family == "js" and re.match(r"^\s*export\b", line):
                relations.append((S.MODULE, name, S.EXPORTS, None, language))
            declared = name
            break
        if family == "js":  # further named arrows of the line
            for m in _MORE_ARROWS.finditer(line):
                symbols.append(("function", m.group(1), m.group(1), i + 1, i + 1, cut(line), m.group(2), None, None, m.group(2), i <= tests_until))
        scope = next((s[2] for s in reversed(scopes) if s[1] in ("function", "method")), S.MODULE)
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "\"\"", line)
        for m in _CALL.finditer(code):
            if m.group(1) not in _NOT_CALLS and m.group(1) != declared and not re.match(r"^\s*(?:#|\*|import\b|use\b)", code):
                relations.append((scope, m.group(1), S.CALLS, None, language))
        if family in _IMPORTS and (m := _IMPORTS[family].match(whole)):
            named = [g for g in m.groups() if g]
            if family == "js":
                parts = [x.strip().removeprefix("type ").split(" as ")[0].strip() for g in named[:-1] for x in g.split(",")]
                relations.extend((S.MODULE, x, S.IMPORTS, None, language) for x in parts if x)
            elif family == "rust":
                relations.extend((S.MODULE, x, S.IMPORTS, None, language) for x in use_leaves(named[0]))
            else:
                relations.append((S.MODULE, re.split(r"[/.\\]", named[0].removesuffix(".h").rstrip("/"))[-1], S.IMPORTS, None, language))
        if m := _SUPER.search(line):
            names = lambda g: [x.strip().split("<")[0].split("(")[0].strip() for x in (g or "").split(",") if x.strip()]
            relations.extend((m.group(1), x, S.INHERITS, None, language) for x in names(m.group(2)))
            relations.extend((m.group(1), x, S.IMPLEMENTS, None, language) for x in names(m.group(3)))
            for k, x in enumerate(names(m.group(4))):
                bridge = language == "csharp" and re.match(r"I[A-Z]", x)
                relations.append((m.group(1), x, S.IMPLEMENTS if bridge or (k and language in ("kotlin", "swift")) else S.INHERITS, None, language))
        if family == "ruby" and (m := _RUBY_SUPER.match(line)):
            relations.append((m.group(1), m.group(2).rsplit("::", 1)[-1], S.INHERITS, None, language))
        if family == "js" and (m := _ROUTE.search(line)):
            meta: dict = {"method": m.group(1).upper(), "path": m.group(2)}
            target = (m.group(3) or "").rsplit(".", 1)[-1]
            if not target:
                meta |= {"inline": True, "handler_start_line": i + 1, "handler_end_line": _end(lines, i, family) + 1}
                target = scope
            relations.append((target, target, S.ROUTES_TO, json.dumps(meta), language))
        if family == "go" and (m := _GO_ROUTE.search(line)):
            relations.append((m.group(3), m.group(3), S.ROUTES_TO, json.dumps({"method": m.group(1) or "ANY", "path": m.group(2)}), language))
    return symbols, relations


def parse_markdown(source: str) -> tuple[list[tuple], list[tuple]]:
    """Headings of both styles as h1 to h6; a section runs to the next heading of its level or above."""
    lines = source.replace("\r\n", "\n").split("\n")
    heads, fence = [], False
    for i, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and (m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line)):
            heads.append((i, len(m.group(1)), m.group(2)))
        elif not fence and i and lines[i - 1].strip() and (m := re.match(r"^(=+|-{2,})\s*$", line)) and not lines[i - 1].startswith("#"):
            heads.append((i - 1, 1 if m.group(1)[0] == "=" else 2, lines[i - 1].strip()))
    out = []
    for k, (i, depth, title) in enumerate(heads):
        end = next((j for j, d, _ in heads[k + 1 :] if d <= depth), len(lines))
        out.append((f"h{depth}", title, title, i + 1, end, cut("\n".join(lines[i:end])), None, None, None, None, False))
    return out, []


PARSERS: dict[str, Parser] = {"python": parse_python, "markdown": parse_markdown} | {k: (lambda s, k=k: lex(s, k)) for k in _FAMILY}


def parse(source: str | None, language: str | None) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of a text; null texts, unknown languages and failing parsers give none."""
    f = PARSERS.get((language or "").lower())
    if f is None or not source:
        return [], []
    try:
        return f(source)
    except Exception:  # noqa: BLE001
        return [], []


@udtf(returnType=SYMBOL, useArrow=True)
class extract_symbols:
    """Symbol rows of (source, language)."""

    def eval(self, source: str, language: str):
        yield from parse(source, language)[0]


@udtf(returnType=RELATION, useArrow=True)
class extract_relations:
    """Relation rows of (source, language)."""

    def eval(self, source: str, language: str):
        yield from parse(source, language)[1]


def register(spark: SparkSession) -> None:
    """Make ``extract_symbols`` and ``extract_relations`` callable from SQL (lateral)."""
    spark.udtf.register("extract_symbols", extract_symbols)
    spark.udtf.register("extract_relations", extract_relations)


def extract(sources: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, relations) of (path, language, source). Each text is parsed once, in Arrow batches; both kinds of rows are written together and read apart."""
    scratch = scratch or Scratch(sources.sparkSession)
    names = [[c.split()[0] for c in spec.split(", ")] for spec in (SYMBOL, RELATION)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, s in zip(b["path"], b["language"], b["source"]):
                symbols, relations = parse(s, lang)
                rows += [(p, lang, "symbol", *r, *[None] * len(names[1])) for r in symbols]
                rows += [(p, lang, "relation", *[None] * len(names[0]), *r) for r in relations]
            yield pd.DataFrame(rows, columns=["path", "language", "row", *names[0], *names[1]], dtype=object)

    rows = sources.select("path", "language", "source")
    both = scratch.save(rows.mapInPandas(each, f"path string, language string, row string, {SYMBOL}, {RELATION}"))
    return tuple(both.where(F.col("row") == kind).select("path", "language", *names[k]) for k, kind in enumerate(("symbol", "relation")))  # type: ignore[return-value]


def skipped(sources: DataFrame) -> DataFrame:
    """(path, language, skip_reason, lines): the files of (path, language, source) that are not parsed in full, with reason 'parse', and how many lines that concerns."""

    @F.pandas_udf("long")
    def lost(source: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([unparsed_lines(x, lang) for x, lang in zip(source, language)], dtype="int64")

    rows = sources.select("path", "language", lost("source", "language").alias("lines"))
    return rows.where("lines > 0").select("path", "language", F.lit("parse").alias("skip_reason"), "lines")


def build(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, nodes, edges) of (path, content_hash, last_modified, language, source): symbols with stable ids, relations resolved over all files at once.

    Python imports are held to the files of their module. Modules no file provides, and imports and supertypes that no symbol has the name of, lead to
    sentinel nodes of the external pseudo-file.
    """
    from codeloom.functions.identifiers import split_column
    from codeloom.graph import node_key
    from codeloom.operators.resolve import resolve, resolve_modules, sentinels

    files = sources.select(F.xxhash64("path").alias("id"), "path", "content_hash", "last_modified", "language", F.unix_timestamp().alias("indexed_at"))
    scratch = Scratch(sources.sparkSession)
    symbols, relations = extract(sources, scratch)
    n = symbols.select(
        node_key(F.col("path"), F.col("node_type"), F.col("qualified_name"), F.col("start_line")).alias("id"), F.xxhash64("path").alias("file_id"), F.col("node_type").alias("type"), "name", "qualified_name",
        F.col("start_line").cast("long"), F.col("end_line").cast("long"), "code_content", "signature", "doc_comment", F.lit(None).cast("string").alias("context_string"),
        split_column(F.col("name")).alias("name_tokens"), "return_type", "param_types", "is_test", "path", "language",
    )
    module = sources.select(
        node_key(F.col("path"), F.lit("module"), F.lit(S.MODULE), F.lit(0)).alias("id"), F.xxhash64("path").alias("file_id"), F.lit("module").alias("type"), F.lit(S.MODULE).alias("name"), F.col("path").alias("qualified_name"),
        F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), F.lit("").alias("code_content"), *[F.lit(None).cast("string").alias(c) for c in ("signature", "doc_comment", "context_string", "name_tokens", "return_type", "param_types")],
        F.lit(False).alias("is_test"), "path", "language",
    )
    # nodes and relations are read by several branches below
    nodes = scratch.save(n.unionByName(module))
    # the source of a relation: its qualified name in the file first, then the bare name
    own = nodes.select(F.col("id").alias("source_id"), F.col("path").alias("_p"), F.explode(F.array_distinct(F.array(F.when(F.col("type") == "module", F.lit(S.MODULE)).otherwise(F.col("qualified_name")), "name"))).alias("_key"), "qualified_name")
    r = relations.withColumn("rel_id", F.xxhash64("path", "source_name", "target_name", "relation", "metadata")).dropDuplicates(["rel_id"])
    r = r.join(own, (F.col("path") == F.col("_p")) & (F.col("source_name") == F.col("_key")))
    best = F.max(F.struct((F.col("qualified_name") == F.col("source_name")).cast("int").alias("q"), (-F.col("source_id")).alias("s")))
    r = r.groupBy("rel_id", "path", "language", "source_name", "target_name", "relation", "metadata").agg(best.alias("b")).withColumn("source_id", -F.col("b.s")).drop("b")
    r = scratch.save(r)
    known = nodes.select("id", "name", "path", "language")
    module_meta = F.from_json("metadata", S.IMPORT_METADATA)
    imports = r.where(F.col("relation") == S.IMPORTS).withColumn("_m", module_meta).select("rel_id", "source_id", "target_name", "_m.python_module", "_m.is_module_import").where("python_module is not null")
    targets, outside = resolve_modules(imports, known, sources.select("path"))
    settled = targets.select("rel_id").unionByName(outside.select("rel_id")).select(F.col("rel_id").alias("_d")).distinct()
    rest = r.join(settled, F.col("rel_id") == F.col("_d"), "left_anti")
    found = resolve(rest.select("rel_id", "source_id", "path", "language", "target_name", "relation"), known).select("rel_id", "source_id", "target_id", "relation")
    found = found.unionByName(targets.where("source_id <> target_id").withColumn("relation", F.lit(S.IMPORTS)))
    meta = r.select(F.col("rel_id").alias("_r"), "metadata").distinct()
    named = known.select(F.col("name").alias("_n")).distinct()
    lost = rest.where(F.col("relation").isin(S.IMPORTS, S.IMPLEMENTS)).join(named, F.col("target_name") == F.col("_n"), "left_anti")
    lost = lost.select("source_id", F.col("target_name").alias("name"), "relation", F.when(F.col("relation") == S.IMPLEMENTS, "trait").otherwise("module").alias("kind"))
    lost = lost.unionByName(outside.select("source_id", F.col("python_module").alias("name"), F.lit(S.IMPORTS).alias("relation"), F.lit("external_module").alias("kind")))
    ext = sentinels(lost)
    blank = {c: F.lit(None).cast("string") for c in ("signature", "doc_comment", "context_string", "name_tokens", "return_type", "param_types")}
    zero = {c: F.lit(0).cast("long") for c in ("start_line", "end_line")}
    nodes = nodes.drop("path", "language").unionByName(ext.withColumns({"qualified_name": F.concat(F.lit(f"{S.EXTERNAL}/"), "name"), "code_content": F.lit(""), "is_test": F.lit(False)} | blank | zero))
    away = lost.select("source_id", "name", "relation").distinct().join(ext.select(F.col("id").alias("target_id"), F.col("name").alias("_n")), F.col("name") == F.col("_n"))
    away = away.select("source_id", "target_id", "relation", F.lit(None).cast("string").alias("metadata"))
    edges = found.join(meta, F.col("rel_id") == F.col("_r")).select("source_id", "target_id", "relation", "metadata").unionByName(away)
    edges = edges.select(F.xxhash64("source_id", "target_id", "relation", "metadata").alias("id"), "source_id", "target_id", "relation", "metadata")
    outer = ext.limit(1).select(F.col("file_id").alias("id"), F.lit(S.EXTERNAL).alias("path"), F.lit("external").alias("content_hash"), F.lit(0).cast("long").alias("last_modified"), F.lit("external").alias("language"), F.unix_timestamp().alias("indexed_at"))
    return files.unionByName(outer).dropDuplicates(["id"]), nodes, edges.dropDuplicates(["id"])
