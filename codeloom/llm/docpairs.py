"""Functions paired with their documentation.

A text is cut into tokens: comment blocks, string statements, annotations, runs of
lines that cannot start a function (water), and, for every line that might, its single
words, brackets and marks. An island grammar over these tokens says what a function
header is in the common languages (modifiers, keyword, name, parameters with nested
brackets, result type, opening mark), which comments lead it and which string opens its
body. The generalised LL parser takes the cheapest derivation: water costs little, a
function keyword outside a header costs more, and a bracket that is never closed is put in where
a line ends, so a broken header loses its own rest and not the functions behind it.
Function bodies are not nested in the grammar: every item has a bounded length and parsing takes
time in proportion to the text. Only the sequence of token kinds matters, so parses are kept by that sequence.

The documentation is then reduced to its descriptive sentences. What the corpus repeats is
template text: the hashes of all sentences, of any length, are counted over all documented functions with
map-side combine; a sentence that surely stands in more than ``template_share`` of them is
dropped, and functions with nothing else with it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.gll import Parser
from codeloom.storage import Scratch

# Token kinds. Lines: C comment, S string statement, A annotation, W other lines (water).
# A line of water ends every construct, so the parts between water are parsed on their own.
# Inside a line that may start a function: L its start, M modifier, K function keyword, V const/let/var, N other word,
# X control word, the brackets ( ) [ ] { }, the marks < > : ; = . , g (=> and ->), s string, o anything else.
_WITHIN = "MVXNLSCA<>:=.,gso"
_LINE_KINDS = "LCSA"
GRAMMAR = {
    "File": [("Items",)],
    "Items": [(), ("Items", "Item")],
    "Item": [("Lead", "Lhead", "Head", "Doc"), ("!1:C", "Ccomment"), ("A",), (f"?1:L{_WITHIN.replace('C', '')};(){{}}[]",), ("?5:K",)],
    "Lead": [(), ("Lead", "Clead"), ("Lead", "A")],
    "Head": [
        ("Mods", "K", "Name", "Params", "Tail"),  # def f(..), function f(..), fn f<T>(..)
        ("Mods", "K", "Name", f"!0:{_LINE_KINDS};{{}}", "Tail"),  # a header without parameters
        ("Mods", "K", "Params", "Name", "Params", "Tail"),  # a method with a receiver
        ("Mods", "K", "Params", "Tail"),  # a function without a name
        ("Mods", "V", "Nname", "Type", "=", "Mods", "Value"),  # a name that is given a function
        ("Mods", "Words", "Nname", "Closed", "Ends", "{", "Tail"),  # T f(..) { and f(..) {
        ("Mods", "Words", "Nname", "Closed", "Ends", "L", "{", "Tail"),
        ("M", "Mods", "Words", "Nname", "Params", "Ends", f"!0:{_LINE_KINDS}"),
    ],
    "Mods": [(), ("Mods", "M")],
    "Words": [(), ("Words", "[N<>:.,o]"), ("Words", "[", "]")],
    "Name": [("Nname",), ("Name", ".", "Nname"), ("Name", ":", ":", "Nname"), ("Name", "<", "Angle", ">"), ("<", "Angle", ">", "Nname")],
    "Angle": [(), ("Angle", "[NMKVXo:.,=gs]"), ("Angle", "[", "Angle", "]"), ("Angle", "<", "Angle", ">")],
    "Value": [("Params", "Type", "g", "Tail"), ("N", "g", "Tail"), ("K", "Params", "Tail"), ("K", "Name", "Params", "Tail")],
    "Type": [(), ("Type", "[:NMo.,<>s]"), ("Type", "[", "Within", "]")],
    "Params": [("Closed",), ("(", "Within", f"!3:{_LINE_KINDS}{{;")],  # a bracket that is not closed costs 3
    "Closed": [("(", "Within", ")")],
    "Within": [(), ("Within", f"[{_WITHIN}]"), ("Within", "Closed"), ("Within", "[", "Within", "]"), ("Within", "{", "Within", "}"), ("Within", "?4:K")],
    "Ends": [(), ("Ends", "[NM.,<>:ogs]"), ("Ends", "[", "Within", "]"), ("Ends", "Closed")],
    "Tail": [(), ("Tail", "[MVXNKso<>:;=.,g(){}]"), ("Tail", "["), ("Tail", "]")],
    "Doc": [(), ("Gap", "Sdoc")],
    "Gap": [(), ("Gap", "C")],
}
_PARSER = Parser(GRAMMAR, "File")

# Words of the common languages.
_MODIFIERS = "export default public private protected internal static final async override virtual abstract unsafe extern inline sealed synchronized native local suspend open operator partial readonly constexpr explicit friend".split()
_KEYWORDS = "def function func fn fun sub".split()
_CONTROL = "if for while switch catch return else do try with match throw new raise elif except unless until when case await yield delete assert print using lock defer go select end begin rescue ensure loop foreach import from typedef struct class enum interface namespace".split()
_NAMERS = "const let var val".split()

_ANY = "|".join
_INLINE = re.compile(r"[;}]\s*(?=(?:async\s+)?function\b)")
_FIRST = re.compile(r"[\w~]+")
_STARTS = re.compile(
    rf"^\s*(?:(?:{_ANY(_MODIFIERS)}|pub(?:\([^)]*\))?|{_ANY(_NAMERS)})\s+)*(?:{_ANY(_KEYWORDS)})\b(?!\s*[.=:,;)\]])"
    rf"|^\s*(?:export\s+)?(?:{_ANY(_NAMERS)})\s[^=]*=\s*(?:async\b|function\b|\(|\w+\s*=>)"
    rf"|^\s*(?:{_ANY(_MODIFIERS)})\s[^=;]*\("
)
_CALL_LIKE = re.compile(rf"^\s*(?!(?:{_ANY(_CONTROL)})\b)[\w~][\w<>\[\],:&*?.~ \t]*\(")
_TOKEN = re.compile(
    r"""(?P<s>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)|(?P<c>//[^\n]*|/\*.*?\*/|(?<=\s)\#[^\n]*)|(?P<p>pub\([^)\n]*\))|(?P<w>[^\W\d]\w*[?!]?)|(?P<g>=>|->)|(?P<m>[()\[\]{}<>:;=.,])|\s+|(?P<o>.)"""
)
_WORD_KIND = {**dict.fromkeys(_MODIFIERS, "M"), "pub": "M", **dict.fromkeys(_KEYWORDS, "K"), **dict.fromkeys(_NAMERS, "V"), **dict.fromkeys(_CONTROL, "X")}
_LINE_COMMENT = re.compile(r"^\s*(?://|#(?!\s*(?:include|define|ifn?def|if|endif|else|elif|pragma|undef|region|endregion)\b|\[|!\[)|--(?!\w))")
_ANNOTATION = re.compile(r"^\s*(?:@\w[\w.]*(?:\([^\n]*\))?|#!?\[[^\n]*\]|\[\w[^\n]*\]|template\s*<[^\n]*>)\s*$")
_STRING_STMT = re.compile(r"^\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')")


class Token(NamedTuple):
    kind: str
    line: int
    text: str


_WATER = Token("W", 0, "")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _block_end(lines: list[str], at: int, first: str, close: str) -> int:
    """The last line of a comment or string that is open after ``first``.

    One that is never closed ends before the next line that starts a function, unless the text was cut inside it. So does a string with such a line
    further to the left than itself, and a comment in which another begins behind such a line: the mark that closes them is not their own.
    """
    if close in first:
        return at
    function = None
    for j in range(at + 1, len(lines)):
        line = lines[j]
        if function is None and _STARTS.match(line):
            function = j
            if close[0] in "\"'" and _indent(line) < _indent(lines[at]):
                return j - 1
        if function is not None and close == "*/" and line.lstrip().startswith("/*"):
            return function - 1
        if close in line:
            return j
    cut = lines[-1].rstrip().endswith("...")
    return len(lines) - 1 if cut or function is None else function - 1


def tokens(code: str) -> list[Token]:
    """The tokens of a text, read whole."""
    out: list[Token] = []
    lines = code.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, gap, depth = 0, False, 0
    while i < len(lines):
        line = lines[i]
        s = line.strip()
        if not s:
            gap, i = True, i + 1
            continue
        last = out[-1] if out else None
        if s.startswith(("/*", "<!--", "=begin", "{-")):
            close = "*/" if s[0] == "/" else "-->" if s[0] == "<" else "=end" if s[0] == "=" else "-}"
            end = _block_end(lines, i, s[2:] if s[0] in "/{" else s[4:], close)
            block = lines[i : end + 1]
            tail = block[-1].split(close, 1) if end > i or close in s[2:] else [block[-1]]
            out.append(Token("C", i, "\n".join(block[:-1] + [tail[0] + (close if len(tail) > 1 else "")])))
            i = end + 1
            if len(tail) > 1 and tail[1].strip():
                i -= 1
                lines[i] = tail[1]
        elif _LINE_COMMENT.match(line):
            if last and last.kind == "C" and not gap and _LINE_COMMENT.match(last.text.rsplit("\n", 1)[-1]):
                out[-1] = Token("C", last.line, last.text + "\n" + line)
            else:
                out.append(Token("C", i, line))
            i += 1
        elif (m := _STRING_STMT.match(line)) and (len(m.group(1)) == 3 or re.fullmatch(r"[rRuUbB]{0,2}(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')\s*;?", s)):
            mark = m.group(1)
            end = _block_end(lines, i, s[s.index(mark) + 3 :], mark) if len(mark) == 3 else i
            out.append(Token("S", i, "\n".join(lines[i : end + 1])))
            i = end + 1
        elif _ANNOTATION.match(line) and depth == 0:
            out.append(Token("A", i, line))
            i += 1
        else:
            word = _FIRST.match(s)
            kind = _WORD_KIND.get(word.group(), "N") if word else ""
            header = kind in ("M", "K", "V") and _STARTS.match(line) is not None
            starts = header or ("function" in line and _INLINE.search(line) is not None)
            if starts:
                depth = 0
            call = kind == "N" and "(" in s and (s[-1] in "{(," or (i + 1 < len(lines) and lines[i + 1].lstrip().startswith("{"))) and _CALL_LIKE.match(line) is not None
            if depth > 0 or starts or call or s == "{":
                depth = max(0, depth + _fine(line, i, out, header or depth > 0 or call or s == "{"))
            else:
                _water(out)
            i += 1
        gap = False
    return out


def _water(out: list[Token]) -> None:
    if not (out and out[-1].kind == "W"):
        out.append(_WATER)


def _fine(line: str, at: int, out: list[Token], header: bool) -> int:
    """Puts the words and marks of a line to the tokens; the number of round brackets it leaves open.

    What follows the opening mark of a body is water up to the next function on the line, and so is what stands before the first where the line does not begin with a ``header``.
    """
    start, depth = 0, 0
    while True:
        if start or not header:
            after = _INLINE.search(line, start)
            if (after.start() if after else len(line.rstrip())) > start:
                _water(out)
            if after is None:
                return 0
            start = after.end()
        out.append(Token("L", at, line))
        depth, before, body = 0, "L", None
        for m in _TOKEN.finditer(line, start):
            group = m.lastgroup
            if group is None or group == "c":
                continue
            kind = {"s": "s", "p": "M", "g": "g", "o": "o"}.get(group) or (_WORD_KIND.get(m.group(), "N") if group == "w" else m.group())
            if kind in "MKVX" and before in "K.N>]" and kind != "M" or (kind == "M" and before in "K."):
                kind = "N"  # the word stands where a name does
            depth += (kind == "(") - (kind == ")")
            out.append(Token(kind, at, m.group()))
            before = kind
            if kind == "{" and depth <= 0:
                body = m.end()
                break
        if body is None:
            return depth
        start = body


class Function(NamedTuple):
    """A function of a text: its leading comments, header line, name, the string that opens its body, and its first token."""

    lead: str
    header: str
    name: str
    doc: str
    first: int


@lru_cache(maxsize=100_000)
def _part(kinds: str) -> tuple[tuple[str, int], ...]:
    got = _PARSER.parse(kinds)
    return got[1] if got else ()


def structure(kinds: str) -> Iterator[tuple[str, int]]:
    """The marks (lead, head, name, doc, comment) and their tokens in the cheapest derivation of a token sequence."""
    at = 0
    for part in kinds.split("W"):
        if part:
            for mark, k in _part(part):
                yield mark, at + k
        at += len(part) + 1


def _parsed(code: str | None) -> tuple[str, list[Function]]:
    """The comment at the very start of a text, and its functions."""
    if not code:
        return "", []
    found = tokens(code)
    start, n, lead, out = [], 0, [], []
    head, names, doc = None, [], None

    def done() -> None:
        if head is not None:
            name = found[names[-1]].text if names else ""
            out.append(Function("\n".join(found[k].text for k in lead), found[head].text, name, found[doc].text if doc is not None else "", (lead or [head])[0]))

    for mark, at in structure("".join(t.kind for t in found)):
        if mark in ("lead", "comment") and at == n and len(found) > 1:
            start.append(found[at].text)
            n += 1
        if mark == "comment":
            continue
        if mark == "name":
            names.append(at)
        elif mark == "doc":
            doc = at
        else:
            if head is not None:  # the marks of the next function begin
                done()
                lead, head, names, doc = [], None, [], None
            if mark == "lead":
                lead.append(at)
            else:
                head = at
    done()
    return "\n".join(start), out


def functions(code: str | None) -> list[Function]:
    """The functions of a text in order; broken parts are skipped. Null and empty texts have none."""
    return _parsed(code)[1]


def node_docs(code: str | None) -> list[str]:
    """The documentation inside the code of one function: the comment at its very start and the string that opens the body of its first function, both as the parser derives them."""
    start, found = _parsed(code)
    return [x for x in (start, found[0].doc if found else "") if x]


# --- what counts as a description -------------------------------------------------

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|/{2,}!?|#+!?|--+|<!--|-->|\{-|-\}|=begin|=end|[rRuUbB]{0,2}(?:\"\"\"|'''|\"|'))\s?")
_TAIL = re.compile(r"\s*(?:\*+/|-->|-\}|\"\"\"|'''|\"|')\s*;?$")
_TAG = re.compile(r"^\s*(?:[@\\](\w+)|:(\w+)[^:]*:|(args|arguments|parameters?|params?|returns?|raises|throws|yields|examples?|usage|attributes|see also|since|version|author|deprecated)\s*:\s*$)", re.I)
_TEXT_TAGS = {"brief", "summary", "description", "desc", "details", "remarks", "note", "abstract", "func", "function", "name", "fn", "method"}
_FLAG_TAGS = {"internal", "deprecated", "override", "private", "public", "protected", "static", "async", "api", "final", "abstract", "ts", "ignore", "hidden", "experimental", "beta", "alpha", "readonly", "virtual", "generator", "inheritdoc", "test"}
#: Directives to tools.
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint|tslint|jshint|jslint|prettier|nolint|noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|black|isort|fmt:|yapf|rubocop|clang-(?:format|tidy)|ts-(?:ignore|nocheck|expect)|"
    r"noinspection|nosonar|sonar|istanbul|c8 ignore|v8 ignore|coverage|pragma|suppress|checkstyle|spotless|golangci|go:|rustfmt|swiftlint|ktlint|phpcs|phpstan|psalm|codespell|cspell|@?ts-|region\b|endregion\b|vim:|-\*-|formatter:|biome|stylelint|nosec|nosemgrep|lint:|line \d+ \")"
)
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|wip|tba|to-?do|bug|optimi[sz]e me|por hacer|à faire|zu erledigen)\b")
_LICENCE = re.compile(
    r"(?i)copyright|\(c\)\s*\d{4}|©|licen[sc]ed? (?:under|by|at|file|terms)|all rights reserved|spdx|\bsee licen[sc]e\b|permission is hereby|without warrant|apache license|mit license|\bgpl\b|redistribut|derechos reservados|alle rechte vorbehalten|tous droits"
)
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:please\s+)?(?:add|insert|enter|write|put|provide|fill in|describe|document|give|type|place)\b[^.]*\b(?:description|documentation|doc(?:s|string)?|comment|summary|details?|this|here|what this does|function|method)\b[^.]{0,25}"
    r"|[^.]*\b(?:description|documentation|docs?|comment|summary|text|docstring)s?\s+(?:goes|go|comes|belongs|to follow|to be|will follow|will be added|pending|missing|needed|here)\b.*"
    r"|(?:auto-?generated|generated)\s+(?:method|function|constructor|catch|stub|code|comment|documentation|javadoc)\b.*|(?:no|missing|short|brief|some|method|function)\s+(?:description|documentation|docs?|comment)s?(?:\s+(?:available|provided|yet|given|of|for|here|goes)\b.*)?"
    r"|description of (?:the |this )?(?:method|function|class|module|parameter|return value)s?|to be (?:documented|written|described|done|defined|completed|added|filled)\b.*|lorem ipsum.*|\[[^\]]*\]|<[^>]*>|n/?a|none|\?+|ditto|same as (?:above|before|below)\b.*|see (?:above|below)\b.*"
    r"|(?:missing|undocumented|not documented|documentation pending)\b.*|(?:this is )?(?:a |an |the )?(?:helper|utility|internal|default|getter|setter|constructor|destructor|accessor|main|wrapper)(?: (?:function|method|use only|class|code|routine))?)\W*$"
)
_REFERENCE = re.compile(r"(?i)^\W*(?:\{?@?inherit-?doc\}?|@?see\s+[\w.#{}@:/()<>\"=-]+|\{@link[^}]*\}|overrides?\s+[\w.#]+|(?:@override|overridden)|inherited from [\w.#]+|refer to [\w.#]+|<inheritdoc[^>]*>|:\w+:`[^`]*`)\W*$")
_CODE = re.compile(
    r"[{};]\s*$|\]\s*=\s\S|\bdo\s*\|[^|]*\||^\s*[\w.\[\]'\"]+\s*(?:[+\-*/|&^]?=|:=|\|\|=|\?\?=|<-)\s*\S|^\s*(?:return|throw|raise|if|for|while|switch|case|else|elif|try|except|catch|with|match|let|const|var|int|long|def|fn|func|function|import|from|use|using|defer|go|await|yield|del|assert|print|logger|log|LOG|tracing|bail!)\b[^.]*[({=:\[]|^\s*[\w.]+\([^)]*\)\s*[;{:]?\s*$|=>|->\s|&&|\|\||==|!=|^\s*[}\])]|^\s*#include|\w+\.\w+\([^)]*\)|^\s*(?:end|begin|do|else|try)\s*$"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_BLANKLESS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_FILLER = frozenset(
    "a an the this that function method procedure routine class to for of in on and or is it its by with from as does do which will gets get sets set value values given function's object el la der die das le une un de".split()
)


def plain_lines(doc: str) -> list[str]:
    """The lines of a documentation without comment marks, markup and parameter tags; blank lines stay as empty strings."""
    out, tagged = [], False
    doc = re.sub(r"(?is)<(param|typeparam|returns|exception|example|code|c|see|seealso|paramref|value)\b[^>]*(?:/>|>.*?</\1>)", " ", doc)
    doc = re.sub(r"(?i)</?(?:summary|remarks|para|p|br|b|i|em|strong|ul|li|ol|pre|tt)\b[^>]*>", " ", doc)
    for raw in doc.replace("\r", "").split("\n"):
        line, marks = raw, 0
        for _ in range(3):
            cut = _MARKS.sub("", line, count=1)
            if cut == line:
                break
            line, marks = cut, marks + 1
            if re.match(r"\s*(?://|#|--)\s", line) and not re.match(r"\s*/\*", raw):
                break
        indent = len(line) - len(line.lstrip())
        line = _TAIL.sub("", line).strip()
        if not line or re.fullmatch(r"[\W_]+", line):
            out.append("")
            continue
        if marks and re.match(r"(?://|#|--)\s", line):  # a comment inside commented-out code
            out.append("")
            continue
        if m := _TAG.match(line):
            tag = (m.group(1) or m.group(2) or m.group(3)).lower()
            tagged = tag not in _TEXT_TAGS and tag not in _FLAG_TAGS
            out.append(line[m.end() :].strip() if tag in _TEXT_TAGS else "")
            continue
        if tagged and indent >= 2:
            continue
        tagged = False
        out.append(line)
    return out


def _split(lines: list[str]) -> list[str]:
    """The sentences of plain lines; a blank line ends one."""
    out = []
    for block in re.split(r"\n\s*\n", "\n".join(lines)):
        out += [x.strip() for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])", " ".join(block.split()))]
    return [x for x in out if x]


def all_sentences(doc: str | None) -> list[str]:
    """Every sentence of a documentation, whatever it says: what templates are counted over."""
    return _split(plain_lines(doc)) if doc and doc.strip() else []


def sentences(doc: str | None) -> list[str]:
    """The sentences of a documentation that can describe: no code, to-do notes, licence lines, directives, placeholders or references."""
    if not doc or not doc.strip():
        return []
    kept: list[str] = []
    lines = plain_lines(doc)
    code = [bool(x) and _CODE.search(x) is not None for x in lines]
    if sum(code) * 3 >= sum(map(bool, lines)):  # code put into comments: what stands between it is no sentence unless it ends like one
        lines = [x if re.search(r"[.!?。！？]\W*$", x) else "" for x in lines]
    lines = ["" if x and (c or _DIRECTIVE.match(x)) else x for x, c in zip(lines, code)]
    for s in _split(lines):
        s = re.sub(r"(?i)^\W*(?:note|nb|important|warning|info|hint|remark)\s*[:：]\s*", "", s)
        if s and not (_TODO.match(s) or _LICENCE.search(s) or _DIRECTIVE.match(s) or _PLACEHOLDER.match(s) or _REFERENCE.match(s)):
            kept.append(s)
    return kept


def _parts(name: str | None) -> set[str]:
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+", " ", name or "")
    return {w.lower() for w in split.split()} | {re.sub(r"\W", "", name or "").lower()}


def describes(sentence: str, name: str | None) -> int:
    """Length of a sentence in words if it says something about the function, else 0: five words, or ten characters in scripts without blanks, that are more than the name again."""
    blankless = len(_BLANKLESS.findall(sentence))
    if blankless >= 10:
        return max(5, blankless // 2)
    words = [w.lower() for w in _WORD.findall(sentence)]
    if len(words) < 5 or sum(map(len, words)) < 0.55 * len(sentence.replace(" ", "")):
        return 0
    own = _parts(name)
    stems = {w[:-1] for w in own if len(w) > 3} | own
    news = [w for w in words if w not in _FILLER and w not in own and w.rstrip("s") not in stems and w[:-2] not in stems and w[:-3] not in stems]
    return len(words) if len(news) >= 2 else 0


def _key(sentence: str) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(w.lower() for w in re.findall(r"\w+", sentence)).encode(), digest_size=8).digest(), "little", signed=True)


def _read(nodes: DataFrame) -> DataFrame:
    """A row for each function with documentation: its description, the hashes of all its sentences and of those that describe."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, code, doc in zip(b["id"], b["name"], b["code_content"], b["doc_comment"]):
                docs = [t for t in (doc, *node_docs(code)) if t and t.strip()]
                every = dict.fromkeys(s for t in docs for s in all_sentences(t))
                if every:
                    found = list(dict.fromkeys(s for t in docs for s in sentences(t)))
                    good = [_key(s) for s in found if describes(s, name)]
                    rows.append((i, " ".join(found), [_key(s) for s in {**every, **dict.fromkeys(found)}], good))
            yield pd.DataFrame(rows, columns=["node_id", "description", "all_keys", "keys"]).astype({"node_id": "int64"})

    texts = nodes.where(F.col("type").isin("function", "method") & F.col("id").isNotNull()).select("id", "name", "code_content", "doc_comment")
    return texts.mapInPandas(read, "node_id long, description string, all_keys array<long>, keys array<long>")


def descriptions(nodes: DataFrame, template_share: float = 0.01, template_least: int = 5) -> DataFrame:
    """(node_id, description) of the functions and methods with a description, one row an id.

    Every sentence is counted, in all documented functions. It is a template where at least ``template_least`` of them have it and the
    lower bound of its share (Wilson, two standard errors) is ``template_share`` or more, so that a small collection drops none by chance.
    Null, empty and blank code or comments give nothing; names may be null; extra columns are ignored. Of several rows of one id the one
    with the first description in order counts.
    """
    got = Scratch(nodes.sparkSession).save(_read(nodes))
    each = got.select("node_id", F.explode("all_keys").alias("key")).groupBy("key").agg(F.count_distinct("node_id").alias("n"))
    total = F.lit(float(max(1, got.select("node_id").distinct().count())))
    z, share = 2.0, F.col("n") / total
    low = (share + z * z / (2 * total) - z * F.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)
    templates = each.where((F.col("n") >= template_least) & (low >= template_share)).select(F.col("key").alias("_t"))
    good = got.where(F.size("keys") > 0).select("node_id", "description", "keys")
    hit = good.select("node_id", F.explode("keys").alias("key")).join(templates, F.col("key") == F.col("_t"), "left_anti")
    kept = hit.select(F.col("node_id").alias("_id")).distinct()
    out = good.select("node_id", "description").join(kept, F.col("node_id") == F.col("_id"), "left_semi")
    return out.groupBy("node_id").agg(F.min("description").alias("description"))


def documented(nodes: DataFrame, **parameters) -> DataFrame:
    """(node_id, name, signature, code, description): functions and methods paired with their plain description; of several rows of one id the least counts."""
    rows = nodes.where(F.col("type").isin("function", "method")).select(F.col("id").alias("_n"), F.struct("name", "signature", F.col("code_content").alias("code")).alias("_v"))
    one = rows.groupBy("_n").agg(F.min("_v").alias("_v"))
    return descriptions(nodes, **parameters).join(one, F.col("node_id") == F.col("_n")).select("node_id", "_v.*", "description")
