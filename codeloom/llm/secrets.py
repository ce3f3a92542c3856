"""Credentials embedded in source code: find and redact them in place.

Candidates stand where the context names a credential (a key such as ``db_password``,
an authorization header, the user part of a URL, a connection string, a login call, a
private key block) or where their form does (issuer prefixes). How natural a candidate
reads is measured as characters per subword of a public tokenizer: words and
identifiers reach 3 and more, random strings stay near 2. The context sets how natural a
value may be: below a name that only hints (``key``, ``token``, ``auth``) it must be unnatural, more so where it is
made of letters alone; below a name of something that is issued (``api_key``, ``access_token``) it must not read like
words; only passwords, which people choose, may. Redaction replaces the value's characters
one by one with a letter that no quoting, settings format or shell gives a meaning, so every offset and line stays where it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import TOKENIZER_DIR, VOCABULARY, encoder, ship

#: A string with at most so many characters per subword reads as unnatural, and with more than so many like words. Strings of letters and joining
#: marks alone, as identifiers are, have bounds of their own.
UNNATURAL, UNNATURAL_LETTERS, WORDS, WORDS_LETTERS = 2.4, 1.9, 3.4, 2.2

_CHOSEN = r"pass(?:word|wd|phrase|code|wort)?|pwd|pw|kennwort|contrase(?:n|ñ)a|senha|mot_?de_?passe|wachtwoord|has[lł]o|parola"
_STRONG = (
    rf"{_CHOSEN}|secret|api_?key|app_?key|credentials?|"
    r"(?:secret|access|signing|encryption|private|auth|service|master|license|storage|account|session|client|hmac|jwt|deploy)_?key|"
    r"(?:access|auth|session|service|bot|refresh|bearer|deploy|personal|client|push|login|oauth|vault|webhook|csrf|jwt)_?token"
)
_WEAK = r"token|key|auth|authorization|webhook|cookie|sid|signature|cred"
#: A quote after a separator; what stands before it on the line names the value.
_QUOTED = re.compile(r"[=:>(,][ \t]*(?:[$@rbuf]|new String\()?([\"'`])")
_LINE = re.compile(r"(?m)^[ \t]*(?:#[ \t]*|//[ \t]*|export[ \t]+|-[ \t]+|set[ \t]+|ENV[ \t]+)?([\w.\-ñł]+)(?::[ \t]+|=)(?![=\"'`])([^\s\"'`]+)[ \t\r]*$")
_XML = re.compile(r"""(?i)<\w+\s+(?:key|name|id)\s*=\s*(["'])([^"'\n]*)\1\s+value\s*=\s*(["'])""")
_TAG = re.compile(rf"(?i)<((?:\w+[_.-])?(?:{_STRONG}))>([^<\n]+)</")
_URL = re.compile(r"(?i)://([^\s:/@\"'`<>]*):([^\s/\"'`]+?)@(?=[\w\[{$.-])")
_HEADER = re.compile(r"\b([Bb]earer|BEARER|[Tt]oken|TOKEN|[Bb]asic|BASIC|[Aa]pi[Kk]ey)[ \t]+([A-Za-z0-9._~+/\-]{6,}=*)")
_CURL = re.compile(r"""(?:\bcurl\b[^\n]*?\s(?:-u|--user)[ =]|\bwget\b[^\n]*?--(?:http-)?user=)\s*["']?([^\s:"'`]+):([^\s"'`]+)""")
_FLAG = re.compile(r"""(?:(?:--(?:password|passwd|pass|token|secret|api-?key)[= ])|\bsshpass\s+-p\s*|\bmysql\b[^\n]*?\s-p)["']?([^\s"'`]+)""")
_CONN = re.compile(r"(?i)(?:^|[;\"'`\s])(?:password|pwd|sharedaccesskey|accountkey|user password)[ ]?=[ ]?([^;\"'`\n]+)(?=;|[\"'`])")
_LOGIN = re.compile(r"""(?i)\.?\w*(?:connect|login|sign_?in|auth\w*|log_?on|open)\s*\(([^()\n]*)\)[^\n]*?(?://|#|/\*|--)[^\n]*\b(?:pass\w*|pwd|kennwort|contrase\w*)\b""")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Prefixes under which issuers hand out tokens.
_ISSUED = re.compile(
    r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w\-]{16,}|xox[abeoprs]-[\w\-]{16,}|A[KS]IA[A-Z0-9]{12,}|"
    r"AIza[\w\-]{25,}|ya29\.[\w\-]{20,}|npm_[A-Za-z0-9]{20,}|pypi-[\w\-]{20,}|SG\.[\w\-]{10,}\.[\w\-]{10,}|hf_[A-Za-z0-9]{20,}|dop_v1_\w{20,}|"
    r"(?:sk|pk|rk|whsec)[_-](?:live|test|prod)?[_-]?[A-Za-z0-9]{16,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}|eyJ[A-Za-z0-9+/=]{8,}\.[A-Za-z0-9+/=_\-]{8,}\.[\w\-]{8,}|"
    r"[a-z]{2,8}[_-](?:pat|live|prod|test|key|tok|token|sk|secret)[_-][A-Za-z0-9]{16,})(?![A-Za-z0-9])"
)
_LITERAL = re.compile(r"""(["'`])((?:(?!\1)[^\\\n]|\\.)*)\1""")
_RUN = re.compile(r"[A-Za-z0-9_\-]{18,}")
_JOIN = re.compile(r"""[ \t]*[+.][ \t]*(["'`])((?:(?!\1)[^\\\n]|\\.)*)\1""")
#: Words that stand where a value should be put.
_PLACEHOLDER_WORDS = set(
    "password passwd pwd pass secret token key apikey api_key api-key changeme change-me change_me change-it changeit replace_me replaceme replace-me todo fixme tbd none null nil undefined "
    "placeholder example sample dummy redacted masked hidden removed empty unset n/a na your-token your_token your-key yourpassword user username true false test xxx foo bar bearer basic digest "
    "insert-key-here insert_key_here put-key-here set-me set_me fill-me-in string text str value my-secret mysecret my_secret".split()
)
_PLACEHOLDER = re.compile(
    r"(?is)^(?:[*x#.•_\-?]{3,}|\[?<[^>]*>\]?|\{\{.*\}\}|\[[^\]]*\]|\$\{.*\}|\$\(.*\)|#\{.*\}|\{[\w.:\- ]*\}|\$+[A-Za-z_]\w*|%\w*%?[sdv]?|%\(\w+\)s|@\w+@|__\w+__|:\w+|\?)$"
    r"|^(?:env|vault|secret|secrets|ssm|sm|arn|file|keyring|keychain|op|kms|gcp|aws|azure|config|settings|process\.env|os\.environ|getenv|System\.getenv|ENV)\s*[:(\[./]"
    r"|^(?:your|my|the|insert|replace|change|enter|put|add|set|fill|some|example|sample|dummy|fake|todo|placeholder)(?:[-_ ]+[a-z]+)*[-_ ]*(?:here|me|it|this|in|password|secret|token|key|value)?$"
    r"|^(?:x{3,}|\*{2,}|\.{3,})|(?:x{6,}|\*{4,}|\.{3,})$"
)
_PATH = re.compile(r"^(?:[a-z][\w\-]*/)+[\w\-]+$|^/[\w\-./]+$|^[a-z]+\[[^\]]*\]$")
_DIGEST = re.compile(r"^(?:sha\d*-|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$|[0-9a-f]{8}-[0-9a-f]{4}-|data:)", re.I)


def placeholder(value: str) -> bool:
    """Whether a value is empty, a mask, a reference or a word that stands for a value."""
    v = value.strip()
    return not v or v.lower() in _PLACEHOLDER_WORDS or bool(_PLACEHOLDER.search(v))


def chars_per_subword(value: str, enc) -> float:
    return len(value) / max(1, len(enc.encode_ordinary(value)))


def _usable(v: str, context: int, enc) -> bool:
    """Whether a value is a credential in a context: 1 hinting, 2 something issued, 3 something people choose."""
    if placeholder(v) or len(v) < 3 or _PATH.match(v):
        return False
    if re.match(r"(?i)[a-z][a-z0-9+.\-]*://|data:", v):
        return False
    measure = chars_per_subword(v, enc)
    if re.search(r"\s", v):  # a sentence or label; a password with a blank still mixes classes
        return context > 1 and len(v) < 40 and bool(re.search(r"\d", v)) and bool(re.search(r"[^\w\s.,]", v)) and measure < UNNATURAL
    if context == 3:
        return True
    letters = re.fullmatch(r"[^\W\d]+(?:[-.:][^\W\d]+)*", v) is not None
    if context == 2:
        return measure <= (WORDS_LETTERS if letters else WORDS)
    return len(v) >= 8 and not _DIGEST.match(v) and measure <= (UNNATURAL_LETTERS if letters else UNNATURAL)


def _context(key: str) -> int:
    """How surely a name (in snake case) is that of a credential: 3 chosen by people, 2 issued, 1 a hint, 0 none."""
    return 3 if _CHOSEN_KEY.search(key) else 2 if _STRONG_KEY.search(key) else 1 if _WEAK_KEY.search(key) else 0


_KEY_END = re.compile(r"[\w.\-ñł]")
_TYPE = re.compile(r"\s*[A-Za-z&*][\w<>\[\], &*'|?]*\s*")


def _names(code: str, at: int, end: int) -> list[str]:
    """The names in front of a separator that ends at ``end``: ``name =``, ``"name":``, ``name: Type =``; read back to the line's start where needed."""
    cut = end
    for mark in (":=", "=>", "=", ":"):
        if code.endswith(mark, at, end):
            cut = end - len(mark)
            break
    else:
        return []
    out = []
    for stop in (cut, code.rfind(":", at, cut) if code[cut:end] == "=" else -1):
        if stop < at or (stop != cut and not _TYPE.fullmatch(code, stop + 1, cut)):
            continue
        j = stop
        while j > at and code[j - 1] in " \t":
            j -= 1
        for closing in (")", "]", "\"'`"):
            if j > at and code[j - 1] in closing:
                j -= 1
        k = j
        while k > at and _KEY_END.match(code, k - 1):
            k -= 1
        if k < j:
            out.append(_snake(code[k:j]))
    return out


def find_credentials(code: str | None, enc) -> list[tuple[int, int]]:
    """(start, end) of each credential value of a text, in order and without overlap; null and empty texts have none."""
    if not code:
        return []
    found: list[tuple[int, int]] = []
    taken: list[tuple[int, int]] = []
    for m in _BEGIN.finditer(code) if "PRIVATE KEY" in code else ():
        end = _END.search(code, m.end())
        stop = end.start() if end else len(code)
        nxt = _BEGIN.search(code, m.end())
        if nxt and nxt.start() < stop:
            stop = nxt.start()
        body = re.sub(r"\\[nr]|[\s\"'`+,.]", "", code[m.end() : stop])
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 16 and not re.fullmatch(r"(?i)[x.*]+", body):
            found.append((m.start(), end.end() if end and end.start() == stop else stop))
    taken += found

    def add(start: int, end: int) -> None:
        if start < end and not any(a < end and start < b for a, b in taken):
            found.append((start, end))
            taken.append((start, end))

    for m in _URL.finditer(code) if "@" in code and "://" in code else ():
        if not placeholder(m.group(2)) and not re.fullmatch(r"[A-Z_]+", m.group(2)):
            add(*m.span(2))
        else:
            taken.append(m.span())
    for m in _CURL.finditer(code) if "curl" in code or "wget" in code else ():
        if not placeholder(m.group(2)):
            add(*m.span(2))
    for m in _FLAG.finditer(code) if "--" in code or "sshpass" in code or "mysql" in code else ():
        if not placeholder(m.group(1)):
            add(*m.span(1))
    low = code.lower()
    for m in _HEADER.finditer(code) if "uthoriz" in low or "bearer" in low or "basic" in low or "header" in low else ():
        v, kind = m.group(2), m.group(1).lower()
        if placeholder(v):
            continue
        named = re.compile(r"(?i)auth|x-api|header|cookie").search(code, code.rfind("\n", 0, m.start()) + 1, m.start()) is not None
        if kind == "basic":
            try:
                import base64

                raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
            except ValueError:
                raw = ""
            if ":" in raw and not placeholder(raw.split(":", 1)[1]):
                add(*m.span(2))
        elif len(v) >= 12 and chars_per_subword(v, enc) <= UNNATURAL and (named or kind == "bearer"):
            add(*m.span(2))
    for m in _CONN.finditer(code) if "pwd=" in low or "password=" in low or "key=" in low or "pwd =" in low or "password =" in low else ():
        line = code[code.rfind("\n", 0, m.start()) + 1 : m.start(1)]
        if re.search(r"(?i)(server|host|data source|user id|uid|database|accountname|endpoint)\s*=", line) and not placeholder(m.group(1)):
            add(*m.span(1))
    for m in _LOGIN.finditer(code) if _NAMED.search(low) else ():
        args = list(_LITERAL.finditer(code, m.start(1), m.end(1)))
        if len(args) >= 2 and not re.search(r"=|:\s", re.sub(_LITERAL, "", m.group(1))):
            a = args[-1]
            if not placeholder(a.group(2)) and not re.search(r"\s", a.group(2)):
                add(*a.span(2))
    for m in _XML.finditer(code) if "value" in code and "<" in code else ():
        key = m.group(2)
        v = _LITERAL.match(code, m.end() - 1)
        if v and (context := _context(_snake(key))) > 1 and _usable(v.group(2), context, enc):
            add(*v.span(2))
    for m in _TAG.finditer(code) if "</" in code else ():
        if _usable(m.group(2), max(2, _context(_snake(m.group(1)))), enc):
            add(*m.span(2))
    for m in _QUOTED.finditer(code):
        if code[m.start()] in ">(," and code[m.start() - 1 : m.start() + 1] != "=>":
            continue
        line_at = code.rfind("\n", 0, m.start()) + 1
        context = max(map(_context, _names(code, line_at, m.start() + 1)), default=0)
        if not context:
            continue
        v = _LITERAL.match(code, m.end() - 1)
        if not v:
            continue
        value, span = v.group(2), v.span(2)
        more = _JOIN.match(code, v.end())
        while more:
            value, span = value + more.group(2), (span[0], more.end() - 1)
            more = _JOIN.match(code, more.end())
        if span == v.span(2) and re.match(r"[ \t]*\+", code[v.end() : v.end() + 8]):
            continue  # joined with something computed
        if re.match(r"(?i)(bearer|token|basic)\s", value):
            continue  # a header: taken above where its value is usable
        if _usable(value, context, enc):
            add(*span)
    for m in _LINE.finditer(code):
        value, key = m.group(2).rstrip(",;"), _snake(m.group(1))
        context = _context(key)
        if context and _usable(value, context, enc) and not re.match(r"[A-Za-z_][\w.]*[(\[]|[a-z_]\w*(?:\.\w+)+$", value):
            add(m.start(2), m.start(2) + len(value))
    for run in _RUN.finditer(code):
        m = _ISSUED.match(code, run.start())
        if m and chars_per_subword(m.group(), enc) <= UNNATURAL + 0.4:
            add(*m.span())
    return sorted(found)


_CHOSEN_KEY = re.compile(rf"(?:^|[_.\-])(?:{_CHOSEN})\d*$")
_STRONG_KEY = re.compile(rf"(?:^|[_.\-])(?:{_STRONG})\d*$")
_WEAK_KEY = re.compile(rf"(?:^|[_.\-])(?:{_WEAK})\d*$")
_NAMED = re.compile(r"(?://|#|/\*|--)[^\n]*(?:pass|pwd|kennwort|contrase)")


def _snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()


_KEY_TEXT = re.compile(r"\\.|(?<![\w+/=\-])[rbufRBUF]{1,2}(?=[\"'`])|[\w+/=\-]*[\w=][\w+/=\-]*")


def redact(code: str | None, spans: list[tuple[int, int]], mark: str = "x") -> str | None:
    """The text with the characters of the values replaced one by one.

    The mark is a letter: it is plain text between quotes, in a URL, in a shell and as a bare value of a settings file, where other marks mean
    something. A value over several lines (a key block) keeps its line ends, indentation, quotes, escapes, joining and comment marks.
    """
    if not code or not spans:
        return code
    out, at = [], 0
    for a, b in spans:
        value = code[a:b]
        if "\n" in value or "\r" in value:
            value = _KEY_TEXT.sub(lambda m: m.group() if m.group()[0] == "\\" or code[a + m.end() : a + m.end() + 1] in ("'", '"', "`") and len(m.group()) < 3 and m.start() > 0 and m.group().isalpha() else mark * len(m.group()), value)
        else:
            value = mark * len(value)
        out += [code[at:a], value]
        at = b
    return "".join(out) + code[at:]


def credentials(nodes: DataFrame, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(node_id, line_no, start, length): every credential value by its line (from 1) and character offset.

    Reads the whole texts of nodes of every type. Null, empty and blank code gives no rows; an id that comes
    several times with the same code gives its rows once. Extra columns are ignored.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            rows = []
            for i, code in zip(b["id"], b["code_content"]):
                for a, z in find_credentials(code, enc):
                    rows.append((i, code.count("\n", 0, a) + 1, a, z - a))
            yield pd.DataFrame(rows, columns=["node_id", "line_no", "start", "length"]).astype("int64")

    ship(nodes.sparkSession, folder, vocabulary)
    texts = nodes.where(F.col("id").isNotNull() & (F.length("code_content") > 0)).select("id", "code_content")
    return texts.mapInPandas(scan, "node_id long, line_no long, start long, length long").distinct()


def redacted(nodes: DataFrame, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(node_id, n_values, code_content) of the nodes with credentials, the values replaced by marks of the same length; of several texts of one id the least counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            rows = []
            for i, code in zip(b["id"], b["code_content"]):
                if spans := find_credentials(code, enc):
                    rows.append((i, len(spans), redact(code, spans)))
            yield pd.DataFrame(rows, columns=["node_id", "n_values", "code_content"]).astype({"node_id": "int64", "n_values": "int64"})

    ship(nodes.sparkSession, folder, vocabulary)
    texts = nodes.where(F.col("id").isNotNull() & (F.length("code_content") > 0)).select("id", "code_content")
    found = texts.mapInPandas(scan, "node_id long, n_values long, code_content string")
    return found.groupBy("node_id").agg(F.min(F.struct("n_values", "code_content")).alias("_v")).select("node_id", "_v.*")
