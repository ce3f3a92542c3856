"""Identifiers and search terms: splitting, acronyms, stop words, stemming."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
STOP_WORDS = "a an and the or in of for to with is it this that by from on at as be are was were been all each how what when".split()
ACRONYMS = {
    "rrf": ["reciprocal", "rank", "fusion"], "bm25": ["best", "match"], "fts": ["full", "text", "search"], "fts5": ["full", "text", "search"],
    "ast": ["abstract", "syntax", "tree"], "cst": ["concrete", "syntax", "tree"], "lsp": ["language", "server", "protocol"],
    "mcp": ["model", "context", "protocol"], "rpc": ["remote", "procedure", "call"], "sql": ["structured", "query", "language"],
    "orm": ["object", "relational", "mapping"], "cte": ["common", "table", "expression"], "jwt": ["json", "web", "token"], "ttl": ["time", "live"],
    "dag": ["directed", "acyclic", "graph"], "rbac": ["role", "based", "access", "control"], "crud": ["create", "read", "update", "delete"],
    "cors": ["cross", "origin", "resource", "sharing"],
}


def split_column(name: Column) -> Column:
    """The words of an identifier in one string, followed by the identifier itself where it has several."""
    spaced = F.regexp_replace(name, "_+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    spaced = F.trim(F.regexp_replace(spaced, r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " "))
    return F.when(spaced.contains(" "), F.concat(spaced, F.lit(" "), name)).otherwise(F.when(spaced == "", name).otherwise(spaced))


def split_words(name: str) -> list[str]:
    """The words of an identifier, on the driver."""
    out, word = [], ""
    chars = name
    for i, c in enumerate(chars):
        before = chars[i - 1] if i else ""
        after = chars[i + 1] if i + 1 < len(chars) else ""
        edge = (c.isupper() and before.islower()) or (c.isupper() and before.isupper() and after.islower())
        if c == "_" or edge:
            if word:
                out.append(word)
            word = "" if c == "_" else c
        else:
            word += c
    return out + [word] if word else out


def split_identifier(name: str) -> str:
    words = split_words(name)
    return " ".join([*words, name]) if len(words) > 1 else (words[0] if words else name)


def query_terms(query: str) -> list[str]:
    """Search terms of a query, sorted: stop words dropped, identifiers split, acronyms expanded, terms of one byte dropped."""
    out = set()
    for word in query.split():
        if word.lower() in STOP_WORDS:
            continue
        for part in split_identifier(word).split():
            out |= {part, *ACRONYMS.get(part.lower(), [])}
    cleaned = ("".join(c for c in w if c.isalnum() or c == "_") for w in sorted(out))
    return [w for w in cleaned if len(w.encode()) >= 2]


#: Letters with marks by their plain letter.
MARKED = {"a": "áàâäãåā", "c": "çćč", "e": "éèêëēėę", "i": "íìîïī", "n": "ñń", "o": "óòôöõøō", "s": "śš", "u": "úùûüū", "y": "ýÿ", "z": "žźż"}


def fold(text: Column) -> Column:
    """Lower case without combining marks, as the text index compares."""
    return F.translate(F.lower(text), "".join(m for ms in MARKED.values() for m in ms), "".join(c * len(ms) for c, ms in MARKED.items()))


_VOWEL = "aeiou"


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in _VOWEL or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The Porter stem of a lower-case ASCII word; other words stay as they are."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for old, new in sorted(zip(_STEP2[::2], _STEP2[1::2]), key=lambda x: -len(x[0])):
        if w.endswith(old):
            if _measure(w[: -len(old)]) > 0:
                w = w[: -len(old)] + new
            break
    for old in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(old):
            if _measure(w[: -len(old)]) > 0:
                w = w[: -len(old)] + _STEP3[old]
            break
    for old in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(old):
            stem = w[: -len(old)]
            if _measure(stem) > 1 and (old != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
