"""Keyword-stuffed and link-list pages by a hidden Markov model over lines.

The lines of a page (long ones cut into pieces of some 40 words) are labelled prose,
link list, tag list, menu or technical (code, tables, logs) by the most likely path of
a hidden Markov model; a page is flagged where the words of its link list, tag list
and menu lines are clearly more than half of all. A line is observed as six
categories: share of function words, share of link text, separators per word, whether
it closes like a sentence, share of words the page repeats, technical marks. The
emission and transition tables start from the priors below and are fitted by
Viterbi training on all pages: texts are read once, and each round labels their
observations again and sums whole counts. The priors keep their share at any number
of pages, or rare cells of the tables would go to zero with it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.storage import Scratch

STATES = ("prose", "link list", "tag list", "menu", "technical")
FLAGGED = np.array([False, True, True, True, False])
SIZES = (4, 3, 3, 2, 3, 2)
#: Observations a line may have.
KINDS = math.prod(SIZES)
#: Numbers that a model is fitted from: lines, moves, pages.
CELLS = len(STATES) * (KINDS + len(STATES)) + 1

#: Prior emission tables: for each feature a row per state.
_PRIOR = [
    [[0.04, 0.12, 0.30, 0.54], [0.78, 0.14, 0.06, 0.02], [0.88, 0.10, 0.015, 0.005], [0.84, 0.13, 0.02, 0.01], [0.80, 0.14, 0.04, 0.02]],
    [[0.75, 0.20, 0.05], [0.04, 0.26, 0.70], [0.92, 0.06, 0.02], [0.85, 0.10, 0.05], [0.93, 0.05, 0.02]],
    [[0.75, 0.20, 0.05], [0.40, 0.30, 0.30], [0.30, 0.25, 0.45], [0.60, 0.20, 0.20], [0.40, 0.30, 0.30]],
    [[0.25, 0.75], [0.95, 0.05], [0.93, 0.07], [0.97, 0.03], [0.85, 0.15]],
    [[0.70, 0.20, 0.10], [0.30, 0.30, 0.40], [0.10, 0.25, 0.65], [0.30, 0.35, 0.35], [0.45, 0.30, 0.25]],
    [[0.97, 0.03], [0.95, 0.05], [0.97, 0.03], [0.97, 0.03], [0.04, 0.96]],
]
_START = [0.40, 0.15, 0.15, 0.10, 0.20]
_STAY = 0.85

#: Frequent function words of the languages of the collection.
STOP = frozenset(
    """a an and are as at be been but by can could did do does each every for from had has have he her his how i if in into is it its just may more most must no not of on one only or other our out
    over she should so some such than that the their them then there these they this those to two under until up was we were what when where which while who whose why will with would you your after
    before because whatever nothing still now once per about any all both never also
    der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden wurde hat haben ich wir ihr sie er es in im an am auf aus bei mit nach von vor zu zum zur
    für über unter durch ohne als wie wenn weil dass ob noch nur auch schon immer erst bitte jeder jede jedes keine kein man sich so
    el la los las un una unos unas y o pero no es son fue era ser está están hay ha han se lo le les de del al en con por para sin sobre entre que quien cuando donde como si ya más cada antes después
    todo todos todas esta este esto su sus nuestro
    le les une des du au aux et ou mais ne pas est sont était été sera ont avait il elle nous vous ils elles je on en dans sur sous avec sans pour par que qui quand où comme si ce cette ces son sa ses
    depuis chaque tous toutes plus n d l qu
    o os as um uma uns umas e ou mas não é são foi era ser há tem têm se do da dos das ao na no nas nos em com por para sem sobre entre que quem quando onde como já mais cada antes depois todo todos
    esta este isto seu sua pelo pela""".split()
)
_CJK_STOP = frozenset("的是在了不和有这个为与我们都会从到被把对就也而及或如果虽然当时比")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|www\.\S+|\b[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.(?:com|org|net|info|biz|io|dev|co|example|test|invalid|localhost|shop|online|site|xyz|ru|de|fr|es|cn|br|pt)\b(?![(\w])", re.I | re.S)
_SEP = re.compile(r"[,;|•·»«/>#~*]|::|--|—|–")
#: What may follow a sentence end, and the ends themselves.
_AFTER, _ENDS = " \t\"'”’»)]([*_", ".!?。！？…"
_TECHNICAL = re.compile(
    r"^\s*(?:\|.*\|\s*$|```|~~~|\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d|at \S+ ?\(|File \"|Traceback|[-+@]{2,3} |[$>]\s\S|#include|import\s|from\s\S+\s+import|def\s|class\s|func\s|fn\s|return\b|let\s|const\s|var\s|if\s?\(|for\s?\(|while\s|//|/\*|\*/|[{}\])]+;?$)"
    r"|[{}]\s*$|[=()\[\]][^\n]*;\s*$|\w\([^)\n]*\)\s*[;{:]?\s*$|\s(?:=|==|:=|=>|->|\+=|&&|\|\|)\s|^\s*[\w.\-]+\s*=\s*\S+$"
)
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|[=\-_*]{3,}\s*$)")
_RUNS = re.compile(r"\w+")
_STRIP = ".,;:!?\"'()[]{}<>|•·»«/#*`~—–-"


def units(text: str | None, size: int = 40) -> list[tuple[str, bool]]:
    """(piece, inside a code fence) for the non-blank lines of a text, long lines cut after ``size`` words or the sentence end that follows soon."""
    out, fence = [], False
    for line in (text or "").replace("\r", "").split("\n"):
        s = line.strip()
        if not s:
            continue
        if s.startswith(("```", "~~~")):
            out.append((s, True))
            fence = not fence
            continue
        if len(s) <= size * 8:
            out.append((line, fence))
            continue
        words, at = re.split(r"(?<=[。！？])|\s+", line.strip()), 0
        words = [w for w in words if w]
        if len(words) < len(s) / 60:  # hardly any blanks: cut by characters
            out += [(s[i : i + size * 8], fence) for i in range(0, len(s), size * 8)]
            continue
        while at < len(words):
            end = min(at + size, len(words))
            for e in range(end, min(end + 15, len(words))):
                if words[e - 1][-1:] in ".!?。！？":
                    end = e
                    break
            out.append((" ".join(words[at:end]), fence))
            at = end
    return out


def _words(piece: str) -> list[str]:
    # most words have no marks at their ends
    return [w for w in (x if x.isalnum() else x.strip(_STRIP) for x in piece.lower().split()) if w]


def _repeated(own: Counter, linked: Counter, often: float) -> set[str]:
    """The words a page has at least ``often``: function words count inside links only, single characters and numbers never."""
    out = set()
    for w, n in own.items():
        if len(w) > 1 and (0 if w in STOP else n) + linked.get(w, 0) >= often and not w.isdigit():
            out.add(w)
    return out


def observe(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(observations, words) of a text: six categories and the number of words of each piece; empty arrays for null and blank texts."""
    pieces = units(text)
    links = [[m.group() for m in _LINK.finditer(p)] if "." in p or "<" in p or "[" in p else [] for p, _ in pieces]
    rest = [_LINK.sub(" ", p) if ls else p for (p, _), ls in zip(pieces, links)]
    split = [_words(r) for r in rest]
    inside = [[w for x in ls for w in _RUNS.findall(x.lower())] for ls in links]
    total = sum(map(len, split)) + sum(map(len, inside))
    hot = _repeated(Counter(chain.from_iterable(split)), Counter(chain.from_iterable(inside)), max(4, 0.02 * total))
    obs, sizes = [], []
    for (piece, fence), own, ws, ls in zip(pieces, rest, split, inside):
        cjk = _CJK.findall(own) if not own.isascii() else ()
        n = len(ws)
        stop = sum(map(STOP.__contains__, ws)) / n if n else 0.0
        repeated = sum(map(hot.__contains__, ws)) / n if n and hot else 0.0
        if len(cjk) > 0.2 * len(own):
            n = max(n, round(len(cjk) / 1.6))
            stop = max(stop, 2.2 * sum(map(_CJK_STOP.__contains__, cjk)) / len(cjk))
        linked = len(ls) / (n + len(ls)) if ls else 0.0
        n += len(ls)
        seps = len(_SEP.findall(piece)) / max(1, n)
        closed = n >= 4 and (own.rstrip(_AFTER)[-1:] in _ENDS or own.rstrip()[-1:] in ":：") and bool(own.strip(_AFTER))
        technical = fence or (stop < 0.16 and (_TECHNICAL.search(piece) is not None or _HEADING.match(piece) is not None))
        obs.append(
            (
                0 if stop < 0.06 else 1 if stop < 0.16 else 2 if stop < 0.28 else 3,
                0 if linked == 0 else 1 if linked < 0.4 else 2,
                0 if seps < 0.12 else 1 if seps < 0.28 else 2,
                int(closed),
                0 if repeated < 0.15 else 1 if repeated < 0.4 else 2,
                int(technical),
            )
        )
        sizes.append(n)
    return np.array(obs, dtype=np.int64).reshape(-1, len(SIZES)), np.array(sizes, dtype=np.int64)


class LineModel:
    """Emission and transition log tables of the line states."""

    def __init__(self, emission: list[np.ndarray] | None = None, move: np.ndarray | None = None):
        k = len(STATES)
        self.emission = emission or [np.log(np.array(t)) for t in _PRIOR]
        self.move = np.log(np.full((k, k), (1 - _STAY) / (k - 1)) + np.eye(k) * (_STAY - (1 - _STAY) / (k - 1))) if move is None else move
        self.start = np.log(np.array(_START))

    def label(self, obs: np.ndarray) -> np.ndarray:
        """The most likely state of each line."""
        if not len(obs):
            return np.zeros(0, dtype=np.int64)
        score = sum(self.emission[f][:, obs[:, f]] for f in range(len(SIZES))).T
        best, back = self.start + score[0], np.zeros(score.shape, dtype=np.int64)
        for t in range(1, len(score)):
            step = best[:, None] + self.move
            back[t] = step.argmax(0)
            best = step.max(0) + score[t]
        path = np.empty(len(score), dtype=np.int64)
        path[-1] = best.argmax()
        for t in range(len(score) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def label_all(self, pages: list[np.ndarray], cells: int = 4_000_000) -> list[np.ndarray]:
        """``label`` of many pages at once: the recursion runs over all pages of a group together, longest first, so that those still going are a prefix.

        Groups of pages of like length hold at most ``cells`` scores, or one page.
        """
        k = len(STATES)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(pages)
        at = 0
        while at < len(order):
            length = len(pages[order[at]])
            group = order[at : at + max(1, cells // (length * k))]
            at += len(group)
            sizes = np.array([len(pages[i]) for i in group])
            flat = np.concatenate([pages[i] for i in group])
            score = np.zeros((length, len(group), k))
            line, page = np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(len(group)), sizes)
            score[line, page] = sum(self.emission[f][:, flat[:, f]] for f in range(len(SIZES))).T
            best = self.start + score[0]
            back = np.zeros((length, len(group), k), dtype=np.int8)
            going = np.searchsorted(-sizes, -np.arange(length), side="left")  # pages longer than t
            for t in range(1, length):
                a = going[t]
                step = best[:a, :, None] + self.move
                back[t, :a] = step.argmax(1)
                best[:a] = step.max(1) + score[t, :a]
            path = np.zeros((length, len(group)), dtype=np.int64)
            path[sizes - 1, np.arange(len(group))] = best.argmax(1)
            for t in range(length - 1, 0, -1):
                a = np.arange(going[t])
                path[t - 1, a] = back[t, a, path[t, a]]
            for j, i in enumerate(group):
                out[i] = path[: sizes[j], j].copy()
        return out

    def counts(self, pages: list[np.ndarray]) -> np.ndarray:
        """Lines of each state and observation, then moves from each state to each, on the most likely paths of the pages; at last the number of pages with lines."""
        k = len(STATES)
        pages = [p for p in pages if len(p)]
        if not pages:
            return np.zeros(CELLS, dtype=np.int64)
        path, obs = np.concatenate(self.label_all(pages)), np.concatenate(pages)
        lines = np.bincount(path * KINDS + np.ravel_multi_index(tuple(obs.T), SIZES), minlength=k * KINDS)
        inside = np.ones(len(path) - 1, dtype=bool)
        inside[np.cumsum([len(p) for p in pages])[:-1] - 1] = False  # from the last line of a page to the first of the next
        moves = np.bincount((path[:-1] * k + path[1:])[inside], minlength=k * k)
        return np.concatenate([lines, moves, [len(pages)]])

    @classmethod
    def of(cls, counts: np.ndarray, weight: float = 500.0, per: int = 2000) -> "LineModel":
        """The model of such counts, the priors weighing as ``weight`` lines a state for every ``per`` pages, and as much for fewer."""
        prior, k = cls(), len(STATES)
        weight *= max(1.0, counts[-1] / per)
        lines, moves = counts[: k * KINDS].reshape(k, *SIZES), counts[k * KINDS : -1].reshape(k, k)
        emission = [np.exp(e) * weight + lines.sum(axis=tuple(i for i in range(1, lines.ndim) if i != f + 1)) for f, e in enumerate(prior.emission)]
        move = np.exp(prior.move) * weight + moves
        return cls([np.log(c / c.sum(1, keepdims=True)) for c in emission], np.log(move / move.sum(1, keepdims=True)))


def observed(documents: DataFrame) -> DataFrame:
    """(doc_id, obs, sizes) of every page with an id: the categories (8 bits each) and the words (32 bits) of its pieces as bytes."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [observe(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "obs": [o.astype("int8").tobytes() for o, _ in seen], "sizes": [n.astype("int32").tobytes() for _, n in seen]})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(look, "doc_id long, obs binary, sizes binary")


def _pages(obs: pd.Series) -> list[np.ndarray]:
    flat = np.frombuffer(b"".join(obs), dtype=np.int8).reshape(-1, len(SIZES)).astype(np.int64)
    return np.split(flat, np.cumsum([len(o) // len(SIZES) for o in obs], dtype=np.int64)[:-1])


def _fit(seen: DataFrame, rounds: int = 3) -> LineModel:
    model = LineModel()
    for _ in range(rounds):

        def count(batches: Iterator[pd.DataFrame], model: LineModel = model) -> Iterator[pd.DataFrame]:
            n = sum(model.counts(_pages(b["obs"])) for b in batches)
            cells = np.flatnonzero(n)
            if len(cells):
                yield pd.DataFrame({"cell": cells, "n": n[cells]})

        # whole numbers, so their order does not matter; the driver gets a row a cell at most, 2,186 at any size
        got = seen.select("obs").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(CELLS, dtype=np.int64)
        for r in got:
            counts[r["cell"]] = r["n"]
        model = LineModel.of(counts)
    return model


def train(documents: DataFrame) -> LineModel:
    """A model fitted on all pages that have an id: relabel and recount; without pages the priors stay."""
    scratch = Scratch(documents.sparkSession)
    seen = scratch.save(observed(documents))
    model = _fit(seen)
    scratch.drop(seen)
    return model


def page_shares(documents: DataFrame, model: LineModel | None = None) -> DataFrame:
    """(doc_id, words, link_words, tag_words, menu_words, technical_words, spam_share) of every page.

    Null and empty texts have no words and share 0. Whole texts are read; extra columns are ignored.
    """
    seen = observed(documents)
    if model is None:
        seen = Scratch(documents.sparkSession).save(seen)
        model = _fit(seen)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, sizes, path in zip(b["doc_id"], b["sizes"], model.label_all(_pages(b["obs"]))):
                n = np.frombuffer(sizes, dtype=np.int32)
                by = np.bincount(path, weights=n, minlength=len(STATES)).astype(int)
                total = int(n.sum())
                rows.append((i, total, *by[1:5].tolist(), float(by[FLAGGED].sum() / total) if total else 0.0))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "link_words", "tag_words", "menu_words", "technical_words", "spam_share"])

    return seen.mapInPandas(score, "doc_id long, words long, link_words long, tag_words long, menu_words long, technical_words long, spam_share double")


def spam_pages(documents: DataFrame, share: float = 0.55, min_words: int = 15, model: LineModel | None = None) -> DataFrame:
    """``page_shares`` of the pages with at least ``min_words`` words whose list words are more than ``share`` of all."""
    return page_shares(documents, model).where((F.col("words") >= min_words) & (F.col("spam_share") > share))
