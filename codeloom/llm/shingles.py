"""Word shingles and minhash values of texts, vectorised over a batch."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_WORD = re.compile(r"[a-z0-9_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    """The longest runs of ASCII letters, digits and underscores of the lower-case text."""
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so different inputs stay different."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash by word, kept for the words of a worker; emptied when it grows too large."""

    limit = 1_000_000

    def __missing__(self, w: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        self[w] = h
        return h


def shingle_set(tokens: list[str], size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` consecutive words; empty for fewer words."""
    if len(tokens) < size:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((hashes[w] for w in tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _M1 + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


#: Shingles that are hashed at a time: two buffers of so many stay in a core's cache.
CHUNK = 16_384


def minhashes(sets: list[np.ndarray], count: int, seed: int) -> np.ndarray:
    """One row per non-empty set with ``count`` minhash values of 64 bits."""
    salts = mix(np.arange(1, count + 1, dtype=np.uint64) * _M1 + np.uint64(seed))
    out = np.empty((len(sets), count), dtype=np.uint64)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    at = 0
    while at < len(sets):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + CHUNK]), CHUNK, side="right")))
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum(sizes[at:end]) - sizes[at:end]
        x, y = np.empty_like(flat), np.empty_like(flat)
        for i in range(count):
            np.bitwise_xor(flat, salts[i], out=x)
            for shift, factor in ((30, _M2), (27, _M3), (31, None)):  # ``mix`` in place
                np.right_shift(x, np.uint64(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                if factor is not None:
                    np.multiply(x, factor, out=x)
            out[at:end, i] = np.minimum.reduceat(x, starts)
        at = end
    return out


def combine(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of values."""
    out = np.zeros(len(values), dtype=np.uint64)
    for i in range(values.shape[1]):
        out = mix(out * _M1 + values[:, i])
    return out
