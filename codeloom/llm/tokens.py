"""Public tokenizer vocabularies, loaded once per Python worker.

The folder of the vocabulary files is a parameter (``CODELOOM_TOKENIZERS`` or the
argument); no vocabulary is part of this repository and none is trained. The driver
ships the file with the job, so workers need no such folder of their own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the splitting pattern that belongs to the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts are encoded in pieces of about so many characters, cut where the pattern cuts anyway.
PIECE = 200_000

_loaded: dict[str, object] = {}


def ship(spark: SparkSession | None, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> None:
    """Sends the vocabulary file to all workers, once a session; a file that the driver does not have must be in the folder on every worker."""
    path = os.path.join(folder, name)
    if spark is not None and os.path.exists(path) and not any(f.rsplit("/", 1)[-1] == name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)


def encoder(folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
    key = f"{folder}/{name}"
    if key not in _loaded:
        import tiktoken

        with open(key if os.path.exists(key) else SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[key] = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def count_tokens(text: str | None, enc) -> int:
    """Tokens of the whole text; null and empty texts have 0. Very long runs without a blank are encoded in pieces."""
    if not text:
        return 0
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    n = at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            while cut > at + 1 and text[cut - 1].isspace():
                cut -= 1
            end = cut if cut > at else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_count(text: Column, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Column:
    """Arrow-batched token counts of a text column."""
    ship(SparkSession.getActiveSession(), folder, name)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(folder, name)
        for s in batches:
            yield pd.Series([count_tokens(t, enc) for t in s], index=s.index, dtype="int64")

    return count(text)
