"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by source and exact token length. Each source's budget is its
share of the largest total that no source's repeat limit forbids. Whole passes over a
source come first; the remaining budget is met by the same share of every length, and what
is left, about ``window`` tokens, by a bounded-knapsack table over the unused lengths (a
bit set per step), which finds the exact sum where one exists. The table of lengths is handled by one task a source; its size is bounded by the
longest document, not by the number of documents. Which documents of a length
are taken is decided by a seeded hash order, ranked inside salted buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.packing import sizes
from codeloom.llm.tokens import TOKENIZER_DIR, VOCABULARY
from codeloom.operators.ranking import running_sum
from codeloom.storage import Scratch

MOST_SOURCES = 10_000


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, at most its count, so that the sum is the largest possible up to the budget."""
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (n, c) in enumerate(zip(lengths, counts)):
        if n <= 0 or n > budget:
            continue
        part = 1
        c = min(c, budget // n)
        while c > 0:
            k = min(part, c)
            steps.append((i, k, reach))
            reach |= (reach << (n * k)) & mask
            c, part = c - k, part * 2
        if reach >> budget & 1:
            break
    best, out = reach.bit_length() - 1, [0] * len(lengths)
    for i, k, before in reversed(steps):
        if not before >> best & 1:
            out[i] += k
            best -= lengths[i] * k
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int, seed: int = 7) -> np.ndarray:
    """How many documents of each length to take once so that their tokens come as near below the budget as possible.

    All lengths are taken in the same proportion, fractions rounded by a seeded draw, so the choice is not bent to long or short documents.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    draw = np.random.default_rng(seed)
    window = min(window, max(budget // 4, 1))
    take = np.floor(counts * max(0.0, (budget - window / 2) / total) + draw.random(len(lengths))).astype(np.int64)
    take = np.minimum(take, counts)
    left = budget - int((lengths * take).sum())
    order = draw.permutation(len(lengths))
    for i in order:  # too much: give back
        if left >= 0:
            break
        k = min(int(take[i]), -(left // max(int(lengths[i]), 1)))
        take[i] -= k
        left += k * int(lengths[i])
    for i in order:  # too little for the table: add
        if left <= window:
            break
        k = min(int(counts[i] - take[i]), max(left - window // 2, 0) // max(int(lengths[i]), 1))
        take[i] += k
        left -= k * int(lengths[i])
    free = counts - take
    take[order] += np.array(bounded_knapsack([int(x) for x in lengths[order]], [int(x) for x in free[order]], left), dtype=np.int64)
    return take


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 7,
    window: int = 20_000,
    folder: str = TOKENIZER_DIR,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen (source, doc_id, n_tokens, repeats), shares (source, target_share, max_repeats, tokens, documents, share, most_repeats).

    Rows with a null source belong to no source; documents without tokens are never chosen; sources without tokens reach share 0 and do
    not bind the total. Targets with a null source, no positive share or no repeats are reported with share 0. If a source comes twice
    in ``targets`` the row with the larger share counts.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    listed = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"targets has more than {MOST_SOURCES} sources")
    sized = sizes(documents.where("source is not null"), scratch, folder, vocabulary, keep=("source",)).where("n_tokens > 0")
    tokens = {r["source"]: r["t"] for r in sized.where(F.col("source").isin([r["source"] for r in listed])).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in listed if (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0 and tokens.get(r["source"])}
    most = min((int(m) * tokens[s] / w for s, (w, m) in want.items()), default=0)
    total = int(most if total_tokens is None else min(total_tokens, most))
    budgets = {s: min(int(round(w * total)), int(m) * tokens[s]) for s, (w, m) in want.items()}
    rows = [(s, b // tokens[s], b - (b // tokens[s]) * tokens[s]) for s, b in budgets.items()]
    plan = spark.createDataFrame(rows, "source string, passes long, rest long")

    hist = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(plan), "source")

    def choose(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("n_tokens", ignore_index=True)
        take = fit(lengths["n_tokens"].to_numpy(np.int64), lengths["k"].to_numpy(np.int64), int(lengths["rest"].iloc[0]), window, seed)
        return pd.DataFrame({"source": lengths["source"], "n_tokens": lengths["n_tokens"], "passes": lengths["passes"], "take": take})

    taken = scratch.save(hist.groupBy("source").applyInPandas(choose, "source string, n_tokens long, passes long, take long"))
    on = taken.select(F.col("source").alias("_s"), F.col("n_tokens").alias("_n"), "passes", "take")
    ranked = running_sum(sized, ["source", "n_tokens"], F.lit(1), [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")], "_rank", spread=F.xxhash64(F.lit(seed), "doc_id"))
    chosen = ranked.join(on, (F.col("source") == F.col("_s")) & (F.col("n_tokens") == F.col("_n")))
    chosen = chosen.select("source", "doc_id", "n_tokens", (F.col("passes") + (F.col("_rank") < F.col("take")).cast("long")).alias("repeats")).where("repeats > 0")
    used = taken.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n_tokens") * F.col("take")).alias("extra"), F.sum("take").alias("picked"), F.max("passes").alias("passes"))
    base = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], int(tokens.get(r["source"]) or 0)) for r in listed], "source string, target_share double, max_repeats int, held long")
    got = base.join(used, F.col("source") == F.col("_s"), "left").select(
        "source", "target_share", "max_repeats",
        F.coalesce(F.col("extra") + F.col("passes") * F.col("held"), F.lit(0)).alias("tokens"),
        F.coalesce(F.col("passes") + (F.col("picked") > 0).cast("long"), F.lit(0)).alias("most_repeats"),
    )
    sum_ = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row a source
    shares = got.withColumn("share", F.try_divide(F.col("tokens"), sum_))
    return chosen, shares
