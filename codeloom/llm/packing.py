"""Filling fixed-capacity containers: cost-balanced packing.

A document's cost is estimated as linear in its tokens plus quadratic for attention.
Documents larger than a container are cut into full containers and a rest; everything
else is packed by descending size, each item into the sequence of lowest cost that
still has room, starting with as many sequences as the tokens need at least; a new
sequence is opened only where none has room.

Items are spread over groups of about ``group_items`` by a hash of the id, so each group
sees the same mix of sizes and packs on its own: groups never depend on each other
and none grows with the collection. The price is at most one partly filled tail per
group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import TOKENIZER_DIR, VOCABULARY, token_count
from codeloom.operators.dedupe import one_per_key
from codeloom.storage import Scratch

#: Parameter table rows that may be read by the driver.
MOST_SIZES = 1000


def sizes(documents: DataFrame, scratch: Scratch, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, *keep) with one row an id, the least of several, tokenised once and written; null ids are dropped, null texts have 0 tokens."""
    once = one_per_key(documents.select("doc_id", "text", *keep), "doc_id")
    return scratch.save(once.select("doc_id", token_count(F.col("text"), folder, vocabulary).alias("n_tokens"), *keep))


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The sequence of each item; lengths must not exceed the capacity."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    least = max(1, -(-int(lengths.sum()) // capacity))
    room = np.zeros(n + least, dtype=np.int64)
    cost = np.full(n + least, np.inf)
    room[:least], cost[:least] = capacity, 0.0
    used, out = least, np.zeros(n, dtype=np.int64)
    for i in order:
        size = lengths[i]
        open_cost = np.where(room[:used] >= size, cost[:used], np.inf)
        at = int(open_cost.argmin())
        if open_cost[at] == np.inf:
            at, used = used, used + 1
            room[at], cost[at] = capacity, 0.0
        out[i] = at
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    return out


def pack(
    documents: DataFrame,
    pack_sizes: DataFrame,
    folder: str = TOKENIZER_DIR,
    vocabulary: str = VOCABULARY,
    group_items: int = 4000,
    linear: float = 1.0,
    quadratic: float = 1.0 / (6 * 4096),
) -> DataFrame:
    """(pack_name, capacity, pack_id, doc_id, piece_no, start_token, n_tokens): every token of every document in one pack of each size.

    A document has several pieces only where it is larger than the capacity. Documents without tokens (null, empty) are items of size 0.
    Rows of ``pack_sizes`` with a null name or no positive capacity are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    given = pack_sizes.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("long").alias("c")).distinct()
    listed = given.orderBy("pack_name", "c").limit(MOST_SIZES + 1).collect()
    if len(listed) > MOST_SIZES:
        raise ValueError(f"pack_sizes has more than {MOST_SIZES} rows")
    scratch = Scratch(spark)
    if not listed:
        schema = "pack_name string, capacity long, pack_id string, doc_id long, piece_no long, start_token long, n_tokens long"
        return spark.createDataFrame([], schema)
    sized = sizes(documents, scratch, folder, vocabulary)
    each = F.explode(F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["c"]).alias("capacity")) for r in listed]))
    rows = sized.select("doc_id", F.col("n_tokens").alias("n"), each.alias("p")).select("doc_id", "n", "p.pack_name", "p.capacity")
    full = F.expr("case when n > capacity then n div capacity else 0l end")
    rows = rows.withColumn("full", full)
    whole = rows.where("full > 0").select("pack_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
    whole = whole.select(
        "pack_name", "capacity", F.concat_ws("-", F.lit("d"), "doc_id", "piece_no").alias("pack_id"), "doc_id", "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"),
    )
    rest = rows.withColumn("n_tokens", F.col("n") - F.col("full") * F.col("capacity")).where("full = 0 or n_tokens > 0")
    counts = {(r["pack_name"], r["capacity"]): r["k"] for r in rest.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("k")).collect()}
    groups = F.coalesce(*[F.when((F.col("pack_name") == n) & (F.col("capacity") == c), F.lit(-(-k // group_items))) for (n, c), k in sorted(counts.items())], F.lit(1))
    rest = rest.select(
        "pack_name", "capacity", "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), "n_tokens",
        F.pmod(F.xxhash64("doc_id"), groups).alias("group"),
    )

    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        at = assign(items["n_tokens"].to_numpy(np.int64), int(key[1]), linear, quadratic)
        items["pack_id"] = [f"g-{key[2]}-{a}" for a in at]
        return items[["pack_name", "capacity", "pack_id", "doc_id", "piece_no", "start_token", "n_tokens"]]

    packed = rest.groupBy("pack_name", "capacity", "group").applyInPandas(
        fill, "pack_name string, capacity long, pack_id string, doc_id long, piece_no long, start_token long, n_tokens long"
    )
    return whole.unionByName(packed)


def summary(packed: DataFrame) -> DataFrame:
    """(pack_name, capacity, packs, tokens, fill, fullest, emptiest): how well the packs of each size are filled."""
    packs = packed.groupBy("pack_name", "capacity", "pack_id").agg(F.sum("n_tokens").alias("t"))
    out = packs.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("packs"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.min("t").alias("emptiest"))
    return out.withColumn("fill", F.col("tokens") / (F.col("packs") * F.col("capacity")))
