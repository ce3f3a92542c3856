"""Near-duplicate functions: tensored banding, then exact verification.

Each text gets two small collections of ``tables`` hash groups (each of ``rows`` minhash
values). A table key is a pair of one group of either collection, so tables**2 tables
cost only 2 * tables * rows minhash computations. Two texts meet in a table if they
agree in a group of both collections: at similarity s with probability
(1 - (1 - s**rows)**tables)**2.

Texts with equal shingle sets form a class; banding runs on one representative per
class. A group value that no other text has cannot make a meeting, so it is dropped
before the keys are formed (counted with map-side combine): most texts then send no
key at all. Meetings are cut in three steps of growing weight: the sizes of the sets (exact), a sketch of four bits of each minhash
value (at the threshold it loses a pair with the probability of ``SKETCH_DEVIATIONS`` standard errors, 0.00003), and the full sets.

``similar_pairs`` gives every pair of classes, for results that are pairs. ``star_pairs`` gives links that are enough for the groups, in
proportion to the texts: each bucket is linked to its least member; where the verified links leave a bucket in several
components, and only there, all its meetings across components follow. No group loses a member by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shingles import WordHash, combine, minhashes, shingle_set, words
from codeloom.operators.bitmaps import maybe_in, with_membership
from codeloom.operators.components import connected_components
from codeloom.storage import Scratch

TABLES, ROWS, SEED = 20, 3, 20
#: Standard errors below the expected agreement at the threshold from which a sketch still passes.
SKETCH_DEVIATIONS = 4.0
#: Members of a class that meet another's in one task when classes are expanded.
BLOCK = 2000
_FEATURES = "id long, class_hi long, class_lo long, size long, sketch array<long>, shingles array<long>, left array<long>, right array<long>"


def features(texts: DataFrame, shingle: int, min_words: int, tables: int = TABLES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """Shingle set, class key and both hash collections of every (id, text) with at least ``min_words`` words."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for b in batches:
            ids, sets = [], []
            for i, t in zip(b["id"], b["text"]):
                w = words(t)
                if len(w) >= max(min_words, shingle):
                    ids.append(i)
                    sets.append(shingle_set(w, shingle, known))
            if not ids:
                continue
            sig = minhashes(sets, 2 * tables * rows, seed)
            groups = [combine(sig[:, i * rows : (i + 1) * rows]) for i in range(2 * tables)]
            left, right = np.stack(groups[:tables], 1).view(np.int64), np.stack(groups[tables:], 1).view(np.int64)
            bits = np.zeros((len(sets), -(-sig.shape[1] // 16) * 16), dtype=np.uint64)
            bits[:, : sig.shape[1]] = sig & np.uint64(15)
            sketch = (bits.reshape(len(sets), -1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)
            low = np.array([int(s.sum(dtype=np.uint64)) ^ len(s) for s in sets], dtype=np.uint64).view(np.int64)
            high = np.array([int(np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93))) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame(
                {
                    "id": np.array(ids, dtype=np.int64), "class_hi": high, "class_lo": low, "size": [len(s) for s in sets], "sketch": list(sketch),
                    "shingles": [s.view(np.int64) for s in sets], "left": list(left), "right": list(right),
                }
            )

    return texts.mapInPandas(compute, _FEATURES)


def _shared(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """The (id, slot, value) whose value at that slot another id has too.

    A count over all rows finds the values that come again, a bitmap of them drops the other entries where they are read, and the few
    that are left are made distinct and counted exactly.
    """
    key = F.xxhash64("slot", "value")
    again = entries.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key.alias("_k"))
    some = scratch.save(maybe_in(entries, key, scratch.save(again), F.col("_k")).distinct())
    hot = some.groupBy(F.col("slot").alias("_s"), F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return some.join(hot, (F.col("slot") == F.col("_s")) & (F.col("value") == F.col("_v")), "left_semi")


class Banding:
    """The classes of equal shingle sets of ``texts`` (id, text) and the table keys of their representatives.

    Null ids and null texts are dropped; of several texts of one id one class counts, the least. Texts too short for one shingle or
    with fewer than ``min_words`` words are no case. ``members`` is (id, rep): every text's class representative, its smallest id.
    """

    def __init__(self, texts: DataFrame, threshold: float, shingle: int = 5, min_words: int = 0, tables: int = TABLES, rows: int = ROWS, scratch: Scratch | None = None):
        self.threshold, self.values = threshold, 2 * tables * rows
        self.scratch = scratch = scratch or Scratch(texts.sparkSession)
        texts = texts.where("id is not null and text is not null").select("id", "text")
        self.rows = all_rows = scratch.save(features(texts, shingle, min_words, tables, rows))
        classes = all_rows.groupBy("id").agg(F.min(F.struct("class_hi", "class_lo")).alias("_k"), F.count(F.lit(1)).alias("_times"))
        reps = classes.groupBy("_k").agg(F.min("id").alias("rep"))
        self.members = scratch.save(classes.select("id", F.col("_k").alias("_c"), "_times").join(reps, F.col("_c") == F.col("_k")).select("id", "rep", "_c", "_times"))
        slots = lambda c: self.representatives(c).select("id", F.posexplode(c).alias("slot", "value"))
        left, right = _shared(slots("left"), scratch), _shared(slots("right"), scratch)
        right = right.select(F.col("id").alias("_id"), F.col("slot").alias("slot2"), F.col("value").alias("value2"))
        self.keys = scratch.save(left.join(right, F.col("id") == F.col("_id")).select("id", F.xxhash64("slot", "value", "slot2", "value2").alias("key")))

    def representatives(self, *columns: str) -> DataFrame:
        """(id, columns) of the representatives. Only rows of ids that are none, or that come again, are shuffled: a bitmap of those parts the table where it is read."""
        rows = self.rows.select("id", "class_hi", "class_lo", *columns)
        doubtful = self.members.where("id <> rep or _times > 1").select(F.col("id").alias("_d"))
        parted = with_membership(rows, F.col("id"), doubtful, F.col("_d"), "_doubt")
        own = self.members.where("id = rep").select(F.col("rep").alias("_rep"), "_c")
        checked = parted.where("_doubt").join(own, (F.col("id") == F.col("_rep")) & (F.struct("class_hi", "class_lo") == F.col("_c")), "left_semi").dropDuplicates(["id"])
        return parted.where("not _doubt").select("id", *columns).unionByName(checked.select("id", *columns))

    def verify(self, meet: DataFrame) -> DataFrame:
        """(a, b, similarity) of the distinct meetings (a, b) that reach the threshold."""
        scratch, t = self.scratch, self.threshold
        meet = scratch.save(meet.select("a", "b").distinct())
        met = scratch.save(meet.select(F.explode(F.array("a", "b")).alias("_i")).distinct())
        wanted = lambda m, *c: maybe_in(self.representatives(*c), F.col("id"), m, F.col("_i")).join(m, F.col("id") == F.col("_i"), "left_semi")
        small = scratch.save(wanted(met, "size", "sketch"))
        side = lambda x: small.select(F.col("id").alias(f"_{x}"), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"q{x}"))
        both = meet.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
        p = t + (1 - t) / 16
        least = self.values * p - SKETCH_DEVIATIONS * (self.values * p * (1 - p)) ** 0.5
        words = -(-self.values // 16)
        agree = F.lit(0)
        for i in range(words):
            x = F.expr(f"qa[{i}] ^ qb[{i}]")
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
            agree = agree + (F.lit(16) - F.bit_count(x))
        agree = agree - F.lit(words * 16 - self.values)  # the unused places agree
        near = both.where((F.least("na", "nb") >= F.lit(t) * F.greatest("na", "nb")) & (agree >= F.lit(least)))
        near = scratch.save(near.select("a", "b"), replaces=meet)
        met = scratch.save(near.select(F.explode(F.array("a", "b")).alias("_i")).distinct(), replaces=met)
        sets = wanted(met, "shingles")
        one, two = [sets.select(F.col("id").alias(f"_{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab"]
        joined = near.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).withColumn("_c", F.size(F.array_intersect("sa", "sb")))
        pairs = joined.select("a", "b", (F.col("_c") / (F.size("sa") + F.size("sb") - F.col("_c"))).alias("similarity"))
        return scratch.save(pairs.where(F.col("similarity") >= t))

    def similar_pairs(self) -> DataFrame:
        """(a, b, similarity), a < b: every pair of representatives that meets and reaches the threshold; as many rows as there are such pairs."""
        other = self.keys.select(F.col("id").alias("b"), F.col("key").alias("_key"))
        return self.verify(self.keys.select(F.col("id").alias("a"), "key").join(other, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b"))))

    def star_pairs(self) -> DataFrame:
        """(a, b, similarity), a < b: verified pairs that connect what ``similar_pairs`` connects, at most one a text and bucket where its members hang together."""
        least = self.keys.groupBy(F.col("key").alias("_key")).agg(F.min("id").alias("a"))
        stars = self.verify(self.keys.join(least, F.col("key") == F.col("_key")).where("id <> a").select("a", F.col("id").alias("b")))
        parts = connected_components(stars).select(F.col("node").alias("_n"), "component")
        placed = self.scratch.save(self.keys.join(parts, F.col("id") == F.col("_n"), "left").select("id", "key", F.coalesce("component", "id").alias("part")))
        torn = placed.groupBy(F.col("key").alias("_t")).agg(F.min("part").alias("_l"), F.max("part").alias("_g")).where("_l <> _g").select("_t")
        rest = self.scratch.save(placed.join(torn, F.col("key") == F.col("_t"), "left_semi"), replaces=placed)
        other = rest.select(F.col("id").alias("b"), F.col("key").alias("_key"), F.col("part").alias("_part"))
        across = rest.withColumnRenamed("id", "a").join(other, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & (F.col("part") != F.col("_part"))).select("a", "b").distinct()
        done = stars.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        return stars.unionByName(self.verify(across.join(done, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")))


def function_texts(nodes: DataFrame) -> DataFrame:
    """(id, text) of functions and methods: signature, a blank, code."""
    return nodes.where(F.col("type").isin("function", "method")).select("id", F.concat(F.coalesce("signature", F.lit("")), F.lit(" "), F.coalesce("code_content", F.lit(""))).alias("text"))


def similar_functions(nodes: DataFrame, threshold: float = 0.6, shingle: int = 3, min_words: int = 30) -> Banding:
    return Banding(function_texts(nodes), threshold, shingle, min_words)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id_a, node_id_b, similarity) of ids: class pairs and the copies within a class, expanded to the answer's own size.

    A class of more than ``BLOCK`` members is split into blocks, so no task expands a whole one.
    """
    sized = members.groupBy(F.col("rep").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"), F.count(F.lit(1)).alias("_k"))
    blocks = members.join(sized, F.col("rep") == F.col("_s")).select(F.col("rep").alias("_r"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("_n")).alias("_b"))

    def meet(left: DataFrame) -> DataFrame:
        spread = left.join(sized, F.col("rep") == F.col("_s")).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        return spread.join(blocks, (F.col("rep") == F.col("_r")) & (F.col("_at") == F.col("_b")))

    one = members.select(F.col("rep").alias("_ra"), F.col("id").alias("x"))
    across = meet(pairs.join(one, F.col("a") == F.col("_ra")).select("x", F.col("b").alias("rep"), "similarity")).select("x", "y", "similarity")
    many = sized.where("_k > 1").select(F.col("_s").alias("_m"))
    copies = one.join(many, F.col("_ra") == F.col("_m"), "left_semi").select("x", F.col("_ra").alias("rep"))
    within = meet(copies).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("x", "y").alias("node_id_a"), F.greatest("x", "y").alias("node_id_b"), "similarity")


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, class_id, group_id, links): the text's class of equal sets, the group of everything linked, and how many of ``pairs`` its class is in."""
    comp = connected_components(pairs).select(F.col("node").alias("_r"), F.col("component"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("_l")).groupBy("_l").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(comp, F.col("rep") == F.col("_r"), "left").join(links, F.col("rep") == F.col("_l"), "left")
    return out.select(F.col("id").alias("node_id"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
