"""Frequency of every distinct name and term by heavy-light aggregation.

A term that a large share of all records holds would send all its rows to one
reducer. Heavy terms are detected on a hash sample of the records and broadcast (at most
``max_heavy`` strings); each task counts them exactly in local arrays and sends one
row per heavy term it met. Only the remaining terms go through the shuffle, already
summed up per task. The union of both tables is exact whatever the detection found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.bitmaps import with_membership

#: Light counts held by a task before they are sent on.
FLUSH = 200_000


def _heavy(records: DataFrame, sample_one_in: int, max_heavy: int) -> list[tuple[str, str]]:
    """The most frequent (field, term) of a hash sample of the ids, at most ``max_heavy`` of them."""
    some = records.where(F.pmod(F.xxhash64("id"), F.lit(sample_one_in)) == 0)
    names = some.where("name is not null").select(F.lit("name").alias("field"), F.col("name").alias("term"))
    terms = some.select(F.lit("name_tokens").alias("field"), F.explode(F.split(F.lower("name_tokens"), r"\s+")).alias("term")).where("term <> ''")
    top = names.unionByName(terms).groupBy("field", "term").count().where("count > 1").orderBy(F.desc("count"), "field", "term").limit(max_heavy)
    return [(r["field"], r["term"]) for r in top.select("field", "term").collect()]


_COUNTS = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("nodes", pa.int64())])


def batch_counts(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(field, distinct terms, occurrences, rows holding it) of the names and of the terms of a batch."""
    names = batch.column("name").drop_null().dictionary_encode()
    n = np.bincount(names.indices.to_numpy(zero_copy_only=False), minlength=len(names.dictionary)) if len(names) else np.zeros(0, np.int64)
    yield "name", names.dictionary, n, n
    lists = pc.utf8_split_whitespace(pc.utf8_lower(batch.column("name_tokens")))
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    filled = pc.not_equal(flat, "")
    coded, rows = flat.filter(filled).dictionary_encode(), rows.filter(filled).to_numpy(zero_copy_only=False)
    if len(coded):
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = len(coded.dictionary)
        held = np.unique(rows.astype(np.int64) * size + codes) % size
        yield "name_tokens", coded.dictionary, np.bincount(codes, minlength=size), np.bincount(held, minlength=size)


def term_counts(nodes: DataFrame, sample_one_in: int = 64, max_heavy: int = 4096) -> DataFrame:
    """(field, term, occurrences, nodes) for every exact name and every lower-case term of ``name_tokens``.

    Of several rows of an id the least (name, name_tokens) counts; rows without an id are dropped. A
    null name is no term, an empty one is; terms are the parts between white space.
    Empty tables give no rows.
    """
    spark = nodes.sparkSession
    records = nodes.where("id is not null").select("id", "name", "name_tokens")
    found = _heavy(records, sample_one_in, max_heavy)
    heavy = spark.sparkContext.broadcast({f: [t for g, t in found if g == f] for f in ("name", "name_tokens")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {f: pa.array(t, pa.string()) for f, t in heavy.value.items()}
        exact = {f: np.zeros((2, len(t)), dtype=np.int64) for f, t in known.items()}
        light: list[pa.Table] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if light:
                out = pa.concat_tables(light).group_by(["field", "term"]).aggregate([("occurrences", "sum"), ("nodes", "sum")])
                light.clear()
                yield from out.select(["field", "term", "occurrences_sum", "nodes_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS).to_batches()

        for b in batches:
            for field, terms, occurrences, rows in batch_counts(b):
                slot = pc.index_in(terms, known[field])
                hot = slot.is_valid().to_numpy(zero_copy_only=False)
                at = slot.drop_null().to_numpy(zero_copy_only=False)
                exact[field][0, at] += occurrences[hot]
                exact[field][1, at] += rows[hot]
                rest = terms.filter(pa.array(~hot))
                light.append(pa.table([pa.array([field] * len(rest), pa.string()), rest, pa.array(occurrences[~hot], pa.int64()), pa.array(rows[~hot], pa.int64())], schema=_COUNTS))
                held += len(rest)
            if held >= FLUSH:
                yield from flush()
                held = 0
        yield from flush()
        for f, terms in known.items():
            met = exact[f][1] > 0
            yield pa.record_batch([pa.array([f] * int(met.sum()), pa.string()), terms.filter(pa.array(met)), pa.array(exact[f][0][met]), pa.array(exact[f][1][met])], schema=_COUNTS)

    again = records.groupBy(F.col("id").alias("_r")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_r")
    parted = with_membership(records, F.col("id"), again, F.col("_r"), "_again")
    once = parted.where("not _again").select("name", "name_tokens")
    least = parted.where("_again").groupBy("id").agg(F.min(F.struct("name", "name_tokens")).alias("_v")).select("_v.name", "_v.name_tokens")
    schema = "field string, term string, occurrences long, nodes long"
    parts = once.mapInArrow(count, schema).unionByName(least.mapInArrow(count, schema))
    return parts.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("nodes").alias("nodes"))


def marked_terms(nodes: DataFrame, rare_below: int = 3, common_share: float = 0.02) -> DataFrame:
    """``term_counts`` with mark: 'rare' below ``rare_below`` nodes, 'common' above ``common_share`` of all nodes, else null; rare goes first."""
    n = nodes.where("id is not null").select("id").distinct().count()
    mark = F.when(F.col("nodes") < rare_below, "rare").when(F.col("nodes") > F.lit(common_share * n), "common")
    return term_counts(nodes).withColumn("mark", mark)
