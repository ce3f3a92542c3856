"""A membership filter of fixed size that runs before an exact join.

A selective semi join otherwise shuffles every row of its large side. Here the keys of the
small side set bits of a bitmap of 2**bits bits (2 MB for 24), built by an aggregate of at
most 2**bits / 32768 rows; the broadcast bitmap drops most other rows where they are read. Rows
with a colliding hash pass, so an exact join must follow; no row of a member is ever dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap row of the SQL bitmap functions.
ROW_BITS = 32768


def with_membership(df: DataFrame, key: Column, members: DataFrame, member: Column, name: str, bits: int = 24) -> DataFrame:
    """``df`` with a column ``name``: whether the key may be among the members; false for null keys and where it surely is not."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1
    m = members.where(member.isNotNull()).select(place(member).alias("_p"))
    maps = m.groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map"))
    at = df.withColumn("_p", place(key)).withColumn("_at", F.bitmap_bit_position("_p"))
    hit = at.join(F.broadcast(maps), F.bitmap_bucket_number("_p") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_map", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = key.isNotNull() & F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return hit.withColumn(name, inside).drop("_p", "_at", "_bucket", "_map")


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member: Column, bits: int = 24) -> DataFrame:
    """The rows of ``df`` whose key may be among the members; null keys never are. An empty side gives no rows."""
    return with_membership(df, key, members, member, "_in", bits).where("_in").drop("_in")
