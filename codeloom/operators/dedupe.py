"""One row a key without shuffling the rows whose key is alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.bitmaps import with_membership


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each value of ``key``, the least by all columns; rows with a null key are dropped.

    A count of the keys alone finds those that come again, and a bitmap of fixed size parts the table where it is read: only rows whose
    key may come again are shuffled with their other columns. Meant for wide rows with few repeats; select the columns that are needed
    before. Columns must be sortable.
    """
    others = [c for c in df.columns if c != key]
    rows = df.where(F.col(key).isNotNull())
    again = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_key")
    parted = with_membership(rows, F.col(key), again, F.col("_key"), "_again")
    alone = parted.where("not _again").select(*df.columns)
    if not others:
        return alone.unionByName(parted.where("_again").select(key).distinct())
    least = parted.where("_again").groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*").select(*df.columns)
    return alone.unionByName(least)
