"""Lineage cuts as Parquet tables in the shared checkpoint folder.

Iterative operators write their state as a table below ``spark.checkpoint.dir`` (a
folder every executor can read), so a lost executor costs a re-read, never a
recomputation of all rounds. Parquet keeps the tables compressed and gives the
optimizer sizes for the next round's joins. The tables of an application lie in one folder, which
``release`` deletes; so does the end of the driver.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is configured a session on one machine (tests) gets a local folder; on several machines this is an error, as no executor could read another's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir is not set: intermediate tables on {master} need a folder that every executor can read")
    root = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/codeloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of the session's application. Results that were not written or collected yet can no longer be computed."""
    _delete(spark, _folder(spark))


_watched: set[str] = set()


def _release_at_exit(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _watched:
        _watched.add(app)

        def end() -> None:
            try:
                if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
                    release(spark)
            except Exception:  # the session has ended before: its folder is left to the owner of the shared folder
                pass

        atexit.register(end)


class Scratch:
    """Tables of one operator run; ``save`` replaces a lineage by a written table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{_folder(spark)}/{uuid.uuid4().hex}"
        _release_at_exit(spark)
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """Write ``df`` and return it re-read; ``replaces`` is a table of this scratch that is dropped afterwards."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        # keep a reference, so that an id is never reused for another frame
        out.__dict__["_scratch"] = self
        if replaces is not None:
            self.drop(replaces)
        return out

    def save_counting(self, df: DataFrame, replaces: DataFrame | None = None, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
        """``save`` and the number of rows for which each condition holds, counted while writing."""
        seen = Observation()
        out = self.save(df.observe(seen, *[F.count_if(c).alias(k) for k, c in conditions.items()]), replaces)
        return out, {k: int(v) for k, v in seen.get.items()}

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)
