"""Tables that cut lineage, in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local master that names none; that setting can't be changed in a running session.
_fallback: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where none is named, one process that is driver and executors (local[...])
    takes a temporary folder, kept for the process; on a cluster that is an
    error, as executors don't see each other's folders.
    """
    global _fallback
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        _fallback = _fallback or "file://" + tempfile.mkdtemp(prefix="trackloom-")
        folder = _fallback
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/trackloom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables; for when its results are written."""
    _made.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder where nothing is, for files that a writer makes; dropped like stored tables."""
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a lost executor recomputes a scan, not the job."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this driver has written and not dropped, in order.
_made: list[str] = []


def written() -> int:
    """How many tables stand now, for drop_but_last."""
    return len(_made)


def drop_but_last(spark: SparkSession, since: int) -> None:
    """Drops the tables written since then but the last, once that one holds all that is still read."""
    for path in _made[since:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[since:-1] = []
