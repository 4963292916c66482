"""Tables of a run in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine, but only if all executors are on it, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or "file:///tmp/checkpoints"


#: Paths that this process has given out.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Deletes what this process has written to scratch paths, once no result that reads it is needed any more."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: worked out once, and not lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int):
    """F.broadcast if df has up to so many rows, else a hint that changes nothing."""
    from pyspark.sql import functions as F

    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda x: x
