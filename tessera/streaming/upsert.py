"""Incremental upkeep as a stream: batches of changed chunks merge into the stored table.

An extension: the original has batch upkeep only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incremental import merge_rows

#: Parts of a table by a hash of the key; a batch rewrites those that it has rows of.
BUCKETS = 64


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """Runs all files of `source` through the merge, oldest first, and stops; later calls take what is new.

    A batch writes new versions of the buckets it touches and then a commit, which says the version of every
    bucket. So a batch that is tried again starts from the commit before it, and readers never see half of
    one. Versions that neither the last commit nor the one before it names are dropped.
    """

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        before = commit(spark, target, number)
        old = _read(spark, target, {b: v for b, v in before.items() if b in touched})
        rows = fresh if old is None else merge_rows(old, fresh, key)
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/version={number:09d}")
        fresh.unpersist()
        now = before | dict.fromkeys(touched, number)
        _put(spark, f"{target}/commits", f"{number:09d}", json.dumps({str(b): v for b, v in now.items()}))
        for v in _listed(spark, f"{target}/data"):
            if v not in {*now.values(), *before.values()}:
                _fs(spark, target).delete(_path(spark, f"{target}/data/version={v:09d}"), True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def _fs(spark: SparkSession, where: str):
    return _path(spark, where).getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, where: str) -> list[int]:
    """The numbers that the names in a folder end in."""
    fs, path = _fs(spark, where), _path(spark, where)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.rpartition("=")[2]) for n in names if n.rpartition("=")[2].isdigit())


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A short file, there as a whole or not at all."""
    fs = _fs(spark, folder)
    out = fs.create(_path(spark, f"{folder}/_{name}"), True)
    out.write(text.encode())
    out.close()
    fs.delete(_path(spark, f"{folder}/{name}"), False)
    fs.rename(_path(spark, f"{folder}/_{name}"), _path(spark, f"{folder}/{name}"))


def commit(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket by the last commit (before a batch)."""
    have = [v for v in _listed(spark, f"{target}/commits") if before is None or v < before]
    if not have:
        return {}
    stream = _fs(spark, target).open(_path(spark, f"{target}/commits/{have[-1]:09d}"))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return {int(b): v for b, v in json.loads(text).items()}


def _read(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    paths = [f"{target}/data/version={v:09d}/_bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.option("basePath", f"{target}/data").parquet(*paths).drop("version")


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The table by the last commit (before a batch), or None."""
    rows = _read(spark, target, commit(spark, target, before))
    return None if rows is None else rows.drop("_bucket")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; works on streams and on tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
