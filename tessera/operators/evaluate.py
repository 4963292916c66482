"""Retrieval metrics as relations over ranked results and expected files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE_KS, NDCG_KS = (1, 3, 5, 10), (5, 10)


def matches(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (case_id, rank, repo_name, file_path) with the expected file each one is, if any.

    Equal paths first; else the same repository and an expected path that the result's ends with, the
    longest. Joined on case and repository, so that only pairs of one repository are ever compared.
    """
    e = expected.select("case_id", "repo_name", F.col("file_path").alias("expected_path"), "relevance")
    pairs = results.select("case_id", "rank", "repo_name", "file_path").join(e, ["case_id", "repo_name"]).where(F.endswith("file_path", F.col("expected_path")))
    w = Window.partitionBy("case_id", "rank").orderBy((F.col("file_path") == F.col("expected_path")).desc(), F.char_length("expected_path").desc(), "expected_path")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("case_id", "rank", F.concat_ws(":", "repo_name", "expected_path").alias("key"), "relevance")


def case_metrics(cases: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """One wide row a case: hit, precision and recall at each depth, RR, AP, and NDCG raw and per distinct file.

    Raw NDCG counts every chunk of an expected file, and so can exceed 1; the other counts a file once.
    """
    hit = matches(results, expected)
    w = Window.partitionBy("case_id")
    first = hit.groupBy("case_id", "key").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    first = first.withColumn("nth", F.row_number().over(w.orderBy("rank", "key")))
    n = expected.select("case_id", "repo_name", "file_path", "relevance").distinct()
    ideal = n.withColumn("place", F.row_number().over(w.orderBy(F.desc("relevance"), "repo_name", "file_path")))
    gain = lambda k, r: F.sum(F.when(F.col(r) <= k, F.col("relevance") / F.log2(F.col(r) + 1)))
    hits = hit.groupBy("case_id").agg(
        *(F.max((F.col("rank") <= k).cast("int")).alias(f"file_at_{k}") for k in FILE_KS), F.min("rank").alias("first"),
        *(gain(k, "rank").alias(f"dcg_{k}") for k in NDCG_KS),
    )
    found = first.groupBy("case_id").agg(
        *(F.sum((F.col("rank") <= k).cast("int")).alias(f"found_{k}") for k in FILE_KS), F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
        *(gain(k, "rank").alias(f"ddcg_{k}") for k in NDCG_KS),
    )
    best = ideal.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *(gain(k, "place").alias(f"idcg_{k}") for k in NDCG_KS))
    out = cases.join(hits, "case_id", "left").join(found, "case_id", "left").join(best, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r = lambda c: F.round(zero(c), 6)
    cols = {f"file_at_{k}": F.coalesce(f"file_at_{k}", F.lit(0)) for k in FILE_KS}
    cols |= {f"precision_at_{k}": r(F.col(f"found_{k}") / F.lit(k)) for k in FILE_KS} | {f"recall_at_{k}": r(F.col(f"found_{k}") / F.col("n")) for k in FILE_KS}
    cols |= {"rr": F.when(F.col("n").isNotNull(), r(1 / F.col("first"))), "ap": r(F.col("precisions") / F.col("n"))}
    cols |= {f"ndcg_raw_at_{k}": r(F.col(f"dcg_{k}") / F.col(f"idcg_{k}")) for k in NDCG_KS} | {f"ndcg_at_{k}": r(F.col(f"ddcg_{k}") / F.col(f"idcg_{k}")) for k in NDCG_KS}
    return out.select(*cases.columns, *(v.alias(k) for k, v in cols.items()))


METRICS = [*(f"{m}_at_{k}" for m in ("file", "precision", "recall") for k in FILE_KS), "rr", "ap", *(f"{m}_at_{k}" for m in ("ndcg_raw", "ndcg") for k in NDCG_KS)]


def label_hits(cases: DataFrame, results: DataFrame, expected: str, found: str, k: int) -> DataFrame:
    """Whether one of a case's expected labels is among those of its first k results; true where none is expected."""
    seen = results.where(F.col("rank") <= k).groupBy("case_id").agg(F.flatten(F.collect_set(found)).alias("_seen"))
    hit = F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, True).otherwise(F.coalesce(F.arrays_overlap(expected, "_seen"), F.lit(False)))
    return cases.join(seen, "case_id", "left").withColumn("hit", hit).drop("_seen")


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(dim, value, metric, score): macro averages over all cases and over each value of each column of `by`, in one pass."""
    long = metrics.select(*(by or []), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in METRICS))).alias("m")).select(*(by or []), "m.*")
    if not by:
        return long.groupBy("metric").agg(F.round(F.avg("x"), 6).alias("score")).select(F.lit("all").alias("dim"), F.lit("all").alias("value"), "metric", "score")
    sets = long.groupingSets([["metric"], *([c, "metric"] for c in by)], *by, "metric").agg(F.round(F.avg("x"), 6).alias("score"), F.count(F.lit(1)).alias("cases"), *(F.grouping(c).alias(f"_g_{c}") for c in by))
    dim, value = F.lit("all"), F.lit("all")
    for c in by:
        dim = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(dim)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return sets.select(dim.alias("dim"), value.alias("value"), "metric", "score", "cases")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two summaries."""
    b, a = before.select("metric", F.col("score").alias("before")), after.select("metric", F.col("score").alias("after"))
    return b.join(a, "metric").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def bootstrap(metrics: DataFrame, names: list[str], resamples: int = 1000, low: int = 25, high: int = 975, least: int = 5, seed: int = 42) -> DataFrame:
    """(metric, lower, upper): order statistics of the means of `resamples` samples with replacement.

    Draw j of resample i takes the case whose number is a hash of (seed, i, j), so that any engine repeats
    the same draws. With fewer than `least` cases there is no interval; a resample without any value is left out. The cases of one evaluation are few
    (some thousands at most) and are joined by number; nothing is collected.
    """
    spark = metrics.sparkSession
    numbered = metrics.withColumn("_no", F.row_number().over(Window.orderBy("case_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("_n") >= least)
    size = numbered.select(F.max("_n").alias("size"))
    draws = spark.range(resamples).withColumnRenamed("id", "i").join(F.broadcast(size)).where("size is not null").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))))
    dice = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("long")
    means = draws.withColumn("_no", F.pmod(dice, F.col("size"))).join(numbered, "_no").groupBy("i").agg(*(F.round(F.avg(F.col(m).cast("double")), 9).alias(m) for m in names))
    long = means.select("i", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in names))).alias("r")).select("i", "r.*").where("x is not null")
    order = long.withColumn("_r", F.row_number().over(Window.partitionBy("metric").orderBy("x", "i")) - 1)
    return order.groupBy("metric").agg(F.max(F.when(F.col("_r") == low, F.col("x"))).alias("lower"), F.max(F.when(F.col("_r") == high, F.col("x"))).alias("upper"))
