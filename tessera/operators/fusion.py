"""Fusing, blending, injecting into and thinning out ranked lists.

A ranked list is (query_id, chunk_id, rank, score): rank from 1 is the order, whatever order rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.text import words as identifiers


def rerank(df: DataFrame, score: str = "score", then: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Ranks anew by falling score; ties keep the order of `then`."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *then)
    return df.withColumn("rank", F.row_number().over(w))


def last_position(ranked: DataFrame) -> DataFrame:
    """One row for each chunk of a list: of repeated ones the last position counts."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.max("rank").alias("rank"))


def weights(code: Column, config: SearchConfig = SearchConfig()) -> tuple[Column, Column]:
    """(dense, sparse) weights; queries that look like code lean to the sparse side."""
    dense = F.when(code, F.greatest(F.lit(config.dense_weight - config.code_shift), F.lit(config.weight_floor))).otherwise(F.lit(config.dense_weight))
    return dense, F.when(code, F.lit(config.bm25_weight + config.code_shift)).otherwise(F.lit(config.bm25_weight))


def rrf(dense: DataFrame, sparse: DataFrame, config: SearchConfig = SearchConfig(), code: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion: weight / (k + rank), an absent list adding nothing. code: (query_id, is_code)."""
    d = last_position(dense).withColumnRenamed("rank", "dense_rank")
    s = last_position(sparse).withColumnRenamed("rank", "sparse_rank")
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    if code is not None:
        both = both.join(code.select("query_id", "is_code"), "query_id", "left")
    is_code = F.coalesce(F.col("is_code"), F.lit(False)) if code is not None else F.lit(False)
    wd, ws = weights(is_code, config)
    part = lambda w, r: F.coalesce(w / (F.lit(config.rrf_k) + F.col(r)), F.lit(0.0))
    score = F.round(part(wd, "dense_rank") + part(ws, "sparse_rank"), 9)
    return rerank(both.select("query_id", "chunk_id", "dense_rank", "sparse_rank", score.alias("score")))


def rrf_docs(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """The plain variant for documentation: no weights, and a list that lacks a chunk ranks it after its last."""
    n = lambda r, c: r.groupBy("query_id").agg((F.max("rank") + 1).alias(c))
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("d")).join(sparse.select("query_id", "chunk_id", F.col("rank").alias("s")), ["query_id", "chunk_id"], "full_outer")
    both = both.join(n(dense, "nd"), "query_id", "left").join(n(sparse, "ns"), "query_id", "left")
    at = lambda r, m: F.coalesce(r, m, F.lit(1))
    score = F.round(1 / (k + at(F.col("d"), F.col("nd"))) + 1 / (k + at(F.col("s"), F.col("ns"))), 9)
    return rerank(both.select("query_id", "chunk_id", score.alias("score")))


def add_signal(fused: DataFrame, signal: DataFrame, weight: float = 0.4, k: int = 60) -> DataFrame:
    """Adds weight / (k + rank) of an outer ranking to the scores it covers."""
    out = fused.join(signal.select("query_id", "chunk_id", F.col("rank").alias("_r")), ["query_id", "chunk_id"], "left")
    out = out.withColumn("score", F.round(F.col("score") + F.coalesce(weight / (k + F.col("_r")), F.lit(0.0)), 9))
    return rerank(out.drop("_r", "rank"))


def blend(fused: DataFrame, outer: DataFrame, alpha: float = 0.6) -> DataFrame:
    """alpha times the min-max scaled score plus the rest of the scaled outer score; uncovered chunks get 0 from outside.

    A query without outer scores keeps its own.
    """
    own = Window.partitionBy("query_id")
    scaled = lambda x, lo, hi: (x - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    ext = outer.select("query_id", "chunk_id", F.col("score").alias("_e"))
    ext = ext.withColumn("_e", scaled(F.col("_e"), F.min("_e").over(own), F.max("_e").over(own)))
    out = fused.join(ext, ["query_id", "chunk_id"], "left")
    mixed = alpha * scaled(F.col("score"), F.min("score").over(own), F.max("score").over(own)) + (1 - alpha) * F.coalesce(F.col("_e"), F.lit(0.0))
    out = out.withColumn("_s", F.when(F.count("_e").over(own) > 0, F.round(mixed, 9)).otherwise(F.col("score")))
    return rerank(out.drop("score", "_e").withColumnRenamed("_s", "score").withColumnRenamed("rank", "_before"), then=("_before",)).drop("_before")


def diversify(ranked: DataFrame, path: str = "file_path", most: int = 3, factor: float = 0.5) -> DataFrame:
    """From the (most + 1)-th of a file on, in the order at hand, scores shrink; then the list is ranked anew."""
    nth = F.row_number().over(Window.partitionBy("query_id", path).orderBy("rank"))
    out = ranked.withColumn("_n", nth).withColumn("score", F.when(F.col("_n") > most, F.round(F.col("score") * factor, 9)).otherwise(F.col("score")))
    return rerank(out.withColumnRenamed("rank", "_before"), then=("_before",)).drop("_before", "_n")


def inject(ranked: DataFrame, extra: DataFrame, at: int, most: int = 3) -> DataFrame:
    """Puts the first `most` rows of extra that the list lacks at place `at` (from 0, or the end of a shorter list); the rest move on."""
    new = extra.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    new = new.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    sizes = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_len"))
    added = new.groupBy("query_id").agg(F.count(F.lit(1)).alias("_new"))
    kept = ranked.join(added, "query_id", "left").withColumn("rank", F.col("rank") + F.when(F.col("rank") > at, F.coalesce("_new", F.lit(0))).otherwise(F.lit(0)))
    placed = new.join(sizes, "query_id", "left").withColumn("rank", F.least(F.lit(at), F.coalesce("_len", F.lit(0))) + F.col("_i"))
    cols = ["query_id", "chunk_id", "rank", "score"]
    return kept.select(*cols, F.lit(False).alias("injected")).unionByName(placed.select(*cols, F.lit(True).alias("injected")))


def best_of(results: DataFrame, key: list[str], k: int) -> DataFrame:
    """Merges the lists of several queries: the best row of each key, then the k best."""
    w = Window.partitionBy("group_id", *key).orderBy(F.desc("score"), "query_id", "chunk_id")
    one = results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    over = Window.partitionBy("group_id").orderBy(F.desc("score"), "chunk_id")
    return one.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def overlap_scores(ranked: DataFrame, queries: DataFrame, content: str = "content") -> DataFrame:
    """Where no cross-encoder is at hand: 0.7 of the score plus 0.3 of the share of query words that the content holds."""
    words = F.filter(identifiers(F.col("text")), lambda t: F.char_length(t) > 1)
    q = queries.select("query_id", words.alias("_w"))
    out = ranked.join(q, "query_id")
    share = F.size(F.filter("_w", lambda t: F.contains(F.lower(F.col(content)), t))) / F.greatest(F.size("_w"), F.lit(1))
    out = out.withColumn("score", F.round(0.7 * F.col("score") + 0.3 * share, 9)).drop("_w", "rank")
    return rerank(out)
