"""Okapi BM25 as relations: postings, term statistics, scores and ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.config import Bm25Config
from tessera.functions.text import tokens
from tessera.sources.scratch import small, stored

#: Query-term rows up to so many are broadcast; more are joined by a shuffle on the token.
BROADCAST_TERMS = 500_000
#: Weights of queries by tokens that are held as one matrix (128 MB).
CELLS = 1 << 24


def document_text(chunks: DataFrame) -> Column:
    """What a chunk is indexed by: content, path, repository twice, symbols; for services also dependencies, interfaces and name."""
    have = set(chunks.columns)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    names = F.array_join(F.transform("symbols", lambda s: s["name"]), " ") if "symbols" in have else F.lit("")
    text = F.concat_ws(" ", part("content"), part("file_path"), part("repo_name"), part("repo_name"), names)
    if not {"chunk_type", "dependencies", "required_interfaces"} <= have:
        return text
    more = F.concat_ws(" ", F.array_join("dependencies", " "), F.array_join("required_interfaces", " "), part("service_name"))
    return F.when(F.col("chunk_type") == "mds_service", F.concat_ws(" ", text, more)).otherwise(text)


def tokenized(chunks: DataFrame, text: Column, id_col: str = "chunk_id") -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), tokens(text).alias("tokens"))


def each(tokens: Column) -> Column:
    """A row for each token, and one without for an empty list. A plain explode would filter by the list's size first, and so tokenize twice."""
    return F.explode_outer(tokens)


def postings(docs: DataFrame) -> DataFrame:
    """(chunk_id, token, tf) of tokenized chunks."""
    return docs.select("chunk_id", each(F.col("tokens")).alias("token")).where("token is not null").groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def term_rows(docs: DataFrame) -> DataFrame:
    """(token, df, dl): each token's document frequency; the row without a token has the number and total length of the documents.

    One pass and one shuffle of partial sums give both.
    """
    rows = docs.select(each(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("token"), F.size("tokens").alias("n"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("n"))).alias("dl"))


def statistics(docs: DataFrame, config: Bm25Config = Bm25Config()) -> tuple[DataFrame, DataFrame]:
    """Term rows and corpus statistics of tokenized chunks, worked out once: both are written, as each is read several times."""
    terms = stored(term_rows(docs), "bm25-terms")
    return terms, stored(corpus_stats(terms, config), "bm25-corpus")


def _plain_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_stats(terms: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """One row: n, avgdl, and the floor that negative inverse frequencies take (a share of their mean over the vocabulary)."""
    size = terms.where("token is null").agg(F.max("df").alias("n"), F.max("dl").alias("total"))
    mean = terms.where("token is not null").join(F.broadcast(size)).agg(F.avg(_plain_idf(F.col("n"), F.col("df"))).alias("mean_idf"))
    return size.join(F.broadcast(mean)).select("n", (F.col("total") / F.col("n")).alias("avgdl"), (F.lit(config.epsilon) * F.col("mean_idf")).alias("floor"))


def term_stats(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf)."""
    raw = _plain_idf(F.col("n"), F.col("df"))
    return terms.where("token is not null").join(F.broadcast(stats)).select("token", "df", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: Column | float, b: Column | float) -> Column:
    k1, b = (x if isinstance(x, Column) else F.lit(x) for x in (k1, b))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def matches(docs: DataFrame, queries: DataFrame, config: Bm25Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (chunk_id, term, tf, dl) of the tokens that some query has, dealt by chunk; weights (query_id, term, weight); corpus statistics.

    Tokens go by numbers, so that a match is a few of them.
    """
    asked = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    terms, stats = statistics(docs, config)
    hint = small(asked, BROADCAST_TERMS)
    vocabulary = stored(term_stats(terms.join(hint(asked.select("token").distinct()), "token", "left_semi"), stats).withColumn("term", F.xxhash64("token")), "bm25-vocabulary")
    weighted = asked.join(vocabulary, "token").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    found = docs.select("chunk_id", F.size("tokens").alias("dl"), each(F.col("tokens")).alias("token")).join(hint(vocabulary.select("token", "term")), "token").select("chunk_id", "dl", "term")
    tf = found.repartition("chunk_id").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    return tf, hint(weighted), stats


def scores(docs: DataFrame, queries: DataFrame, config: Bm25Config = Bm25Config(), params: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of tokenized chunks for tokenized queries (query_id, tokens).

    The chunks are tokenized twice: once for the statistics, which are written, and once for the matches. Only
    tokens that some query has leave the scan. They are dealt by chunk, where term counts, scores of a chunk
    for a query, and any top-k that follows are formed without another shuffle of the matches. params (k1, b)
    scores every combination in one job.
    """
    tf, weighted, stats = matches(docs, queries, config)
    hits = tf.join(weighted, "term").join(F.broadcast(stats.select("avgdl")))
    keys = ["chunk_id", "query_id"]
    k1, b = F.lit(config.k1), F.lit(config.b)
    if params is not None:
        hits, keys, k1, b = hits.join(F.broadcast(params)), [*keys, "k1", "b"], F.col("k1"), F.col("b")
    gain = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    out = hits.groupBy(*keys).agg(F.round(F.sum(gain), 6).alias("score")).select("query_id", *[c for c in keys if c != "query_id"], "score")
    if config.pad_zero and params is None:
        every = docs.select("chunk_id").join(F.broadcast(queries.select("query_id").distinct()))
        out = every.join(out, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return out


def grid(docs: DataFrame, queries: DataFrame, params: list[tuple[float, float]], k: int, config: Bm25Config = Bm25Config()) -> DataFrame:
    """(k1, b, query_id, chunk_id, score, rank): the k best chunks of each query for every pair of parameters.

    A chunk's scores for all queries and pairs are one matrix product, weights by saturations, and a task
    keeps only the k best of each: no row is made for a score that isn't among them. Queries are scored in
    blocks whose weights have up to CELLS cells.
    """
    spark = docs.sparkSession
    tf, weighted, stats = matches(docs, queries, config)
    weighted = stored(weighted, "bm25-weights")
    avgdl = stats.first()["avgdl"] or 1.0
    size = weighted.agg(F.countDistinct("query_id"), F.countDistinct("term")).first()
    n = max(1, -(-size[0] * size[1] // CELLS))
    tf = tf.sortWithinPartitions("chunk_id").select("chunk_id", "term", "tf", "dl")
    schema = f"k1 double, b double, query_id {weighted.schema['query_id'].dataType.simpleString()}, chunk_id {tf.schema['chunk_id'].dataType.simpleString()}, score double"
    kinds = [to_arrow_type(weighted.schema["query_id"].dataType), to_arrow_type(tf.schema["chunk_id"].dataType)]
    out = None
    for i in range(n):
        t = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow()
        names, row = np.unique(np.array(t.column("query_id").to_pylist()), return_inverse=True) if t.num_rows else (np.zeros(0), np.zeros(0, int))
        terms, col = np.unique(t.column("term").to_numpy(), return_inverse=True)
        weight, has = np.zeros((len(names), len(terms))), np.zeros((len(names), len(terms)), bool)
        weight[row, col], has[row, col] = t.column("weight").to_numpy(), True
        part = tf.mapInArrow(_grid_task(spark.sparkContext.broadcast((names.tolist(), terms, weight, has)), np.array(params, float).reshape(-1, 2), avgdl, k, kinds), schema)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, by=("k1", "b", "query_id"))


def _grid_task(held, params: np.ndarray, avgdl: float, k: int, kinds: list[pa.DataType]):
    k1, b = params[:, 0], params[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, weight, has = held.value
        best = np.full((len(names), len(params), k), -np.inf)
        ids = np.empty(best.shape, object)

        def score(chunk, term: np.ndarray, tf: np.ndarray, dl: float) -> None:
            at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
            own = terms[at] == term if len(terms) else np.zeros(len(term), bool)
            at, tf = at[own], tf[own][:, None].astype(float)
            some = np.flatnonzero(has[:, at].any(1))
            got = np.round(weight[np.ix_(some, at)] @ (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6)
            # chunks come in order, so that of equal scores the smaller chunk stays before
            q, p = np.nonzero(got > best[some, :, -1])
            cell = some[q], p
            rows = np.column_stack((best[cell], got[q, p]))
            new = np.empty(len(q), object)
            new[:] = [chunk] * len(q)
            order = np.argsort(-rows, axis=1, kind="stable")[:, :k]
            best[cell] = np.take_along_axis(rows, order, 1)
            ids[cell] = np.take_along_axis(np.column_stack((ids[cell], new)), order, 1)

        chunk, parts = None, []

        def close() -> None:
            if parts:
                score(chunk, np.concatenate([x for x, _, _ in parts]), np.concatenate([x for _, x, _ in parts]), parts[0][2])
                parts.clear()

        for batch in batches:
            own, term, tf, dl = batch.column(0).to_pylist(), *(batch.column(j).to_numpy() for j in (1, 2, 3))
            start = 0
            while start < len(own):
                end = start + 1
                while end < len(own) and own[end] == own[start]:
                    end += 1
                if own[start] != chunk:
                    close()
                    chunk = own[start]
                parts.append((term[start:end], tf[start:end], float(dl[start])))
                start = end
        close()
        q, p, r = np.nonzero(np.isfinite(best))
        columns = [pa.array(k1[p]), pa.array(b[p]), pa.array([names[x] for x in q.tolist()], kinds[0]), pa.array(ids[q, p, r].tolist(), kinds[1]), pa.array(best[q, p, r])]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "b", "query_id", "chunk_id", "score"])

    return run


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def indexed_scores(posted: DataFrame, terms: DataFrame, stats: DataFrame, queries: DataFrame, config: Bm25Config = Bm25Config(), buckets: int = 0) -> DataFrame:
    """The same scores from stored tables: postings (chunk_id, token, tf, dl, bucket), term and corpus statistics.

    Only the buckets of tokens that some query has are read: they are partitions of the stored postings.
    """
    asked = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    if buckets:
        wanted = [r[0] for r in asked.select(bucket(F.col("token"), buckets)).distinct().collect()]
        posted = posted.where(F.col("bucket").isin(wanted))
    hint = small(asked, BROADCAST_TERMS)
    weighted = hint(asked).join(terms, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    hits = posted.join(hint(weighted), "token").join(F.broadcast(stats.select("avgdl")))
    gain = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), config.k1, config.b)
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(gain), 6).alias("score"))


def ranked(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), source: str | None = None) -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller chunk."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("source", F.lit(source)) if source else out
