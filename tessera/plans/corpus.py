"""How the tables at hand stand for chunks, queries, vectors and expected files, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import sparse


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Tables of up to so many bytes are dealt to all cores; a larger one is scanned by many tasks as it is.
DEAL_BYTES = 1 << 30


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, dealt to all cores where a small table has fewer parts than that (one small file is one part)."""
    df = table(spark, sf, "documents")
    n = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n, "doc_id") if size <= DEAL_BYTES and df.rdd.getNumPartitions() < n else df


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: a source is a repository, a source and language a file."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("file_path"),
        F.col("source").alias("repo_name"), F.col("source").alias("component_name"), F.col("lang").alias("language"),
        F.when(F.col("n_chars") < 1000, "function").when(F.col("n_chars") < 4000, "class").otherwise("mds_service").alias("chunk_type"),
    )


def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with files as small as files are: the texts of a source and language among 512 ids."""
    return chunks(spark, sf).withColumn("file_path", F.concat("repo_name", F.lit("/"), "language", F.lit("/"), F.expr("chunk_id div 512").cast("string"), F.lit(".txt")))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokenized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tokenized chunks (content, path and repository) and queries."""
    ch = chunks(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.tokens(F.col("text")).alias("tokens"))
    return sparse.tokenized(ch, sparse.document_text(ch)), asked


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id is divisible by 20 as the queries."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return v, v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, embedding): the stand-in vector of every item, as no model is at hand. Items take the query vectors in turn."""
    n = table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    items = queries(spark, sf).select("query_id").join(F.broadcast(n)).withColumn("vec_id", F.expr("query_id * 20 % n"))
    return items.join(table(spark, sf, "embeddings").where("vec_id % 20 = 0").select("vec_id", "embedding"), "vec_id").select("query_id", "embedding")


# ---------------------------------------------------------------- the same in SQL
def sql_tokens(x: str) -> str:
    """Tokens without lookahead, which this engine lacks; the same on these tables' texts."""
    return (
        rf"list_transform(list_filter(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), "
        r"'[A-Z]?[a-z]+|[A-Z]+[_À-ÖØ-öø-ɏ][\p{L}\p{N}_]*|[A-Z]+|[0-9]+'), lambda t: length(t) > 1), lambda t: lower(t))"
    )


SQL_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text AS content, source || '/' || lang || '.txt' AS file_path, source AS repo_name, source AS component_name, lang AS language,
    CASE WHEN n_chars < 1000 THEN 'function' WHEN n_chars < 4000 THEN 'class' ELSE 'mds_service' END AS chunk_type FROM documents)"""

SQL_TEXT = "concat_ws(' ', text, source || '/' || lang || '.txt', source, source)"
SQL_DOCS = f"docs AS (SELECT doc_id AS chunk_id, {sql_tokens(SQL_TEXT)} AS toks FROM documents)"
_POSTINGS = """, tok AS (SELECT chunk_id, unnest(toks) AS token FROM docs), post AS (SELECT chunk_id, token, count(*) AS tf FROM tok GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(len(toks)) / count(*)::DOUBLE AS avgdl FROM docs),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token), raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats),
terms AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""


SQL_POSTINGS = SQL_DOCS + _POSTINGS


def sql_bm25(k1: str = "1.5", b: str = "0.75", extra: str = "", docs: str = "documents") -> str:
    """CTEs up to scored (query_id, chunk_id, score)."""
    return f"""{SQL_DOCS.replace('FROM documents', 'FROM ' + docs)}{_POSTINGS}, asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, {extra and extra + ','} round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len(toks) / avgdl))), 6) AS score
  FROM asked JOIN terms USING (token) JOIN post USING (token) JOIN docs USING (chunk_id), stats{', params' if extra else ''} GROUP BY ALL)"""


SQL_BM25 = sql_bm25()


def sql_ranked(source: str, k: int, name: str, by: str = "query_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k})"


#: Scores of every item's vector, as dscored has those of every query vector.
SQL_ITEM_DENSE = """iv AS (SELECT item_id AS query_id, e.embedding AS q FROM benchmark JOIN embeddings e ON e.vec_id = item_id * 20 % (SELECT max(vec_id) + 1 FROM embeddings)),
dense0 AS (SELECT query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings v, iv)"""

SQL_DENSE = """dscored AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label, q.label AS query_label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)"""
