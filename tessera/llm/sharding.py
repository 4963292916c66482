"""Proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash within their source; a row's fractional rank is its place there, plus an
offset of the source between 0 and 1, over the source's size. Sorted by fractional rank, every stretch of
the whole holds each source in proportion, so equal cuts give shards that match the mixture; their counts
differ by one at most (law `rows`).

No rank is computed over a whole source or over all rows: rows are dealt to buckets by the leading digits
of the hash (then of the fractional rank), ranked within a bucket, and lifted by the counts of the buckets
before it. So a source with a third of all rows is spread like any other.

Edge cases: rows without a source form a source of their own. Null texts have no bytes. Rows with equal
ids lie side by side in a defined order (by size and checksum). With fewer rows than shards some shards
are empty; an empty table gives an empty table. Equal texts are spread like any rows: with the law `rows` a
group of copies larger than a shard could not stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Rows a bucket is meant to hold, and the most buckets for a source and for all.
BUCKET_ROWS, MOST_BUCKETS, MOST_CUTS = 400, 4096, 1 << 16


def _leading(hexed):
    """The first 8 hexadecimal digits as a number below 2**32."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def interleave(rows: DataFrame, shards: int, seed: str = "interleave", id_col: str = "doc_id", source_col: str = "source", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with `_place` (0-based, over all), `shard` and `slot`."""
    n = rows.count()
    own = min(MOST_BUCKETS, -(-n // BUCKET_ROWS) or 1)
    cuts = min(MOST_CUTS, -(-n // BUCKET_ROWS) or 1)
    dealt = rows.withColumn("_from", F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("n")))
    dealt = dealt.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    dealt = dealt.withColumn("_bucket", F.shiftright(_leading("_hash") * own, 32))

    counts = dealt.groupBy("_from", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_source = Window.partitionBy("_from")
    before = counts.select(
        "_from", "_bucket", F.sum("_n").over(by_source).alias("_size"),
        (F.sum("_n").over(by_source.orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    within = Window.partitionBy("_from", "_bucket").orderBy("_hash", id_col, *ties)
    ranked = dealt.join(before, ["_from", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    shift = (_leading(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_from")))) + F.lit(0.5)) / F.lit(float(1 << 32))
    ranked = ranked.withColumn("_part", (F.col("_rank") + shift) / F.col("_size"))
    ranked = stored(ranked.withColumn("_cut", F.floor(F.col("_part") * F.lit(cuts))).drop("_bucket", "_before", "_size", "_rank"), "interleave")

    heads = ranked.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.select("_cut", (F.sum("_n").over(Window.orderBy("_cut")) - F.col("_n")).alias("_before"))
    along = Window.partitionBy("_cut").orderBy("_part", "_from", "_hash", id_col, *ties)
    placed = ranked.join(heads, "_cut").withColumn("_place", F.col("_before") + F.row_number().over(along) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(_place * {shards} div {max(n, 1)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"_place - (cast(shard as long) * {n} + {shards - 1}) div {shards}"))
    return placed.select(*rows.columns, "_place", "shard", "slot")


def op6(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """The contract's query."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = interleave(rows, shards, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: The same by plain windows. DuckDB has no CRC-32: it is worked out byte by byte.
OP6_SQL = """
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), raw AS (
  SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), base AS (
  SELECT doc_id, source, strlen(text) + 16 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS text_crc32,
    coalesce('s:' || source, 'n') AS f, md5('interleave:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM raw, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY h, doc_id, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY f) AS n, count(*) OVER () AS total,
    (CAST('0x' || substr(md5('interleave/' || f), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS shift
  FROM base
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + shift) / n::DOUBLE, f, h, doc_id, size, text_crc32) - 1 AS place FROM ranked
), cut AS (SELECT *, place * 40 // total AS s FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(s AS INT) AS shard,
  CAST(place - (s * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source
FROM cut
"""
