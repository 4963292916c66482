"""Exact nearest neighbours by cosine, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of one block: about 64 MB of 1,024-dimensional vectors. More queries are searched block by block.
BLOCK = 16_384
#: Vectors that meet a block's queries in one matrix product, and products of one such step.
ROWS, CELLS = 4_096, 1 << 22
GUARD = 1e-9


def _units(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of length one (the guard keeps zero vectors at zero); a missing vector, or one of another length, is zero."""
    out = np.zeros((len(col), dim))
    for i, v in enumerate(col.to_pylist()):
        if v is not None and len(v) == dim:
            out[i] = v
    return out


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    if not col.null_count and len(col.flatten()) == dim * len(col) and (np.diff(col.offsets.to_numpy()) == dim).all() and not col.flatten().null_count:
        return col.flatten().to_numpy().astype(np.float64).reshape(len(col), dim)
    return _units(col, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, match: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest vectors (chunk_id, embedding) of each query (query_id, embedding).

    The vectors stay where they are scanned; a block of queries is broadcast to them, distances are matrix
    products, and each step keeps its own k best of each query before anything is shuffled. `where` filters
    the vectors before that; `match` names columns of vectors which must equal the query's column
    `filter_<name>` where that isn't null. A null, empty or unlike-sized vector has similarity 0 to all.
    """
    spark = vectors.sparkSession
    vectors = vectors if where is None else vectors.where(where)
    q = queries.select("query_id", "embedding", *(F.col(f"filter_{c}").cast("string").alias(f"filter_{c}") for c in match))
    n = max(1, -(-queries.count() // BLOCK))
    v = vectors.select("chunk_id", "embedding", *(F.col(c).cast("string").alias(c) for c in match))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {v.schema['chunk_id'].dataType.simpleString()}, score double"
    out = None
    for i in range(n):
        block = q if n == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        held = spark.sparkContext.broadcast(block.toArrow().combine_chunks())
        part = v.mapInArrow(_searcher(held, k, match), schema)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = out.withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searcher(held, k: int, match: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        if not t.num_rows:
            return
        ids, dim = t.column("query_id").combine_chunks(), max((len(x) for x in t.column("embedding").to_pylist() if x is not None), default=0)
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.chunk(0)
        asked = _rows(pa.concat_arrays(t.column("embedding").chunks), dim)
        length = np.sqrt((asked * asked).sum(1))
        wanted = [np.array(t.column(f"filter_{c}").to_pylist(), object) for c in match]
        step = max(1, min(ROWS, CELLS // t.num_rows))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows = _rows(part.column(1), dim)
                score = (rows @ asked.T) / (np.sqrt((rows * rows).sum(1))[:, None] * length[None, :] + GUARD)
                for c, want in enumerate(wanted):
                    own = np.array(part.column(2 + c).to_pylist(), object)
                    score[(own[:, None] != want[None, :]) & np.array([x is not None for x in want])[None, :]] = -np.inf
                if len(rows) > k:
                    # all that may be among the k best after rounding
                    least = np.partition(score, len(rows) - k, axis=0)[len(rows) - k] - 2e-6
                    i, j = np.nonzero((score >= least[None, :]) & np.isfinite(score))
                else:
                    i, j = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(score[i, j])], names=["query_id", "chunk_id", "score"])

    return run


def embedded(df: DataFrame, text: Column, provider: Callable[[list[str]], list[list[float]]], dim: int, out: str = "embedding", batch: int = 10, most: int = 16_000) -> DataFrame:
    """df with the vectors that a provider gives for batches of texts, each cut at `most` characters.

    Where a batch fails its texts are asked for one by one; a text that fails, or gets a vector of another
    length, gets the zero vector. A null text counts as empty.
    """
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    asked = "_asked"
    while asked in df.columns:
        asked += "_"

    def vectors(texts: list[str]) -> list[list[float]]:
        try:
            got = [list(map(float, v)) for v in provider(texts)]
            if len(got) == len(texts) and all(len(v) == dim for v in got):
                return got
        except Exception:  # whatever a provider raises
            pass
        return [[0.0] * dim] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(asked)).to_pylist()
            got = [v for i in range(0, len(texts), batch) for v in vectors(texts[i : i + batch])]
            kept = [b.column(b.schema.get_field_index(f.name)) for f in schema if f.name != out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.list_(pa.float64()))], names=schema.names)

    cut = F.substring(F.coalesce(text, F.lit("")), 1, most)
    return df.withColumn(asked, cut).mapInArrow(run, schema)


def embed(df: DataFrame, text: Column, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Offline vectors where no model is at hand: signed hashed bags of tokens, the same for the same text, zero for an empty one."""
    from tessera.functions.text import tokens

    hashed = F.transform(tokens(text), lambda t: F.xxhash64(t))
    add = lambda acc, h: F.transform(acc, lambda x, i: x + F.when(i == F.pmod(h, F.lit(dim)).cast("int"), F.when(F.shiftrightunsigned(h, 63) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)))
    return df.withColumn(out, F.aggregate(hashed, F.array_repeat(F.lit(0.0), dim), add))
