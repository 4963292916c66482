"""Benchmark decontamination by winnowing.

Words are runs of letters a-z (after lower-casing A-Z), digits and characters beyond ASCII. Of every
window of WINDOW consecutive words the least hash of its K-word grams is kept, on both sides, so that two
texts which share WINDOW or more consecutive words always share a fingerprint. Fingerprint hits are then
extended to whole windows, and each word inside a window that an item has too is hit. An item of fewer
words than WINDOW is one window as a whole, looked up by its own length.

The items are the stated side: their index is read in blocks of at most BLOCK_WORDS words (some 40 bytes
each), against which all documents are held where they are scanned. No document is shuffled, however many
share a passage. A single block is broadcast; more blocks are built by executors, lie in the shared folder and
are read in turn, each once for GROUP_BYTES of texts.

Edge cases: null and empty texts have no words, no hits and no items; an item without words or id matches
nothing; repeated items count once by id; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .shared import scratch

WINDOW = 10
K = 5
BLOCK_WORDS = 1_000_000
GROUP_BYTES = 32 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each row."""
    low = B.LOWER[data]
    starts, ends, first = B.words(low, offsets)
    return B.span_hashes(low, starts, ends), first


def inside(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions from which `size` words lie in one row."""
    if n < size:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero(row[: n - size + 1] == row[size - 1 :])


def least_grams(h: np.ndarray) -> np.ndarray:
    """For each window of WINDOW words (wherever rows end) the least hash of its K-word grams."""
    g = B.grams(h, K)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for i in range(1, WINDOW - K + 1):
        np.minimum(out, g[i : i + n], out=out)
    return out


@dataclass
class Block:
    """Sorted winnowed fingerprints; windows by length as sorted hashes with their items (from, to into `items`)."""

    prints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]
    items: dict[int, np.ndarray]
    names: np.ndarray

    @staticmethod
    def build(ids: list, col: pa.Array) -> Block:
        h, first = words_of(*B.column_bytes(col))
        size, own = np.diff(first), {}
        names, number = np.unique(np.array([str(i) for i in ids], dtype=object), return_inverse=True) if len(ids) else (np.zeros(0, object), np.zeros(0, int))
        row = np.repeat(np.arange(len(size)), size)
        full = inside(first, len(h), WINDOW)
        prints = np.unique(least_grams(h)[full])
        own[WINDOW] = B.grams(h, WINDOW)[full], number[row[full]]
        for n in sorted(set(size[(size > 0) & (size < WINDOW)].tolist())):
            at = first[:-1][size == n]
            own[n] = B.grams(h, n)[at], number[row[at]]
        windows, items = {}, {}
        for n, (key, item) in own.items():
            if len(key):
                order = np.lexsort((item, key))
                key, item = key[order], item[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
                key, item = key[new], item[new]
                keys, at = np.unique(key, return_index=True)
                windows[n], items[n] = (keys, np.append(at, len(key))), item
        return Block(prints, windows, items, names)

    def match(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items' names by row."""
        hit, found = np.zeros(len(h) + 1, np.int64), {}
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, (keys, at) in self.windows.items():
            pos = inside(first, len(h), n)
            if not len(pos):
                continue
            if n == WINDOW:
                m = least_grams(h)
                new = np.ones(len(m), bool)
                new[1:] = m[1:] != m[:-1]
                seen = _has(self.prints, m[new])[np.cumsum(new) - 1]
                pos = pos[seen[pos]]
            spans = np.zeros(len(pos), np.uint64)
            odd = np.uint64(0xD6E8FEB86659FD93)
            for i in range(n):
                spans = spans * odd + h[pos + i]
            spans = B.mix(spans)
            where = np.minimum(np.searchsorted(keys, spans), len(keys) - 1)
            ok = keys[where] == spans
            pos, where = pos[ok], where[ok]
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + n, -1)
            if len(pos):
                pair = np.unique(np.column_stack((row[pos], where)), axis=0)
                for r, w in pair.tolist():
                    found.setdefault(r, set()).update(self.names[self.items[n][at[w] : at[w + 1]]].tolist())
        return np.cumsum(hit)[:-1] > 0, found


def _has(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


class Blocks:
    """The blocks of an index, to be read on executors: one that was broadcast, or files in the shared folder."""

    def __init__(self, shared=None, where: str = "", paths: list[str] | None = None):
        self.shared, self.where, self.paths = shared, where, paths or []
        #: Texts of so many bytes meet a block together, so that a task reads a block once for them.
        self.group_bytes = 0 if shared is not None else GROUP_BYTES

    def __iter__(self) -> Iterator[Block]:
        if self.shared is not None:
            yield self.shared.value
            return
        fs, _ = pafs.FileSystem.from_uri(self.where)
        for path in self.paths:
            with fs.open_input_stream(path) as f:
                yield np.load(io.BytesIO(f.read()), allow_pickle=True)[0]


def index(spark, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Blocks:
    """The items' index. A single block is built here; more are built by executors, one task at a time each."""
    items = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 6 / BLOCK_WORDS))
    built = lambda t: Block.build(t.column("id").to_pylist(), t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
    if n == 1:
        return Blocks(spark.sparkContext.broadcast(built(items.toArrow())))
    where = scratch(spark, "winnowing")

    def write(t: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        path, buf = f"{root}/{uuid.uuid4().hex}.npy", io.BytesIO()
        np.save(buf, np.array([built(t)], dtype=object), allow_pickle=True)
        with fs.open_output_stream(path) as f:
            f.write(buf.getvalue())
        return pa.table({"path": [path]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    return Blocks(None, where, sorted(r.path for r in dealt.groupBy("block").applyInArrow(write, "path string").collect()))


def _matched(docs: DataFrame, blocks: Blocks, text_col: str, fields: list[T.StructField], result, keep: list[str] | None) -> DataFrame:
    """docs with result(first word of each row, hit words before each word, items by row) of every whole text."""

    def scorer():
        def f(parts):
            known = [words_of(data, offsets) for data, offsets, _ in parts]
            hits, found = [np.zeros(len(h), bool) for h, _ in known], [{} for _ in known]
            for b in blocks:
                for (h, first), hit, items in zip(known, hits, found):
                    more, names = b.match(h, first)
                    hit |= more
                    for r, s in names.items():
                        items.setdefault(r, set()).update(s)
            return [result(first, np.concatenate(([0], np.cumsum(hit))), items) for (_, first), hit, items in zip(known, hits, found)]

        return f

    return B.annotate_groups(docs, text_col, fields, scorer, keep, blocks.group_bytes)


def scan(docs: DataFrame, blocks: Blocks, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted names), of every whole text."""

    def result(first, total, found):
        items = [sorted(found.get(r, ())) for r in range(len(first) - 1)]
        return [np.diff(first), total[first[1:]] - total[first[:-1]], np.array([len(x) for x in items], np.int64), pa.array(items, pa.list_(pa.string()))]

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")] + [T.StructField("items", T.ArrayType(T.StringType()))]
    return _matched(docs, blocks, text_col, fields, result, keep)


def digest(names: list[str]) -> str:
    """What items_sha256 holds for these names."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    blocks = index(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), blocks, keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the rows of docs that share a window with a benchmark item.

    Null, empty and wordless texts share nothing and stay; repeated rows stay or go together, ids don't matter.
    Items without words or id match nothing, so an empty benchmark keeps every row. An empty table stays empty.
    Columns of any name pass through.
    """
    blocks = index(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    leaked = B.free(docs, "_leaked")
    marked = _matched(docs, blocks, "text", [T.StructField(leaked, T.BooleanType())], lambda first, total, found: [total[first[1:]] > total[first[:-1]]], None)
    return marked.where(~F.col(leaked)).select(*docs.columns)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM items
), spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (SELECT s.doc_id, s.i, s.n, items.item_id FROM spots s JOIN items ON items.n = s.n AND items.g = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')
), places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
