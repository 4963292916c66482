"""SimHash near-duplicates found by BK-trees.

A text's fingerprint has bit i set if more than half of its shingle hashes have it set. Fingerprints link
at a Hamming distance of RADIUS or less; documents are grouped by the connected components of the links.

Distinct fingerprints are dealt to shards: the 64 bits are cut into m blocks, and two fingerprints that
differ in at most RADIUS bits agree on some m - RADIUS of the blocks, so a shard holds those that agree on
one such choice. m grows with the number of fingerprints so that shards stay small. Each shard builds a
BK-tree (children keyed by their distance to the parent) and searches it with all its members, following
only edges within RADIUS of the distance to the node. A shard emits a spanning forest of its links, never
all pairs. Shards above HOT members (a large group of near copies) are cut into chunks, and every pair of
chunks becomes a shard of its own. The trees are dealt by a shuffle, not broadcast: they grow with the
corpus and have no size bound.

Edge cases: null and empty texts and texts of white space have fingerprint 0 and link like any other.
Equal rows have equal fingerprints. Rows without an id take part, but a component's id is the smallest
id in it; null only if no member has an id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .components import components, join_hot
from .shared import stored

RADIUS = 4
WORDS = 4
SEED = 42
HOT = 4096
SHARD = 64
NO_ID = (1 << 63) - 1
#: Shingles hashed at a time, so that a very long text needs no list of all its hashes.
STRIDE = 1 << 16


def fingerprint(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's bytes; 0 without words."""
    ws = raw.lower().split()
    n = max(len(ws) - words + 1, 1)
    if not ws:
        return 0
    if len(ws) <= words:
        return xxhash.xxh64_intdigest(b" ".join(ws), seed)
    joined = memoryview(b" ".join(ws))
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[:n].tolist(), ends[words - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STRIDE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + STRIDE], ends[at : at + STRIDE])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """docs with the fingerprint of every whole text, as a signed 64-bit integer."""

    def scorer():
        def f(data, offsets, col):
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return [np.array(fps, np.uint64).view(np.int64)]

        return f

    return B.annotate(docs, text_col, [T.StructField(out, T.LongType())], scorer, keep)


class BKTree:
    """Nodes in insertion order; children of a node by their integer distance to it."""

    def __init__(self, fps: list[int]):
        self.fps, self.children = fps, [{} for _ in fps]
        for i in range(1, len(fps)):
            at = 0
            while True:
                d = (fps[i] ^ fps[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    break
                at = nxt

    def within(self, fp: int, radius: int) -> list[int]:
        """Numbers of the nodes at a distance of radius or less."""
        out, todo = [], [0] if self.fps else []
        while todo:
            at = todo.pop()
            d = (fp ^ self.fps[at]).bit_count()
            if d <= radius:
                out.append(at)
            todo.extend(c for e, c in self.children[at].items() if d - radius <= e <= d + radius)
        return out

    def batch(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within radius of it), all queries walking the tree together."""
        todo = [(0, np.arange(len(queries)))] if self.fps else []
        while todo:
            at, own = todo.pop()
            d = np.bitwise_count(queries[own] ^ np.uint64(self.fps[at])).astype(np.int64)
            if (near := own[d <= radius]).size:
                yield at, near
            for e, c in self.children[at].items():
                if (sub := own[np.abs(d - e) <= radius]).size:
                    todo.append((c, sub))


def forest(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints: (member, root)."""
    n, root = len(fps), list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree(fps)
    if n <= 128:
        pairs = ((i, j) for i in range(n) for j in tree.within(fps[i], radius) if j < i)
    else:
        pairs = ((at, int(j)) for at, near in tree.batch(np.array(fps, np.uint64), radius) for j in near.tolist())
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(fps[i], fps[find(i)]) for i in range(n) if find(i) != i]


def shard_keys(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (shift, bits) and the choices of blocks that shards agree on, for n distinct fingerprints."""
    m = next((m for m in range(RADIUS + 1, 9) if n <= SHARD * 2 ** (64 * (m - RADIUS) / m)), 8)
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)], list(itertools.combinations(range(m), m - RADIUS))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints in fps that connect all that are within RADIUS of each other."""
    n = fps.count()
    blocks, choices = shard_keys(n)
    part = lambda i: F.shiftrightunsigned("fp", blocks[i][0]).bitwiseAND(F.lit((1 << blocks[i][1]) - 1))
    keys = F.array(*(F.xxhash64(F.lit(k), *(part(i) for i in c)) for k, c in enumerate(choices)))
    members = fps.select("fp", F.explode(keys).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.where(F.col("n") > HOT).withColumn("chunks", F.ceil(F.col("n") / HOT).cast("int")), "hot-shards")
    if not hot.limit(1).count():
        return forests(members)
    # one in HOT of the members is a hot shard at most
    few = members.join(small_or_shuffled(hot.select("shard")), "shard", "left_anti")
    many = stored(members.join(small_or_shuffled(hot), "shard"), "hot-members")
    chunk = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    name = lambda i, j: F.xxhash64("shard", F.least(i, j), F.greatest(i, j))
    first = many.select("fp", F.explode(F.when(chunk == 0, F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: name(F.lit(0), j))).otherwise(F.array(name(F.lit(0), chunk)))).alias("shard"))
    found = stored(forests(few.unionByName(first)), "simhash-links")
    root = components(found).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = stored(many.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "hot-placed")
    largest = placed.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("shard").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    rest = stored(placed.join(small_or_shuffled(largest), "shard").where(F.col("root") != F.col("main")).select("shard", "fp", "chunks"), "hot-rest")
    ones = rest.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("ones"))
    left = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("ones")).cast("int")
    pair = lambda i, j: F.xxhash64("shard", F.lit("rest"), i, j)
    mine = rest.join(small_or_shuffled(ones), "shard").select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: pair(left, j))).alias("shard"))
    theirs = many.join(small_or_shuffled(ones), "shard").select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("ones") - 1), lambda i: pair(i, chunk))).alias("shard"))
    return found.unionByName(forests(mine.unionByName(theirs).distinct()))


def small_or_shuffled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if it has up to so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def forests(members: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links of each shard of members (fp, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.int64)
        out: list[tuple[int, int]] = []

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if key[a] == held_key:
                    held = np.concatenate((held, fp[a:b]))
                    continue
                if len(held) > 1:
                    out += forest(held.view(np.uint64).tolist())
                held_key, held = key[a], fp[a:b]
            if len(out) > 50_000:
                yield emit()
        if len(held) > 1:
            out += forest(held.view(np.uint64).tolist())
        yield emit()

    return members.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInArrow(run, "a long, b long")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row of docs."""
    sig = stored(fingerprints(docs.select(id_col, text_col), text_col, [id_col]), "simhash")
    rep = sig.groupBy("fp").agg(F.min(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).alias("rep"))
    rep = stored(rep, "simhash-distinct")
    root = components(links(rep.select("fp")))
    own = stored(rep.join(root.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    # only fingerprints with links can belong to another's component
    least = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = join_hot(own, least, "root").select("fp", "component_id")
    out = join_hot(sig, named, "fp").withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")))
    return out.select(id_col, "fp", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    got = group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
