"""Near-duplicates by SimHash over five-word shingles: operator 4 for the pipeline, at a similarity of 0.8 or more.

Two documents link if the Jaccard similarity of their sets of WORDS-word shingles is LEAST or more; one
document of each connected component stays. Words are runs of other bytes than white space, ASCII letters
in lower case; a text of fewer words is one shingle.

At 0.8 two 64-bit SimHash fingerprints differ in some 10 bits, which no choice of blocks of those bits can deal
to shards. So shards are dealt by another sketch of the same sets: BANDS bands of ROWS minima of hashed
shingles each, over whole texts. Two sets of similarity s miss all bands with a chance of (1 - s ** ROWS) **
BANDS, 3e-6 at 0.8 and less above it. Each shard builds a BK-tree of its members' fingerprints and searches
it with all of them at RADIUS bits, which a pair at 0.8 exceeds with a chance of about 1e-7 (3e-5 for sets of
a handful of shingles). Every pair that the tree gives and that isn't connected yet is compared by the exact
similarity of the two sets, so a candidate that isn't similar never links. Equal sets are one member; shards
of the same members are one shard. A shard emits a spanning forest of its links, never all pairs.

Shards above HOT members are hot. Their members first meet one of them, the pivot: by a join that needs no
task to hold a shard. What is similar to the pivot is connected to it, so only members that aren't must meet
the others: those and all are cut into chunks, and each chunk of the ones meets each of the others.

Edge cases: texts without words (null, empty, white space) are copies of each other. Rows without an id take
part and stay only if no member of their component has an id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .components import components, join_hot
from .shared import stored
from .simhash import NO_ID, BKTree

WORDS = 5
#: The least similarity, as a fraction of whole numbers so that comparisons are exact.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
RADIUS = 24
HOT = 1024
#: Bytes of words; the rest is what bytes.split() splits at.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, one row after another, and where each row's begin (n + 1)."""
    low = B.LOWER[data]
    starts, ends, first = B.words(low, offsets, SOLID)
    h, n = B.span_hashes(low, starts, ends), np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    g = B.grams(h, WORDS)
    whole = of[: len(g)] == of[len(of) - len(g) :]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    row = np.concatenate((of[: len(g)][whole], few))
    g = np.concatenate([g[whole], *(B.grams(h[first[r] : first[r + 1]], int(n[r])) for r in few)])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def set_ids(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set; 0 for an empty one."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = B.mix(np.add.reduceat(B.mix(g ^ _ODD), first[some]) + np.diff(first)[some].astype(np.uint64))
    return out.view(np.int64)


def band_keys(g: np.ndarray, first: np.ndarray) -> pa.Array:
    """The keys of each row's bands; none for an empty set."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    keys = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        product = np.empty_like(g)
        for i, a in enumerate(FACTORS):
            np.multiply(g, a, out=product)
            keys[:, i // ROWS] = keys[:, i // ROWS] * _ODD + np.minimum.reduceat(product, first[some])
        keys = B.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)
    ends = np.concatenate(([0], np.cumsum((size > 0) * BANDS))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set_id, bands) of every row."""

    def scorer():
        def f(data, offsets, col):
            g, first = shingles(data, offsets)
            return [set_ids(g, first), band_keys(g, first)]

        return f

    return B.annotate(docs, text_col, [T.StructField("set_id", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))], scorer, [id_col])


def sets(docs: DataFrame, text_col: str) -> DataFrame:
    """(set_id, grams): the whole set of every row, eight bytes a shingle."""

    def scorer():
        def f(data, offsets, col):
            g, first = shingles(data, offsets)
            return [set_ids(g, first), pa.array([g[a:b].tobytes() for a, b in itertools.pairwise(first.tolist())], pa.binary())]

        return f

    return B.annotate(docs, text_col, [T.StructField("set_id", T.LongType()), T.StructField("grams", T.BinaryType())], scorer, [])


def prints(own: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints of sets of hashes: bit i is set if more than half of the hashes have it set."""
    out = np.zeros(len(own), np.uint64)
    for i, x in enumerate(own):
        if len(x):
            ones = np.unpackbits(B.mix(x ^ _ODD).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0)
            out[i] = np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0]
    return out


def alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of some sets (sorted, without repeats) is similar to one."""
    up, down = LEAST
    size = np.array([len(x) for x in others], np.int64)
    flat = np.concatenate([*others, one[:0]])
    if not len(one) or not len(flat):
        return (size == 0) & (len(one) == 0)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(size)))])
    return (up + down) * common >= up * (size + len(one))


def forest(own: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct sets (sorted, without repeats): (member, root) by number."""
    fps, of = np.unique(prints(own), return_inverse=True)
    order = np.argsort(of, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(of))[:-1])
    label, (up, down) = np.arange(len(own)), LEAST
    size = np.array([len(x) for x in own], np.int64)
    for at, near in BKTree(fps.tolist()).batch(fps, RADIUS):
        met = np.concatenate([members[j] for j in near[near >= at].tolist()])
        for i in members[at].tolist():
            # sets of very unlike sizes can't be similar
            to = met[(label[met] != label[i]) & (down * np.minimum(size[met], size[i]) >= up * np.maximum(size[met], size[i]))]
            if len(to) and len(to := to[alike(own[i], [own[j] for j in to.tolist()])]):
                joined = np.unique(np.append(label[to], label[i]))
                label[np.isin(label, joined)] = joined[0]
    return [(i, int(x)) for i, x in enumerate(label) if i != x]


def held(docs: DataFrame, distinct: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set_id, grams) of the wanted sets, each from the document that stands for it."""
    reps = distinct.join(wanted, "set_id", "left_semi").select("rep").distinct()
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return sets(docs.join(reps, ident == F.col("rep"), "left_semi").select(text_col), text_col)


def to_pivot(hot: DataFrame, own: DataFrame) -> DataFrame:
    """(shard, set_id, n, pivot, linked): members of hot shards (shard, set_id, n), whether they are similar to their shard's pivot."""
    pivots = hot.groupBy("shard").agg(F.min("set_id").alias("pivot"))
    pivots = pivots.join(own.select(F.col("set_id").alias("pivot"), F.col("grams").alias("pivot_grams")).dropDuplicates(["pivot"]), "pivot")
    rows = hot.join(own.dropDuplicates(["set_id"]), "set_id").join(pivots, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.take_over()
        for batch in batches:
            linked = [bool(alike(np.frombuffer(p.as_py(), np.uint64), [np.frombuffer(g.as_py(), np.uint64)])[0]) for g, p in zip(batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked, pa.bool_())], names=["shard", "set_id", "n", "pivot", "linked"])

    return rows.select("shard", "set_id", "n", "pivot", "grams", "pivot_grams").mapInArrow(run, "shard long, set_id long, n long, pivot long, linked boolean")


def links(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a spanning forest, for each shard, of the links between the sets of distinct (set_id, rep, bands)."""
    every = distinct.select("set_id", F.explode("bands").alias("shard"))
    sizes = every.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("set_id").alias("x"), F.bit_xor(F.xxhash64("set_id")).alias("y"))
    shards = stored(sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("shard").alias("shard")).select("shard", "n"), "near-shards")
    members = stored(every.join(shards, "shard").select("shard", "set_id", "n"), "near-members")
    dealt, found = members.where(F.col("n") <= HOT).select("shard", "set_id"), None
    if shards.where(F.col("n") > HOT).limit(1).count():
        hot = members.where(F.col("n") > HOT)
        met = stored(to_pivot(hot, held(docs, distinct, hot.select("set_id").distinct(), id_col, text_col)), "near-pivots")
        found = met.where("linked and set_id <> pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
        rest = met.where("not linked")
        ones = rest.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("ones"))
        others = F.ceil(F.col("n") / HOT).cast("int")
        chunk = lambda seed, n: F.pmod(F.xxhash64("set_id", F.lit(seed)), n).cast("int")
        name = lambda i, j: F.xxhash64("shard", i, j)
        mine = rest.join(ones, "shard").select(F.explode(F.transform(F.sequence(F.lit(0), others - 1), lambda j: name(chunk(1, F.col("ones")), j))).alias("shard"), "set_id")
        theirs = met.join(ones, "shard").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("ones") - 1), lambda i: name(i, chunk(2, others)))).alias("shard"), "set_id")
        dealt = stored(dealt.unionByName(mine).unionByName(theirs), "near-dealt")
    own = held(docs, distinct, dealt.select("set_id").distinct(), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.take_over()
        key, ids, its = None, [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                out.extend((ids[i], ids[j]) for i, j in forest(its))
            ids.clear()
            its.clear()

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for shard, set_id, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if shard != key:
                    close()
                    key = shard
                # rows that repeat an id may bring a set twice, and a set may stand on both sides of a chunk pair
                if not ids or ids[-1] != set_id:
                    ids.append(set_id)
                    its.append(np.frombuffer(grams.as_py(), np.uint64))
            if len(out) > 50_000:
                yield emit()
        close()
        yield emit()

    dealt = dealt.join(own, "set_id").select("shard", "set_id", "grams").repartition("shard").sortWithinPartitions("shard", "set_id")
    out = dealt.mapInArrow(run, "a long, b long")
    return out if found is None else out.unionByName(found)


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, set_id, component_id) of every row of docs; a component's id is the smallest id in it."""
    sig = stored(signatures(docs, id_col, text_col), "near-signatures")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    distinct = stored(sig.groupBy("set_id").agg(F.min(ident).alias("rep"), F.any_value("bands").alias("bands")), "near-distinct")
    root = components(links(docs, distinct, id_col, text_col))
    own = distinct.select("set_id", "rep").join(root.select(F.col("a").alias("set_id"), F.col("b").alias("root")), "set_id", "left")
    own = stored(own.select("set_id", "rep", F.coalesce("root", "set_id").alias("root")), "near-roots")
    named = join_hot(own, own.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("set_id", "component_id")
    out = join_hot(sig.select(id_col, "set_id"), named, "set_id").withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")))
    return out.select(id_col, "set_id", "component_id")


def keep_one(spark, docs: DataFrame, sf_dir: str, most_broadcast: int = 2_000_000) -> DataFrame:
    """Pipeline stage: keeps of each component the row with the smallest id (one of them, if rows repeat it).

    All texts without words (null, empty, blank) are one component. A row without an id stays only if no
    member of its component has one, and then one such row does. An empty table stays empty. Columns of any
    name pass through.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    key, times = B.free(docs, "_id"), B.free(docs, "_n")
    got = group(docs.select("doc_id", "text"))
    kept = got.where(F.coalesce("component_id", F.lit(NO_ID)) == ident).groupBy(ident.alias(key)).agg(F.count(F.lit(1)).alias(times))
    kept = stored(kept, "near-kept")
    n = kept.count()
    hint = F.broadcast if n <= most_broadcast else lambda x: x
    alone = docs.join(hint(kept.where(F.col(times) == 1)), ident == F.col(key), "left_semi")
    if not kept.where(F.col(times) > 1).limit(1).count():
        return alone
    again = docs.join(kept.where(F.col(times) > 1), ident == F.col(key), "left_semi")
    return alone.unionByName(again.withColumn(key, ident).dropDuplicates([key]).select(*docs.columns))
