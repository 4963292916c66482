"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Everything here takes whole texts. Slices are cut between rows, never inside a text, so that the
working set follows `SLICE_BYTES` or the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024

#: Bytes of an Arrow batch that a task of `annotate` is sent, where the session sets no other size.
BATCH_BYTES = 4 << 20

#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 18

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: a-z, 0-9 and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True

#: The same without digits.
LETTER_BYTES = WORD_BYTES.copy()
LETTER_BYTES[48:58] = False

_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (one longer text stands alone) and `rows` rows."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


def pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice as it is, or, if it is one long text, parts of about SLICE_BYTES that no word (run of bytes of `table`) crosses."""
    n, at = len(data), 0
    if n <= 2 * SLICE_BYTES or len(offsets) != 2:
        yield data, offsets
        return
    while at < n:
        to = min(at + SLICE_BYTES, n)
        while to < n:
            gap = np.flatnonzero(~table[LOWER[data[to : to + 4096]]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + 4096, n)
        yield data[at:to], np.array([0, to - at])
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes of `table`, never across rows) and the first word of each row (n + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes, wherever they stand.

    Spans are sorted by start. They are worked on in blocks, so that the working set follows HASH_BYTES; a
    span beyond that length is named by XXH3.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    far = ends - starts > HASH_BYTES
    for i in np.flatnonzero(far).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    near = np.flatnonzero(~far) if far.any() else None
    begin, end = (starts, ends) if near is None else (starts[near], ends[near])
    while at < len(begin):
        to = int(np.searchsorted(begin, begin[at] + HASH_BYTES))
        got = _span_hashes(data[begin[at] : end[at:to].max()], begin[at:to] - begin[at], end[at:to] - begin[at])
        out[slice(at, to) if near is None else near[at:to]] = got
        at = to
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(_MULT, 2 * HASH_BYTES + 1), powers(_INV, 2 * HASH_BYTES + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    # a zero byte counts too
    np.multiply(data.astype(np.uint64) + np.uint64(1), up[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours of h, len(h) - k + 1 of them (rows are the caller's matter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    for i in range(k):
        out = out * odd + h[i : i + n]
    return mix(out)


def annotate(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    scorer: Callable[[], Callable[[np.ndarray, np.ndarray, pa.Array], list]],
    keep: list[str] | None = None,
    own: str = "",
) -> DataFrame:
    """df's columns (or those of `keep`) and the new `fields`, one output row for each input row.

    scorer() is called once a task and gives f(bytes, offsets, column), which returns one array for
    each field. A new field replaces an input column of the same name. `own` names what the scorer keeps between
    tasks (see `keeping`), if anything.
    """

    def grouped():
        f = scorer()
        return lambda parts: [f(*p) for p in parts]

    return annotate_groups(df, text_col, fields, grouped, keep, own=own)


def annotate_groups(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    scorer: Callable[[], Callable[[list[tuple[np.ndarray, np.ndarray, pa.Array]]], list[list]]],
    keep: list[str] | None = None,
    group_bytes: int = 0,
    own: str = "",
) -> DataFrame:
    """The same for slices together: scorer() gives f(list of slices), called when they have `group_bytes` or more, with a result for each."""
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(own)
        f = scorer()
        parts, rows, size = [], [], 0

        def close() -> list[pa.RecordBatch]:
            out = [pa.RecordBatch.from_arrays(cols + [x if isinstance(x, pa.Array) else pa.array(x) for x in got], names=kept + [f.name for f in fields]) for cols, got in zip(rows, f(parts))]
            parts.clear()
            rows.clear()
            return out

        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = column_bytes(col)
            for a, b in slices(offsets):
                parts.append((data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], col.slice(a, b - a)))
                rows.append([batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in kept])
                size += len(parts[-1][0])
                if size >= group_bytes:
                    yield from close()
                    size = 0
            del batch, col, data, offsets  # else they stay until the next batch has come
        if parts:
            yield from close()
        give_back()

    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def small_batches(spark) -> None:
    """Has Arrow batches end at BATCH_BYTES instead of Spark's 64 MB, which JVM and worker both hold; a session's own choice stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: What drops the memory that operators keep in this worker between their tasks, by name.
_kept: dict[str, Callable[[], None]] = {}


def keeping(own: str, drop: Callable[[], None]) -> None:
    """Says that this worker keeps something between tasks, and what drops it."""
    _kept[own] = drop


def take_over(own: str = "") -> None:
    """A task begins: what other operators than its own keep in this worker goes, as Spark hands workers from stage to stage."""
    others = [name for name in _kept if name != own]
    for name in others:
        _kept.pop(name)()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns what this worker's allocators hold unused, as it stays for other tasks while others need the memory."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, id_col: str, label_col: str, per_label: int, seed: int, most_labels: int = 512, most_rows: int = 24_000) -> DataFrame:
    """About `per_label` rows of each label, or `most_rows` in all if that is less, taken by a hash of the id: all rows of a label that has fewer.

    The `most_labels` most frequent labels take part, so that neither the counts nor the sample grow with the
    number of distinct labels. The counts are one partial aggregation over a narrow column; the choice is a
    filter against those few rows, not a shuffle.
    """
    n = free(df, "_n")
    labels = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias(n)).orderBy(F.desc(n), label_col).limit(most_labels)
    every = F.count(F.lit(1)).over(Window.partitionBy())
    own = F.least(F.lit(per_label), F.greatest(F.lit(1), F.floor(F.lit(most_rows) / every)))
    shares = labels.select(label_col, F.least(F.lit(1.0), own / F.col(n)).alias(n))
    dice = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(F.broadcast(shares), label_col).where(dice < F.col(n)).select(*df.columns)
