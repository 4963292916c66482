"""Token-id files: one wavelet matrix a shard.

Documents are put in ascending id order, encoded whole, and written as shards of about SHARD_TOKENS ids.
A shard's file holds its documents' ids and lengths, the shard's alphabet (ids by falling frequency) and
one bit-plane for each bit of the alphabet's numbers, with running counts for rank and select. From one
file a token can be read, occurrences of an id counted in any range, and its k-th place found.

File, version 2: the bytes TWM2, a 4-byte little-endian length, a JSON header, then the sections that the
header names by offset and lengths of their blocks, each block compressed by itself with zstd. A bit-plane
has a block for each 32 KiB, so a token, a count or a place needs a few blocks of the file, not the file.

Files are written under new names and become part of the table only by a row of the manifest, so a task
that is tried again leaves no half-written or doubled shard behind.

Edge cases: null and empty texts give only the end id. Rows with equal ids keep a defined order (by a hash of the text).
A null id sorts first. A text longer than a shard stands alone in one. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .shared import scratch, stored
from .wordmemory import WordMemory

SHARD_TOKENS = 1 << 20
BLOCK = 512  # bits between running counts
PLANE_BYTES = 1 << 15  # of a bit-plane that are compressed by themselves


# ---------------------------------------------------------------- encoding
class Encoder:
    """Ids of whole texts by a `tokenizers` file.

    The library cuts a text into words before it encodes, so a text's ids are its words' ids in a row. Texts
    of plain Latin letters are cut here, on the bytes of a slice, and each distinct word is encoded by the
    library once; all others, and all texts under another kind of tokenizer, go through the library whole.
    """

    #: The normaliser and the word pattern for which the short way is right.
    NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Plain characters: in their texts the normaliser only lower-cases, and of white space these four occur.
    PLAIN = "[\t\n\r -~¡-¬®-įı-ňŊ-ž]"
    LETTERS, NUMBERS, SPACE = "a-zªµºß-öø-ÿĀ-ž", "0-9²³¹¼½¾", "\t\n\r "
    #: What an apostrophe that begins a word takes with it.
    TAKEN = (b"re", b"ve", b"ll", b"s", b"t", b"m", b"d")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        normal = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.short = normal == self.NORMAL and steps[0].get("pattern", {}).get("Regex") == self.PATTERN and steps[0].get("behavior") == "Removed"
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.memory = WordMemory(1 << 21)
        # by code point below U+0180: plain or not, lower case, and kind (0 white space, 1 letter, 2 number, 3 other)
        every = [chr(c) for c in range(0x180)]
        self.is_plain = np.array([bool(re.fullmatch(self.PLAIN, c)) for c in every])
        self.lower = np.array([ord(c.lower()) if p else i for i, (c, p) in enumerate(zip(every, self.is_plain))])
        kind = lambda c: 0 if c in self.SPACE else 1 if re.fullmatch(f"[{self.LETTERS}]", c) else 2 if re.fullmatch(f"[{self.NUMBERS}]", c) else 3
        self.kind = np.array([kind(c) for c in every], np.uint8)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of plain words. They are encoded some hundred at a time with spaces between, which part them and have no ids."""
        ids, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            got = self.library.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            size.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        return np.arange(len(words)), np.concatenate(ids), np.concatenate(size)

    def odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with a character that isn't plain, or with a special token's string."""
        if not self.short:
            return np.arange(len(offsets) - 1)
        lead = np.flatnonzero(data >= 0xC0)
        code = (data[lead].astype(np.int64) & 0x1F) << 6 | data[np.minimum(lead + 1, len(data) - 1)] & 0x3F
        bad = [lead[(data[lead] >= 0xE0) | ~self.is_plain[np.minimum(code, 0x17F)] | (code >= 0x180)], np.flatnonzero((data < 0x80) & ~self.is_plain[np.minimum(data, 0x7F)])]
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                bad.append(np.array([at]))
                at = raw.find(s, at + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate(bad), side="right") - 1)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes of plain texts, and their words' starts and ends."""
        low = B.LOWER[data]
        kind = self.kind[low & 0x7F]
        lead = np.flatnonzero(data >= 0xC0)
        code = self.lower[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
        low[lead], low[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
        kind[lead] = kind[lead + 1] = self.kind[code]
        begin = np.empty(len(low), bool)
        begin[:1], begin[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begin[lead + 1] = False
        quote = np.flatnonzero((low == 39) & begin)
        if len(quote):
            # letters of the same text that follow, padded with what no ending has
            fenced = np.concatenate((low, np.zeros(3, np.uint8)))
            stop = np.concatenate((begin, np.ones(3, bool)))
            same = np.cumsum(np.concatenate((np.zeros(1, np.int64), np.bincount(offsets[1:-1], minlength=len(low))[: len(low)] if len(offsets) > 2 else np.zeros(len(low), np.int64))))[1:]
            same = np.concatenate((same, np.full(3, -1)))
            free = np.ones(len(quote), bool)
            for end in self.TAKEN:
                n = len(end)
                hit = free & (same[quote + n] == same[quote])
                for k, c in enumerate(end, 1):
                    hit &= fenced[quote + k] == c
                free &= ~hit
                at = quote[hit]
                stop[at + 1] = False
                after = at + 1 + n
                inside = after < len(low)
                after = after[inside]
                stop[after] |= kind[after] == 1
            begin = stop[: len(low)]
        begin &= kind != 0
        starts = np.flatnonzero(begin)
        edge = np.flatnonzero(begin | (kind == 0))
        after = np.append(edge[1:], len(low))
        return low, starts, after[begin[edge]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        rows = len(offsets) - 1
        odd = self.odd(data, offsets)
        out: list[np.ndarray | None] = [None] * rows
        if len(odd) < rows:
            if len(odd):
                size = np.diff(offsets)
                plain = np.ones(rows, bool)
                plain[odd] = False
                data_, size[odd] = data[np.repeat(plain, size)], 0
                offsets_ = np.concatenate(([0], np.cumsum(size)))
            else:
                data_, offsets_ = data, offsets
            low, starts, ends = self.words(data_, offsets_)
            ids, at = self.memory.encode(low, starts, ends, np.searchsorted(starts, offsets_), self._distinct)
            out = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        for i in range(0, len(odd), 64):
            some = odd[i : i + 64].tolist()
            for j, ids in zip(some, self._whole([data[offsets[j] : offsets[j + 1]].tobytes().decode() for j in some])):
                out[j] = ids
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- the wavelet matrix
class BitPlane:
    """Bits with running counts. A plane in a file is read by blocks, of which rank and access touch one each."""

    def __init__(self, packed: np.ndarray | None, n: int, counts: np.ndarray | None = None, load: Callable[[int], np.ndarray] | None = None):
        self.n, self.load, self.held = n, load, {} if packed is None else None
        self.packed = packed
        if counts is None:
            pad = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
            pad[: len(packed)] = packed
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(pad.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)))).astype("<u4")
        self.counts = counts

    def _bytes(self, start: int, end: int) -> np.ndarray:
        """Bytes of one block."""
        if self.packed is not None:
            return self.packed[start:end]
        block = start // PLANE_BYTES
        if block not in self.held:
            self.held[block] = self.load(block)
        return self.held[block][start - block * PLANE_BYTES : end - block * PLANE_BYTES]

    def bits(self) -> np.ndarray:
        if self.packed is None:
            size = -(-self.n // 8)
            parts = [self._bytes(a, min(a + PLANE_BYTES, size)) for a in range(0, size, PLANE_BYTES)]
            self.packed, self.held = np.concatenate(parts) if parts else np.zeros(0, np.uint8), {}
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        return int(self._bytes(i >> 3, (i >> 3) + 1)[0] >> (i & 7) & 1)

    def ones(self, i: int) -> int:
        """Set bits before place i."""
        block, rest = divmod(i, BLOCK)
        total = int(self.counts[block])
        if rest:
            part = self._bytes(block * (BLOCK // 8), (i >> 3) + bool(i & 7))
            total += int(np.bitwise_count(part).sum())
            if i & 7:
                total -= (int(part[-1]) >> (i & 7)).bit_count()
        return total

    def place(self, k: int, value: int) -> int:
        """Place of the k-th bit (from 0) of that value."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            seen = self.ones(mid + 1) if value else mid + 1 - self.ones(mid + 1)
            lo, hi = (lo, mid) if seen > k else (mid + 1, hi)
        return lo


class WaveletMatrix:
    """Bit-planes from the highest bit of the alphabet's numbers to the lowest; each orders the next stably by its bit."""

    def __init__(self, alphabet: np.ndarray, planes: list[BitPlane], zeros: list[int], n: int):
        self.alphabet, self.planes, self.zeros, self.n = alphabet, planes, zeros, n

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        own = np.flatnonzero(seen)
        alphabet = own[np.argsort(-seen[own], kind="stable")].astype("<u4")
        number = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        v, planes, zeros = number[ids] if len(ids) else np.zeros(0, np.uint16), [], []
        for b in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
            bit = (v >> v.dtype.type(b) & v.dtype.type(1)).astype(bool)
            planes.append(BitPlane(np.packbits(bit, bitorder="little"), len(v)))
            low = v[~bit]
            zeros.append(len(low))
            v = np.concatenate((low, v[bit]))
        return WaveletMatrix(alphabet, planes, zeros, len(ids))

    def ids(self) -> np.ndarray:
        """All ids in order."""
        v = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit, z = self.planes[k].bits(), self.zeros[k]
            up = np.empty_like(v)
            up[~bit] = v[:z]
            up[bit] = v[z:] | v.dtype.type(1 << (len(self.planes) - 1 - k))
            v = up
        return self.alphabet[v] if self.n else np.zeros(0, "<u4")

    def access(self, i: int) -> int:
        """The id at place i."""
        number = 0
        for plane, z in zip(self.planes, self.zeros):
            bit, ones = plane.bit(i), plane.ones(i)
            number = number << 1 | bit
            i = z + ones if bit else i - ones
        return int(self.alphabet[number])

    def _number(self, token: int) -> int | None:
        at = np.flatnonzero(self.alphabet == token)
        return int(at[0]) if len(at) else None

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in places start to end."""
        end = self.n if end is None else end
        number = self._number(token)
        if number is None:
            return 0
        for k, (plane, z) in enumerate(zip(self.planes, self.zeros)):
            a, b = plane.ones(start), plane.ones(end)
            start, end = (z + a, z + b) if number >> (len(self.planes) - 1 - k) & 1 else (start - a, end - b)
        return end - start

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id; -1 if there are fewer."""
        number = self._number(token)
        if number is None or k >= self.count(token):
            return -1
        at = 0
        for j, (plane, z) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.ones(at)
            at = z + ones if number >> (len(self.planes) - 1 - j) & 1 else at - ones
        at += k
        for j in range(len(self.planes) - 1, -1, -1):
            plane, z = self.planes[j], self.zeros[j]
            at = plane.place(at - z, 1) if number >> (len(self.planes) - 1 - j) & 1 else plane.place(at, 0)
        return at


# ---------------------------------------------------------------- the file
MAGIC = b"TWM2"


def dump(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    w = WaveletMatrix.build(ids)
    ident = np.array([0 if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], np.uint8)
    z = zstandard.ZstdCompressor(level=1)
    sections: dict[str, list[int]] = {}
    body, at = [], 0
    parts = {"doc_ids": ident, "no_id": none, "sizes": np.asarray(sizes, "<i8"), "alphabet": w.alphabet}
    parts |= {f"counts{k}": p.counts for k, p in enumerate(w.planes)}
    for name, a in [*parts.items(), *((f"plane{k}", p.packed) for k, p in enumerate(w.planes))]:
        raw = np.ascontiguousarray(a).view(np.uint8).data
        step = PLANE_BYTES if name.startswith("plane") else max(len(raw), 1)
        some = [z.compress(raw[i : i + step]) for i in range(0, max(len(raw), 1), step)]
        sections[name] = [at, *map(len, some)]
        body += some
        at += sum(map(len, some))
    head = json.dumps({"tokens": int(w.n), "docs": len(doc_ids), "zeros": w.zeros, "sections": sections}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


class Shard:
    """A shard of a file, or of its bytes. Blocks of bit-planes are read and unpacked when something in them is asked for."""

    def __init__(self, source: bytes | pa.NativeFile):
        file = pa.BufferReader(source) if isinstance(source, bytes) else source
        if file.read_at(4, 0) != MAGIC:
            raise ValueError("not a token-id file")
        size = int.from_bytes(file.read_at(4, 4), "little")
        self.head = json.loads(file.read_at(size, 8))
        z, base = zstandard.ZstdDecompressor(), 8 + size

        def part(name: str, kind: str, block: int = 0) -> np.ndarray:
            at, *sizes = self.head["sections"][name]
            return np.frombuffer(z.decompress(file.read_at(sizes[block], base + at + sum(sizes[:block]))), kind)

        self.doc_ids = [None if x else int(d) for d, x in zip(part("doc_ids", "<i8"), part("no_id", "u1"))]
        self.sizes = part("sizes", "<i8")
        n, zeros = self.head["tokens"], self.head["zeros"]
        planes = [BitPlane(None, n, part(f"counts{k}", "<u4"), lambda block, k=k: part(f"plane{k}", "u1", block)) for k in range(len(zeros))]
        self.matrix = WaveletMatrix(part("alphabet", "<u4"), planes, zeros, n)


# ---------------------------------------------------------------- the operator
def write(docs: DataFrame, where: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards under `where`; the manifest has a row for each: part, number, path, docs, tokens, tokens before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], np.int32)
        names: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, before, size
            name = f"{root}/{part:07d}-{number:05d}-{uuid.uuid4().hex}.twm"
            raw = dump(names, np.array(sizes, np.int64), np.concatenate(held).view("<u4"))
            with fs.open_output_stream(name, compression=None) as f:
                f.write(raw)
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [name], "docs": [len(names)], "tokens": [size], "before": [before]})
            number, before, size = number + 1, before + size, 0
            names.clear()
            sizes.clear()
            held.clear()
            return row

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            data, offsets = B.column_bytes(batch.column(at))
            for a, b in B.slices(offsets):
                for i, own in zip(range(a, b), encoder(path).encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])):
                    names.append(ids[i])
                    held.extend((own, end))
                    sizes.append(len(own) + 1)
                    size += len(own) + 1
                    if size >= shard_tokens:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    # texts of one id may be any number: they are parted by a hash of the text
    tie = B.free(rows, "_tie")
    rows = rows.withColumn(tie, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    rows = rows.repartitionByRange(id_col, tie).sortWithinPartitions(id_col, tie, text_col).select(id_col, text_col)
    return rows.mapInArrow(run, "part long, number long, path string, docs long, tokens long, before long")


def read(spark, manifest: DataFrame, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the shards, from their files."""
    parts = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base, total = {}, 0
    for p, n in parts:
        base[p] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(row["path"], compression=None) as f:
                    shard = Shard(f.read())  # all of it is needed: one request
                ids = np.ascontiguousarray(shard.matrix.ids(), "<u4")
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base[row["part"]] + row["before"]), pa.array(shard.sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one file a task at a time; the manifest has one short row for each file
    files = manifest.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())))
    return files.select("part", "path", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, where: str, token: int) -> DataFrame:
    """(doc_id, n, first): documents that hold an id, how often, and its first place in them, by rank and select on the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    shard = Shard(f)
                    matrix, found, ends = shard.matrix, {}, np.cumsum(shard.sizes)
                    seen, total = 0, matrix.count(token)
                    while seen < total:
                        at = matrix.select(token, seen)
                        doc = int(np.searchsorted(ends, at, side="right"))
                        n = matrix.count(token, at, int(ends[doc]))
                        found[doc] = (shard.doc_ids[doc], n, at - int(ends[doc] - shard.sizes[doc]))
                        seen += n
                columns = list(zip(*found.values())) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n", "first"])

    return manifest.select("path").mapInArrow(run, "doc_id long, n long, first long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """The contract's query: writes the files, then answers from them."""
    where = scratch(spark, "token-files")
    manifest = stored(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), where, path or tokenizer_path()), "token-manifest")
    return read(spark, manifest, where)
