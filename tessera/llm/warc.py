"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a bundle ends with two
skippable frames: an index from record id to frame and offset within the frame's contents, and the seek
table of the public seekable format (sizes of all frames, number of frames, magic). Any Zstandard reader
can unpack a bundle; a reader of one record needs the last bytes, the index and one frame.

Of records with equal payloads the one with the smallest id is a response and the others revisit it
(payload not stored; its digest and its length stay in the headers).

Bundles are written under new names and count only by their manifest row, so a task that is tried again
adds nothing twice. The digests that occur more than once are broadcast up to BROADCAST_ROWS of them and
joined by a shuffle beyond.

Edge cases: a null payload is empty. Rows that repeat the smallest id of a group are all responses. Rows
without an id are named `none`; they revisit a record with an id, and are responses if there is none.
A null URL leaves its header out. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stored

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000

# Magic numbers of the seekable Zstandard format, and the WARC revisit profile.
SKIP_SEEK_TABLE = 0x184D2A5E
SKIP_INDEX = 0x184D2A50
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    last = name.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and the place after it."""
    end = raw.index(b"\r\n\r\n", at)
    first, *lines = raw[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(head["content-length"])
    return head, raw[end + 4 : end + 4 + size], end + 8 + size


class BundleWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.z = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, name: str, raw: bytes) -> None:
        self.index.append((name, len(self.frames), self.size, len(raw)))
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.z.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = self.z.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", SKIP_INDEX, len(body)) + body)
        frames = [*self.frames, (len(body) + 8, 0)]
        table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIP_SEEK_TABLE, len(table)) + table)


class BundleReader:
    """Random access to a bundle in a seekable stream."""

    def __init__(self, f):
        self.f, self.z = f, zstandard.ZstdDecompressor()
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        f.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", f.read(8 * n)))
        at = 0
        self.places = []
        for packed, plain in sizes:
            self.places.append((at, packed, plain))
            at += packed
        self._index: dict[str, list[tuple[int, int, int]]] | None = None

    @property
    def index(self) -> dict[str, list[tuple[int, int, int]]]:
        """Frame, offset within it and length of the records of each id."""
        if self._index is None:
            at, packed, _ = self.places[-1]
            self.f.seek(at + 8)
            self._index = {}
            for name, *where in json.loads(self.z.decompress(self.f.read(packed - 8))):
                self._index.setdefault(name, []).append(tuple(where))
        return self._index

    def frame(self, k: int) -> bytes:
        at, packed, _ = self.places[k]
        self.f.seek(at)
        return self.z.decompress(self.f.read(packed))

    def read(self, name: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and blocks of the records of one id; unpacks only their frames."""
        return [parse(self.frame(k), at)[:2] for k, at, _ in self.index.get(name, [])]

    def located(self, names: set[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records, or those of some ids, by the index: each from its place in its frame, each frame unpacked once."""
        where = sorted((*w, name) for name, ws in self.index.items() if names is None or name in names for w in ws)
        held, raw = None, b""
        for k, at, size, name in where:
            if k != held:
                held, raw = k, self.frame(k)
            head, block, end = parse(raw, at)
            if head["warc-record-id"] != name or end != at + size:
                raise ValueError(f"the index is wrong about {name}")
            yield head, block

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records as they stand, without the index."""
        for k in range(len(self.places) - 1):
            raw, at = self.frame(k), 0
            while at < len(raw):
                head, block, at = parse(raw, at)
                yield head, block


def write(pages: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles under `where`; the manifest has a row for each: path, records, bytes.

    Payloads of fewer than `least` bytes are never revisits.
    """
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= least, F.unhex(F.sha1("payload"))))
    again = rows.where("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = stored(again.select("sha", "first"), "warc-repeats")
    small = again.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(again) if small else again, "sha", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        out = writer = name = None
        n = 0

        def close() -> pa.RecordBatch:
            writer.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for page, url, payload, first in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if writer is None:
                        name, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                        out = fs.open_output_stream(name, compression=None)
                        writer = BundleWriter(out)
                    writer.add(record_name(page), record(page, url, payload, None if first is None or first == page else first, date))
                    n += 1
                    if writer.written >= BUNDLE_BYTES:
                        yield close()
                        writer = None
        if writer is not None:
            yield close()

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read(spark, manifest: DataFrame, where: str, ids: list[int] | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record of the bundles, or of those of some ids, found by the bundles' indexes."""
    names_ = None if ids is None else {record_name(i) for i in ids}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_file(path) as f:
                    for head, block in BundleReader(f).located(names_):
                        http, _, body = block.partition(b"\r\n\r\n")
                        stated = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response":
                            if digest(body) != stated:
                                raise ValueError(f"{path}: {head['warc-record-id']} is damaged")
                            size, refers = len(body), None
                        else:
                            size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                            refers = page_of(head["warc-refers-to"])
                        rows.append((page_of(head["warc-record-id"]), size, stated, head["warc-type"], refers, head.get("warc-target-uri")))
                        if len(rows) >= 4096:
                            yield table(rows)
                            rows = []
                yield table(rows)

    files = manifest.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())))
    return files.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's query: writes the archives, then answers from them."""
    where = scratch(spark, "warc")
    manifest = stored(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), where), "warc-manifest")
    return read(spark, manifest, where).drop("url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST((i // 8) * 10 + 1 AS INT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE CAST(first AS BIGINT) END AS refers_to
FROM f
"""
