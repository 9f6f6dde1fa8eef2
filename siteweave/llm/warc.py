"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME`` bytes
before compression. A skippable frame at a bundle's end holds the seek table
of the Zstandard seekable format (sizes of all frames), and an index maps each
record to its bundle, frame and offset inside the frame, so one record is read
by decompressing one frame. Tasks write bundles in the shared folder under
names of their own attempt; only those of successful attempts enter the index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import fresh_path, shuffle_partitions

FRAME = 1 << 20
BUNDLE = 256 << 20
LEVEL = 3
#: Fixed values of the Zstandard formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Rows turned into records at a time, and parts of a very common payload's rows.
SLICE, SALTS = 256, 32
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, offset long, record_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record with an HTTP block; a revisit has the payload's digest and length but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    uri = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"] if is_revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        yield headers, frame[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """A skippable frame with the compressed and decompressed sizes of the frames before it."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame."""
    size = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries = struct.iter_unpack("<II", file.read_at(8 * n, size - 9 - 8 * n))
    out, at = [], 0
    for packed, _ in entries:
        out.append((at, packed))
        at += packed
    return out


class _Bundle:
    """A bundle being written; rows has the index of its records once it is closed."""

    def __init__(self, path: str):
        where, at = fs.FileSystem.from_uri(path)
        self.path, self.out, self.packer = path, where.open_output_stream(at, compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.start, self.raw, self.held, self.rows = [], 0, bytearray(), [], []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.held.append((page_id, len(self.raw), len(data)))
        self.raw += data
        if len(self.raw) >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(bytes(self.raw))
            self.out.write(packed)
            self.rows += [(i, self.path, len(self.frames), self.start, len(packed), at, n) for i, at, n in self.held]
            self.frames.append((len(packed), len(self.raw)))
            self.start += len(packed)
            self.raw, self.held = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages (page_id, url, html, refers_to, is_revisit) as bundles in the folder and returns the index of all records, itself stored there."""
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), *[(n, pa.int64()) for n in ("frame", "frame_start", "frame_bytes", "offset", "record_bytes")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = (x for at in range(0, len(batch), SLICE) for x in zip(*[c.to_pylist() for c in batch.slice(at, SLICE).columns]))
            for page_id, url, html, refers_to, is_revisit in rows:
                if bundle is None:
                    where, at = fs.FileSystem.from_uri(f"{folder}/bundles")
                    where.create_dir(at, recursive=True)
                    bundle = _Bundle(f"{folder}/bundles/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.warc.zst")
                bundle.add(page_id, record(page_id, url, (html or "").encode(), refers_to, is_revisit))
                if bundle.start >= BUNDLE:
                    yield _batch(bundle.close(), schema)
                    bundle = None
        if bundle is not None:
            yield _batch(bundle.close(), schema)

    pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "refers_to", "is_revisit").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read_bundles(index: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Reads records back: all of the index, or those of the page_ids in ``records``, a frame at a time.

    A response's length and digest are computed from the payload read; it is
    an error if they differ from its header.
    """
    wanted = index if records is None else index.join(records.select("page_id"), "page_id", "left_semi")
    frames = wanted.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        opened: dict[str, tuple] = {}
        for batch in batches:
            rows = []
            for bundle, frame, offsets in zip(*[c.to_pylist() for c in batch.columns]):
                if bundle not in opened:
                    opened.clear()
                    where, at = fs.FileSystem.from_uri(bundle)
                    file = where.open_input_file(at)
                    opened[bundle] = (file, read_seek_table(file))
                file, table = opened[bundle]
                raw = zstandard.ZstdDecompressor().decompress(file.read_at(table[frame][1], table[frame][0]))
                for at in offsets:
                    headers, block = next(parse_records(raw[at:] if at else raw))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    if headers["WARC-Type"] == "response" and (n != len(payload) or digest != base32_sha1(payload)):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {bundle}")
                    rows.append((number(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], number(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None))
            yield _batch(rows, schema)

    return frames.repartition(shuffle_partitions(index.sparkSession), "bundle").sortWithinPartitions("bundle", "frame").mapInArrow(run, RECORDS)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, is_revisit). Of equal payloads of at least ``least_bytes`` the smallest page_id is a response (nulls last).

    Payloads that occur once have no counterpart in the join; the rows of a
    very common one are dealt out by a salt.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    same = keyed.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = same.filter("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    out = salted.join(same, ["digest", "bytes", "salt"], "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", F.when(is_revisit, F.col("first")).alias("refers_to"), is_revisit.alias("is_revisit"))


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes all pages to bundles and reads every record back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A null html is an empty payload, a null url is left out. Rows that repeat
    a page_id each get a record; those with the response's page_id and payload
    are responses too. Equal payloads without any page_id are responses. An
    empty table gives no rows.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(with_roles(pages, least_bytes), folder))
