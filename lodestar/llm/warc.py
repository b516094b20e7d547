"""Operator 8: WARC archives as seekable Zstandard bundles.

Every page is one WARC/1.1 record.  A task appends its records to bundles: records
are gathered into frames of about ``FRAME_BYTES``, each compressed on its own, and
a bundle ends with the seek table of the Zstandard seekable format (a skippable
frame with the sizes of all frames), so any Zstandard reader can read it whole and
a seeking reader decompresses one frame.  The index maps a record's identifier to
its bundle, frame, offset inside the frame and length.

Payloads that are equal (SHA-1) are stored once: the smallest page_id is the
response, the others are revisits that refer to it.  Digests are combined before
the shuffle; the first page of each repeated payload comes back by a join that is
broadcast only where its counted rows are few, and skew-split otherwise.

A file's name holds the task attempt, and only files named in the committed index
count, so a repeated or lost task leaves no wrong record.  Files are written and
read, frame by frame, with ``pyarrow.fs`` by the URI's scheme; only their names
are shuffled.

Defined results: null html is an empty payload; a null url becomes ``about:blank``;
control characters and spaces in urls are percent-encoded; rows with equal ids and
payloads are one response and, but for the first row, not told apart: rows that
share the response's id are all responses; a null id is a record without a number
and never a response that others refer to; other columns are ignored; an empty
table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import bounded_broadcast
from .storage import materialize, new_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24
LEVEL = 3
#: Tasks that read bundles, at most.
MOST_TASKS = 10_000
#: Payloads of fewer bytes are always stored as they are.
LEAST_BYTES = 0
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "bundle string, page_id long, frame int, offset int, length int"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_HEAD_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with an HTTP head and the payload, or a revisit with neither."""
    uri = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), url or "about:blank")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    named = uuid.uuid4().urn if page_id is None else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {uri}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: <{named}>", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if url is None:
        head.append("X-Url-Missing: 1")
    body = b""
    if refers_to is None:
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _HEAD_END + body + _HEAD_END


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and body of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(_HEAD_END, at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        body = end + len(_HEAD_END)
        stop = body + int(fields["Content-Length"])
        if data[stop : stop + 4] != _HEAD_END:
            raise ValueError(f"the record at {at} has a wrong length")
        yield at, fields, data[body:stop]
        at = stop + 4


class Bundle:
    """Frames and the footer that lists them."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.room = self.bytes = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.room and self.room + len(data) > FRAME_BYTES:
            self.end_frame()
        at = len(self.frames), self.room
        self.open.append(data)
        self.room += len(data)
        return at

    def end_frame(self) -> None:
        if self.room:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.room))
            self.bytes += len(frame)
            self.open, self.room = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, at = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - width * (count - k))
        out.append((at, packed, plain))
        at += packed
    return out


def frame(data: bytes, number: int) -> bytes:
    start, packed, plain = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)


def write_bundles(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the bundles to a folder (a URI that all executors share); returns the committed index."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload"))
    repeated = told.select("page_id", digest.alias("d")).where("d is not null").groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("d", "first")
    repeated = materialize(repeated, "repeated-payloads")
    placed = told.withColumn("sha", digest).join(bounded_broadcast(repeated, repeated.count()), F.col("sha") == F.col("d"), "left")
    ready = placed.select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, bundle, rows = TaskContext.get(), 0, None, []
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)

        def close() -> pa.RecordBatch:
            name = f"bundle-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(bundle.finish())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]], names=["bundle", "page_id", "frame", "offset", "length"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, data, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                bundle = bundle or Bundle()
                one = record(page_id, url, data, refers_to)
                rows.append((page_id, *bundle.add(one), len(one)))
                if bundle.bytes + bundle.room // 4 >= BUNDLE_BYTES:
                    yield close()
                    number, bundle, rows = number + 1, None, []
        if bundle:
            yield close()

    return materialize(ready.mapInArrow(write, _INDEX), "warc-index")


def _frames(file: pa.NativeFile, wanted: set[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """Number and content of the wanted frames (all if none are named), read one by one by the footer's seek table."""
    size = file.size()
    file.seek(size - 9)
    count, flags, _ = struct.unpack("<IBI", file.read(9))
    tail = 9 + count * (12 if flags & 0x80 else 8)
    file.seek(size - tail)
    for k, (start, packed, plain) in enumerate(seek_table(file.read(tail))):
        if wanted is None or k in wanted:
            file.seek(start)
            yield k, zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def _dealt(bundles: DataFrame) -> DataFrame:
    """Names of bundles in as many partitions: a task reads about one. No content is shuffled."""
    return bundles.repartition(min(max(1, bundles.count()), MOST_TASKS))


def _row(fields: dict[str, str], body: bytes) -> tuple:
    number = fields["WARC-Record-ID"][1:-1].rpartition(":")
    page_id = int(number[2]) if number[0] == "urn:page" else None
    refers_to = int(fields["WARC-Refers-To"][1:-1].rpartition(":")[2]) if "WARC-Refers-To" in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = body[body.index(_HEAD_END) + 4 :]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {page_id} does not fit its digest")
    return page_id, None if "X-Url-Missing" in fields else fields["WARC-Target-URI"], fields["WARC-Type"], refers_to, int(fields["X-Payload-Bytes"]), digest, payload


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_bundles(spark: SparkSession, path: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the committed bundles; each payload is held against its digest."""
    if not index.take(1):
        return spark.createDataFrame([], _RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{folder}/{name}") as file:
                    for _, data in _frames(file):
                        rows = [_row(fields, body) for _, fields, body in records(data)]
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r if payloads else (*r[:-1], None), strict=True)) for r in rows], _ARROW)

    return _dealt(index.select("bundle").distinct()).mapInArrow(read, _RECORD)


def read_records(spark: SparkSession, path: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the given page_ids: their frames alone are read, found by the index and the seek table."""
    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").groupBy("bundle").agg(F.collect_set(F.struct("frame", "offset")).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside = {(p["frame"], p["offset"]) for p in at}
                with store.open_input_file(f"{folder}/{name}") as file:
                    for k, data in _frames(file, {number for number, _ in inside}):
                        rows = [_row(fields, body) for offset, fields, body in records(data) if (k, offset) in inside]
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)

    return _dealt(places).mapInArrow(read, _RECORD)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all pages and reads them back: the records without their payloads."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    return read_bundles(spark, path, write_bundles(pages, path), payloads=False).drop("payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda c: array_to_string(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(p.hex, CAST(1 + 5 * c AS INT), 5))::INT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""
