"""Operator 5: WARC archives as seekable Zstandard bundles.

Each page becomes a WARC record. Records are grouped into frames that are compressed independently; a
bundle ends in a skippable frame with the seek table (sizes of all frames, compressed and not). The map
returned by ``write_bundles`` names bundle, frame, offset in the uncompressed frame and length of each
record, so one record is read by decompressing one frame.

Of pages with equal payloads (at least ``min_bytes`` long) the one with the smallest id is a ``response``
record, all others are ``revisit`` records without payload; their headers state its digest and length.
Null html is an empty payload, a null url gives no target URI, and a null id ranks last. Pages repeated with the
same id and payload: each of these rows is a response if the id is the smallest. An empty table gives no bundles and
no rows. A long payload is a record like others, alone in its frame. Extra columns are not read.

Tasks write bundles under names of their own; only bundles of the attempts that succeeded are in the map.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import batches_of, new_file, open_folder, read_table, shared_files, utf8
from larkspur.session import materialise

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
# Uncompressed bytes that a task reads.
READ_BYTES = 32 << 20
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:larkspur:page:"
_MAP = "page_id bigint, bundle string, frame bigint, offset bigint, length bigint"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, revisit: bool) -> bytes:
    """One record; a revisit of ``first_id`` keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_ID}{'null' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="%:/?#[]@!$&'()*+,;=~")
    if revisit:
        headers["WARC-Refers-To"] = f"<{_ID}{first_id}>"
        headers["WARC-Profile"] = REVISIT
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; raises if its length is not the one stated."""
    head, rest = record.split(b"\r\n\r\n", 1)
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block, end = rest[: int(warc["Content-Length"])], rest[int(warc["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError(f"broken record {warc.get('WARC-Record-ID')}")
    http_head, payload = block.split(b"\r\n\r\n", 1)
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


class BundleWriter:
    """Writes records to one bundle, frame by frame."""

    def __init__(self, uri: str, frame_bytes: int) -> None:
        system, self.name = new_file(uri, ".warc.zst")
        self.stream = system.open_output_stream(self.name, compression=None)  # the frames are compressed here
        self.frame_bytes = frame_bytes
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length."""
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self._end_frame()
        place = (len(self.frames), self.held_bytes, len(record))
        self.held.append(record)
        self.held_bytes += len(record)
        return place

    def _end_frame(self) -> None:
        frame = self.compress(b"".join(self.held))
        self.stream.write(frame)
        self.frames.append((len(frame), self.held_bytes))
        self.written += len(frame)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class BundleReader:
    """Reads frames of a bundle in any order by its seek table."""

    def __init__(self, uri: str, name: str) -> None:
        system, _ = open_folder(uri)
        self.file = system.open_input_file(name)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        width = 12 if descriptor & 0x80 else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.sizes = [struct.unpack_from("<II", table, i * width) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[number]), plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id``, ``url``, payload and the smallest id of the pages with that payload.

    Payloads are compared by SHA-256. A hot payload is one row on the right of the join; adaptive execution splits
    its rows on the left.
    """
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        utf8("html").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    firsts = keyed.groupBy("key").agg(F.min("page_id").alias("first_id"))
    long_enough = F.octet_length("payload") >= min_bytes
    return keyed.join(firsts, "key").select(
        "page_id", "url", "payload", F.when(long_enough, F.col("first_id")).alias("first_id")
    )


def write_bundles(
    marked: DataFrame, uri: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write the records to bundles below ``uri``; returns the written map of records to places."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()),
            ("length", pa.int64()),
        ])

        def places() -> Iterator[dict]:
            writer: BundleWriter | None = None
            for batch in batches:
                for row in batch.to_pylist():
                    writer = writer or BundleWriter(uri, frame_bytes)
                    page, first = row["page_id"], row["first_id"]
                    record = warc_record(page, row["url"], row["payload"], first, first is not None and page != first)
                    frame, offset, length = writer.add(record)
                    yield {"page_id": page, "bundle": writer.name, "frame": frame, "offset": offset, "length": length}
                    if writer.written > bundle_bytes:
                        writer.close()
                        writer = None
            if writer:
                writer.close()

        yield from batches_of(places(), schema)

    return materialise(marked.mapInArrow(written, _MAP), "warc_map")


def _page_id(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(_ID)
    return None if text == "null" else int(text)


def read_bundles(places: DataFrame, uri: str) -> DataFrame:
    """Read every record of the map back from its bundle, frame after frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()),
        ])

        def rows() -> Iterator[dict]:
            reader, name, frame, number = None, None, b"", -1
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bundle"] != name:
                        name, number = row["bundle"], -1
                        reader = BundleReader(uri, name)
                    if row["frame"] != number:
                        number = row["frame"]
                        frame = reader.frame(number)
                    warc, http, payload = parse_record(frame[row["offset"] : row["offset"] + row["length"]])
                    stated = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = warc["WARC-Type"] == "revisit"
                    if not revisit and (payload_digest(payload) != stated or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} was damaged")
                    yield {
                        "page_id": _page_id(warc["WARC-Record-ID"]),
                        "payload_bytes": int(http["Content-Length"]),
                        "payload_digest": stated,
                        "record_type": warc["WARC-Type"],
                        "refers_to": _page_id(warc["WARC-Refers-To"]) if revisit else None,
                    }

        yield from batches_of(rows(), schema)

    # By ranges of bundle and frame, as many as the records' bytes ask for: the map's own rows are small.
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = -(-total // READ_BYTES) or 1
    ordered = places.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInArrow(read, _READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_files(spark, "warc")
    places = write_bundles(mark_revisits(read_table(spark, sf_dir, "pages")), uri)
    return read_bundles(places, uri)


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, min(page_id) OVER (PARTITION BY html) AS first_id FROM pages
), h AS (SELECT page_id, first_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
         (strpos('0123456789abcdef', substr(hex, 5 * i // 4 + 1, 1)) - 1) * 16
         + strpos('0123456789abcdef', substr(hex || '0', 5 * i // 4 + 2, 1)) - 1)
         // CAST(2 ** (3 - 5 * i % 4) AS BIGINT)) % 32, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
"""
