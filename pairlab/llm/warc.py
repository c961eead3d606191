"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole records, and
ends with a seek table (a skippable frame that other Zstandard readers pass
over): compressed and plain size of every frame.  The index maps a record's id
to bundle, frame and the offset inside the plain frame, so one record costs one
range read.

Of pages with equal payloads one is written as a response, the others as
revisits that refer to it.  The representative of a payload is an aggregate on
its digest over narrow rows; page bodies move once, by page id, so a payload
that a third of all pages share does not gather anywhere.
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

from pairlab.llm.base import shared_path, table, written
from pairlab.llm.files import new_file, open_in, open_out

#: plain bytes of records after which a frame, and compressed bytes after which a bundle, is closed
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
LEVEL = 6
#: payloads from this size on are written once
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"

# fixed values: the seekable format's magic numbers, and the profile of a revisit
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to``) keeps digest and length of its payload but not the bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<{_ID}{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "".join(chr(c) for c in range(33, 127))


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers with lower-case names, payload, position after) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = stop + 4
    end = body + int(head["content-length"])
    inner = data.index(b"\r\n\r\n", body, end) + 4
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} does not end where its length says")
    return head, data[inner:end], end + 4


class BundleWriter:
    """Writes records into frames and the seek table at the end."""

    def __init__(self, path: str):
        self.path, self.out, self.frames, self.held, self.size = path, open_out(path), [], bytearray(), 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the plain frame) of the record."""
        where = len(self.frames), len(self.held)
        self.held += record
        if len(self.held) >= FRAME_BYTES:
            self._flush()
        return where

    def _flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(bytes(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.held)))
            self.size += len(packed)
            self.held = bytearray()

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table_bytes = entries + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table_bytes)) + table_bytes)
        self.out.close()


class BundleReader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, path: str):
        self.source = open_in(path)
        size = self.source.size()
        self.source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.source.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.source.seek(size - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", self.source.read(8 * n))
        self.frames, at = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
            self.frames.append((at, packed, plain))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.source.close()


_INDEX = "page_id long, bundle string, frame int, offset long, length long"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle: BundleWriter | None = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                bundle = bundle or BundleWriter(new_file(folder, ".warc.zst"))
                payload = (r["html"] or "").encode()
                record = format_record(r["page_id"], r["url"], payload, payload_digest(payload), r["refers_to"])
                frame, offset = bundle.add(record)
                rows.append({"page_id": r["page_id"], "bundle": bundle.path, "frame": frame, "offset": offset, "length": len(record)})
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        if bundle:
            bundle.close()
    return write


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: null for a response, else the response's page_id.

    Of equal payloads of ``least_bytes`` or more, the one with the largest
    page_id is the response (repeated rows of it are responses too).  A null
    html is an empty payload; a null page_id is never the largest unless alone.
    """
    pages = pages.select("page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = (narrow.join(largest, "digest").where("NOT page_id <=> keep").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("keep").alias("refers_to")).distinct())
    return pages.join(revisits, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1(payload) == F.col("__digest")), "left").select("page_id", "url", "html", "refers_to")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as bundles in ``folder``; returns the index (page_id, bundle, frame, offset, length).

    The index is a written table: only the bundles it names count.  A null html
    is an empty payload, a null url has no target, a null page_id is kept as null;
    repeated rows are records of their own; an empty table writes no bundle and
    gives an empty index; other columns are not read.
    """
    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), _INDEX), "warc-index")


def _parsed(head: dict[str, str], payload: bytes) -> dict:
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    number = lambda s: None if s is None or s.endswith("null>") else int(s[1 + len(_ID):-1])
    response = head["warc-type"] == "response"
    if response and (len(payload) != int(head["x-payload-length"]) or payload_digest(payload) != digest):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "payload_bytes": int(head["x-payload-length"]),
            "payload_digest": digest, "refers_to": number(head.get("warc-refers-to")), "payload": payload if response else None}


_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            reader = BundleReader(path)
            for i in range(len(reader.frames)):
                data, at, rows = reader.frame(i), 0, []
                while at < len(data):
                    head, payload, at = parse_record(data, at)
                    rows.append(_parsed(head, payload))
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)
            reader.close()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, last, reader, data = [], None, None, b""
        for r in sorted(b.to_pylist(), key=lambda r: (r["bundle"], r["frame"], r["offset"])):
            if reader is None or last[0] != r["bundle"]:
                if reader:
                    reader.close()
                reader, last = BundleReader(r["bundle"]), (r["bundle"], None)
            if last[1] != r["frame"]:
                data, last = reader.frame(r["frame"]), (r["bundle"], r["frame"])
            head, payload, _ = parse_record(data, r["offset"])
            rows.append(_parsed(head, payload))
        if reader:
            reader.close()
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)


def read_warc(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, frame by frame (one task reads whole bundles).

    A bundle is read once however often the index names it; an empty index gives
    no rows; a payload that does not match its digest raises.  A revisit has a null
    payload, a record of a null page a null page_id.
    """
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.select("bundle").distinct().repartition(n, "bundle").mapInArrow(_scan, _RECORD)


def fetch_records(entries: DataFrame) -> DataFrame:
    """Only the records of the given rows of an index: one range read for each frame they are in.

    A row that is given twice is fetched twice; no rows give none.  Null ids and
    payloads are as in ``read_warc``.
    """
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(n, "bundle", "frame").mapInArrow(_fetch, _RECORD)


def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC bundles to the shared folder and read back."""
    index = write_warc(with_revisits(table(spark, sf_dir, "pages")), shared_path(spark, "warc"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "sha1(html)"
_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {v} % 32 + 1, 1)"
#: five hex digits are four digits of base 32
_DIGEST = "array_to_string(list_transform(list_transform(range(8), lambda g: CAST('0x' || substr(" + _HEX + ", 5 * g + 1, 5) AS BIGINT)), lambda v: " + " || ".join(
    _BASE32.format(v=f"(v // {32 ** k})") for k in (3, 2, 1, 0)) + "), '')"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
, m AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN m USING (html)"""
