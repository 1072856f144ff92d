"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each holding some WARC records; a skippable frame with the record
index, which maps record identifiers to a frame and an offset within that frame's content; and, last, the seek table
of the public seekable format, whose footer a reader finds at the end of the file. Any Zstandard decoder reads the
file whole; a reader of single records fetches the index and the one frame it needs.

Bundles are written by Spark's own file writer, one row a file, so its commit protocol covers them: a task that is
run again after the loss of an executor leaves no half-written or doubled file, on any file system that Spark knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the Zstandard and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CRLF = b"\r\n"
#: Bytes of records in a frame, and of frames in a bundle, from which on the next is begun.
FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 32 * 1024 * 1024
LEVEL = 3


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record; line breaks cannot get into a header."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record that starts at `at`."""
    stop = data.index(CRLF + CRLF, at)
    first, *lines = data[at:stop].split(CRLF)
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}
    begin = stop + 4
    end = begin + int(headers["content-length"])
    return headers, data[begin:end], end + 4


def http_message(payload: bytes) -> bytes:
    """The payload as the body of an HTTP response."""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}", "", ""]
    return CRLF.join(x.encode() for x in head) + payload


class Bundle:
    """Gathers records into frames and frames into the bytes of a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.open, self.open_size = [], 0
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []  # record id, frame, offset in the frame, length
        self.size = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.size += len(packed)
            self.open, self.open_size = [], 0

    def to_bytes(self) -> bytes:
        self.close_frame()
        index = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(self.index).encode())
        seek = b"".join(struct.pack("<II", *x) for x in [*self.sizes, (8 + len(index), 0)])
        seek += struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek)) + seek


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the footer; the last is the record index."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 128 else 8
    begin, at, out = len(data) - 9 - n * width, 0, []
    for k in range(n):
        packed, size = struct.unpack_from("<II", data, begin + k * width)
        out.append((at, packed, size))
        at += packed
    return out


def record_index(data: bytes) -> list[tuple[str, int, int, int]]:
    at, packed, _ = seek_table(data)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + packed]))]


def frame(data: bytes, k: int) -> bytes:
    at, packed, size = seek_table(data)[k]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)


def revisits(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0, date: Column | None = None) -> DataFrame:
    """(_id, _digest, _first, _first_url, _first_date): the rows whose payload a row of larger id holds too, that id, its url and
    its date.

    Counts by payload are added up before the shuffle, so a payload that a third of all rows share is one row of each
    task there; joining it back is an equi-join whose large keys Spark splits.
    """
    own = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.sha1(F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b""))).alias("_digest"), F.coalesce(F.octet_length(payload_col), F.lit(0)).alias("_size"), (F.lit(None).cast("string") if date is None else date).alias("_date"))
    own = own.where(F.col("_size") >= least_bytes).drop("_size")
    shared = own.groupBy("_digest").agg(F.max(F.struct("_id", "_url", "_date")).alias("f"), F.count("*").alias("_n"))
    shared = shared.where("_n > 1 AND f._id IS NOT NULL").select("_digest", F.col("f._id").alias("_first"), F.col("f._url").alias("_first_url"), F.col("f._date").alias("_first_date"))
    return own.join(shared, "_digest").where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_digest", "_first", "_first_url", "_first_date").distinct()


def write_archives(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", date_col: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Writes a WARC record for each row under `path`, a folder of bundles.

    Of rows with equal payloads of at least `least_bytes` bytes, that of the largest id is a response and the others
    are revisits of it, without a block; the rest are responses. A null payload is empty. A null id counts as smaller
    than any and leaves no id header; where all equal rows have a null id, all are responses, as are repeated rows
    that tie for the largest id. Null urls give no target. Records are dated by date_col where it is given and not null,
    else by date; a revisit tells the date of the response that it refers to. Other columns, whatever their names, are not
    read. Very long payloads are records of frames and bundles of their own. An empty table gives a folder without
    bundles. Rows stay in their tasks: a task holds one bundle and one record at a time.
    """
    when = F.lit(date) if date_col is None else F.coalesce(F.date_format(F.to_utc_timestamp(F.col(date_col), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.encode(payload_col, "UTF-8").alias("_payload"), F.sha1(F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b""))).alias("_digest"), when.alias("_date"))
    again = revisits(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, url_col, payload_col, least_bytes, when).select(F.col("_id").alias("_id2"), F.col("_digest").alias("_digest2"), "_first", "_first_url", "_first_date")
    joined = rows.join(again, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_digest") == F.col("_digest2")), "left").select("_id", "_url", "_payload", "_first", "_first_url", "_first_date", "_date")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, count = Bundle(frame_bytes), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.to_bytes()[:-1]], pa.binary())], ["value"])
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page, url, payload, first, first_url, first_day, day = (x.as_py() for x in row)
                payload = payload or b""
                digest = digest32(payload)
                count += 1  # a task that is run again gives its records the same ids, and repeated rows differ
                record_id = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{path}|{TaskContext.get().partitionId()}|{count}|{page}|{digest}"))
                headers = [("WARC-Date", day), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                headers += [("WARC-Target-URI", url)] * (url is not None) + [("X-Source-ID", str(page))] * (page is not None)
                if first is None:
                    block = http_message(payload)
                    data = record("response", record_id, [*headers, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response")], block)
                else:
                    data = record("revisit", record_id, [*headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Date", first_day), ("X-Refers-To-Source-ID", str(first)), *[("WARC-Refers-To-Target-URI", first_url)] * (first_url is not None)], b"")
                bundle.add(record_id, data)
                if bundle.size >= bundle_bytes:
                    yield out()
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield out()

    packed = joined.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    # The writer ends each row with a separator; the last byte of the footer serves as such.
    packed.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", chr(SEEKABLE_MAGIC >> 24)).text(path)

def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, path, frame, offset, length) of each record: the offset is within the frame's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = record_index(data.as_py())
                ids, frames, offsets, lengths = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name.as_py()] * len(rows)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["record_id", "path", "frame", "offset", "length"])

    return _bundles(spark, path).mapInArrow(run, "record_id string, path string, frame int, offset long, length long")


def read_records(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """The records of the archives under `path`, all or those of the wanted record ids.

    Columns: record_id, source_id, url, record_type, payload_bytes, payload_digest, refers_to, block (null for
    revisits), frame, offset. Only frames that hold wanted records are unpacked, one at a time.
    """
    keep = None if wanted is None else set(wanted)
    names = ["record_id", "source_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "block", "frame", "offset"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    whole = lambda x: None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                data = data.as_py()
                by_frame: dict[int, list[tuple[str, int]]] = {}
                for record_id, k, offset, _ in record_index(data):
                    if keep is None or record_id in keep:
                        by_frame.setdefault(k, []).append((record_id, offset))
                for k, own in by_frame.items():
                    content, rows = frame(data, k), []
                    for record_id, offset in own:
                        h, block, _ = parse(content, offset)
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            block = block[block.index(CRLF + CRLF) + 4 :]
                        if kind == "response" and (digest32(block) != digest or len(block) != int(h["x-payload-length"])):
                            raise ValueError(f"the payload of {record_id} does not match its digest")
                        rows.append((record_id, whole(h.get("x-source-id")), h.get("warc-target-uri"), kind, int(h["x-payload-length"]), digest, whole(h.get("x-refers-to-source-id")), block if kind == "response" else None, k, offset))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _bundles(spark, path).mapInArrow(run, "record_id string, source_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary, frame int, offset long")
