"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding several whole
WARC/1.1 records, and a footer: the seek table of the Zstandard seekable format
(a skippable frame of compressed and decompressed frame sizes).  The index maps
a record id to (bundle, frame, offset in the frame, length), so one record is
read by one seek and one frame.

Bundles are rows (bundle, content, records) of a table in a folder that every
executor reaches, written by Spark's committed writer, so that a lost task leaves
no half archive; ``content`` is the archive file byte for byte and ``records`` the
index of its records, made by the same task.

Equal payloads are stored once: the record of the largest id is ``response``,
the others are ``revisit`` records that name it.

Defined results: null html has an empty payload; payloads below ``least_bytes``
are never shared; every row is a record of its own, also where ids repeat: rows
of one id are told apart by their payload, and rows that have both the largest id
and its payload are all responses; a null id is never named, and equal payloads
without any id are all responses; ids may be of any type; an empty table gives no
bundle; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satspan.llm.common import materialize

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
LEVEL = 3
#: Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

#: Revisit marks that are broadcast at most, of about 100 bytes each.
BROADCAST_MARKS = 200_000

BUNDLE = "bundle string, content binary, n_records long, records array<struct<id string, frame int, frame_offset long, record_bytes long>>"
RECORD = (
    "id string, url string, payload_bytes long, payload_digest string, record_type string, refers string,"
    " bundle string, frame int, frame_offset long, record_bytes long"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _urn(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else '=' + quote(page_id)}>"


def _id_of(urn: str) -> str | None:
    return unquote(urn[11:-1]) if urn[10:11] == "=" else None


def encode_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit holds headers only."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def decode_records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of the records of one frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at offset {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        body = frame[end + 4 : end + 4 + size]
        if len(body) != size or frame[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"truncated WARC record at offset {at}")
        yield at, end + 8 + size - at, head, body
        at = end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer of (compressed, decompressed) frame sizes."""
    rows = b"".join(struct.pack("<II", *x) for x in sizes)
    body = rows + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, read from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    places, at = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - k))
        places.append((at, packed, size))
        at += packed
    return places


def read_frame(content: bytes, frame: int) -> bytes:
    at, packed, size = frame_places(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)


def read_record(content: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    _, _, head, body = next(decode_records(read_frame(content, frame)[offset : offset + length]))
    return head, body


class _Writer:
    """Fills frames and bundles; a record never spans two frames."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.sizes, self.frame, self.key = io.BytesIO(), [], [], hashlib.sha1()
        self.frame_bytes = 0
        self.places: list[dict] = []

    def add(self, page_id: str | None, record: bytes) -> None:
        self.places.append({"id": page_id, "frame": len(self.sizes), "frame_offset": self.frame_bytes, "record_bytes": len(record)})
        self.frame.append(record)
        self.frame_bytes += len(record)
        if self.frame_bytes >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.frame:
            raw = b"".join(self.frame)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.key.update(packed)
            self.sizes.append((len(packed), len(raw)))
            self.frame, self.frame_bytes = [], 0

    def full(self) -> bool:
        return self.out.tell() >= BUNDLE_BYTES

    def end(self) -> pa.RecordBatch:
        self.end_frame()
        content = self.out.getvalue() + seek_table(self.sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.key.hexdigest()]), pa.array([content], pa.binary()), pa.array([len(self.places)], pa.int64()), pa.array([self.places], _PLACES)],
            ["bundle", "content", "n_records", "records"],
        )


_PLACES = pa.list_(pa.struct([("id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())]))


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = _Writer()
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "url", "html", "refers")]
        for i in range(batch.num_rows):
            page_id, url, html, refers = (c[i].as_py() for c in cols)
            payload = (html or "").encode()
            writer.add(page_id, encode_record(page_id, url, payload, base32_sha1(payload), refers))
            if writer.full():
                yield writer.end()
                writer = _Writer()
    if writer.places:
        yield writer.end()


def _read(bundle: str, content: bytes, places: list[dict]) -> pa.RecordBatch:
    """The records at some places of a bundle; each frame is unpacked once."""
    rows, frame, raw = [], None, b""
    for place in places:
        k, at, length = place["frame"], place["frame_offset"], place["record_bytes"]
        if k != frame:
            frame, raw = k, read_frame(content, k)
        _, size, head, body = next(decode_records(raw[at : at + length]))
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        own = _id_of(head["WARC-Record-ID"])
        if size != length or own != place["id"]:
            raise ValueError(f"the index is wrong in bundle {bundle}, frame {k}, offset {at}")
        if head["WARC-Type"] == "response" and base32_sha1(body) != digest:
            raise ValueError(f"payload digest differs in bundle {bundle}, frame {k}, offset {at}")
        refers = head.get("WARC-Refers-To")
        rows.append((own, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers and _id_of(refers), bundle, k, at, length))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RECORD.split(", ")])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            bundle, content, places = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("bundle", "content", "records"))
            for _, group in groupby(places, key=lambda x: x["frame"]):
                yield _read(bundle, content, list(group))


def _digest() -> Column:
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat another's payload."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    keyed = materialize(pages.where(size >= least_bytes).select("page_id", _digest().alias("digest")), "warc-digests")
    shared = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    marked = keyed.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return materialize(marked.select("page_id", "digest", "refers_to").distinct(), "warc-revisits")


def write(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to bundles; returns the written table of bundles.

    Pages meet their marks by id and payload digest. The marks are broadcast if
    counted few, and the html is then not shuffled.
    """
    pages = pages.select("page_id", "url", "html")
    marks = revisits(pages, least_bytes)
    few = marks.count() <= BROADCAST_MARKS
    marks = marks.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    marked = pages.withColumn("digest", _digest()).join(
        F.broadcast(marks) if few else marks, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    )
    rows = marked.select(F.col("page_id").cast("string").alias("id"), "url", "html", F.col("refers_to").cast("string").alias("refers"))
    return materialize(rows.mapInArrow(_bundled, BUNDLE), "warc-bundles")


def index(bundles: DataFrame) -> DataFrame:
    """id, bundle, frame, frame_offset and record_bytes of every record, as
    written with the bundles; their content is not read."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.id", "bundle", "r.frame", "r.frame_offset", "r.record_bytes")


def _typed(records: DataFrame, kind: str) -> DataFrame:
    return records.select(F.col("id").cast(kind).alias("page_id"), "*", F.col("refers").cast(kind).alias("refers_to")).drop("id", "refers")


def read(bundles: DataFrame, kind: str = "long") -> DataFrame:
    """One row per record of the bundles, read at its place in the index;
    ``kind`` is the type of the page ids."""
    return _typed(bundles.select("bundle", "content", "records").mapInArrow(_records, RECORD), kind)


def seek(bundles: DataFrame, ids: DataFrame, kind: str = "long") -> DataFrame:
    """The records of the given ``ids(page_id)``: only the bundles and frames that
    the index names are unpacked. A null id finds the records without one."""
    wanted = ids.select(F.col("page_id").cast("string").alias("_id")).distinct()
    places = index(bundles).join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    place = F.struct("frame", "frame_offset", "id", "record_bytes")
    named = places.groupBy("bundle").agg(F.array_sort(F.collect_list(place)).alias("records"))  # a bundle's records at most
    return _typed(bundles.select("bundle", "content").join(named, "bundle").mapInArrow(_records, RECORD), kind)
