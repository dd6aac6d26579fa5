"""Operator 10: WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records, and ends in a skippable frame that holds the
seek table (compressed and plain size of every frame). The index table maps a record to its bundle, frame and offset in
the frame. Of records with equal payloads the one with the smallest page_id is the response, the others are revisits.

Every attempt of a task writes bundles under names of its own, which appear only when whole; the index, which Spark commits
once a task, lists exactly the bundles of the attempts that count, so repeated tasks do no harm. A task reads whole bundles;
the bundles are dealt to as many tasks.

Defined results: null HTML is an empty payload; null page_id is allowed (never the response of a group that has another
page_id); rows with equal page_id and payload have the same role; a payload longer than a frame is a frame of its own; other
columns are left out; an empty table gives an archive without bundles.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm._shared import materialize, new_folder
from askloom.llm._store import locate, publish, task_number

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 27
INDEX = "bundle string, frame int, frame_offset long, record_offset long, record_bytes long, record_id string, page_id long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the digest and length of the full payload, and no payload."""
    block = b"" if revisit else HTTP_HEAD + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class Bundle:
    """Writes frames to one file and its seek table at the end."""

    def __init__(self, out, level: int = 6) -> None:
        import zstandard

        self.out, self.sizes, self.at, self.plain = out, [], 0, bytearray()
        self.zstd = zstandard.ZstdCompressor(level=level)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, its offset in the file, offset of the record in the frame)."""
        if self.plain and len(self.plain) + len(record) > FRAME_BYTES:
            self.flush()
        where = (len(self.sizes), self.at, len(self.plain))
        self.plain += record
        return where

    def flush(self) -> None:
        if self.plain:
            frame = self.zstd.compress(bytes(self.plain))
            self.out.write(frame)
            self.sizes.append((len(frame), len(self.plain)))
            self.at += len(frame)
            self.plain = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of an open file."""
    size = source.size()
    source.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    source.seek(size - 9 - 8 * frames)
    entries, out, at = struct.iter_unpack("<II", source.read(8 * frames)), [], 0
    for packed, plain in entries:
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(source, offset: int, packed: int, plain: int) -> bytes:
    import zstandard

    source.seek(offset)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the rows whose payload an earlier page_id has."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = materialize(pages.filter(F.length(payload) >= least).select("page_id", F.sha1(payload).alias("digest")), "warc-digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    others = slim.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return materialize(others.select("page_id", "digest", "refers_to").distinct(), "warc-revisits")


def write_archive(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html) -> bundles under folder/bundles; returns the index table, written under folder/index."""
    spark = pages.sparkSession
    links = revisits(pages, least)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload"), F.when(F.length(payload) >= least, F.sha1(payload)).alias("digest"))
    r = links.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to", F.lit(True).alias("revisit"))
    joined = p.join(r, p["page_id"].eqNullSafe(r["r_page"]) & (p["digest"] == r["r_digest"]), "left").select("page_id", "url", "payload", "refers_to", "revisit")

    def write(batches):
        import pyarrow as pa

        task, attempt, number, done = task_number(), uuid.uuid4().hex[:8], 0, False
        source = ((x, b) for b in batches for x in zip(*(b.column(i) for i in range(5)), strict=True))
        while not done:
            name, first = f"bundles/{task:06d}-{attempt}-{number:04d}.warc.zst", next(source, None)
            if first is None:
                return
            number += 1
            with publish(f"{folder}/{name}") as out:
                bundle, rows = Bundle(out), []
                while first is not None:
                    page, url, body, refers, again = (x.as_py() for x in first[0])
                    record = record_bytes(page, url, body, refers, bool(again), date)
                    frame, offset, inside = bundle.add(record)
                    rows.append((name, frame, offset, inside, len(record), f"<urn:page:{page}>", page))
                    first = None if bundle.at + len(bundle.plain) > BUNDLE_BYTES else next(source, None)
                bundle.close()
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    joined.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def as_row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    number = lambda text: None if text == "None" else int(text)
    page = number(head["warc-record-id"][len("<urn:page:") : -1])
    digest = head["warc-payload-digest"].partition(":")[2]
    if head["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of page {page} does not have its digest")
        return page, head["warc-target-uri"], "response", len(payload), digest, None, payload if with_payload else None
    return page, head["warc-target-uri"], "revisit", int(head["x-payload-length"]), digest, number(head["warc-refers-to"][len("<urn:page:") : -1]), None


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_archive(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles that the index lists, read frame by frame through the seek tables."""

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = locate(f"{folder}/{name}")
                with system.open_input_file(path) as source:
                    for entry in seek_table(source):
                        yield _batch([as_row(h, b, with_payload) for h, b in parse_records(read_frame(source, *entry))])

    bundles = materialize(index.select("bundle").distinct(), "warc-bundles")
    return bundles.repartition(max(1, bundles.count())).mapInArrow(read, RECORD)


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of wanted(page_id), each read from its own frame only."""

    def read(batches):
        for batch in batches:
            rows = []
            for name, frame, inside, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                system, path = locate(f"{folder}/{name}")
                with system.open_input_file(path) as source:
                    plain = read_frame(source, *seek_table(source)[frame])
                rows += [as_row(h, b, True) for h, b in parse_records(plain[inside : inside + size])]
            if rows:
                yield _batch(rows)

    hits = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return hits.select("bundle", "frame", "record_offset", "record_bytes").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to a new archive in the shared folder and reads it back."""
    spark: SparkSession = pages.sparkSession
    folder = new_folder(spark, "warc-" + uuid.uuid4().hex[:4])
    return read_archive(write_archive(pages, folder, least), folder)
