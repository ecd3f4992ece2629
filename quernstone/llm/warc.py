"""WARC archives in seekable Zstandard bundles, and reading them back by record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shared_folder
from .runs import runs

MIN_REVISIT_BYTES = 1_000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20

# Fixed values of the seekable format: skippable frame, footer.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1

_INDEX = "bundle string, frame int, at int, length int"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder (a path or URI), by pyarrow: Hadoop's names of
    object stores are taken as theirs."""
    for name, own in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://"), ("wasbs://", "abfs://")):
        if folder.startswith(name):
            folder = own + folder.removeprefix(name)
    return fs.FileSystem.from_uri(folder)


class BundleWriter:
    """Frames that can be read alone, and at the end their sizes as a seek table."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.out, self.sizes, self.buffer, self.written = store.open_output_stream(path, compression=None), [], bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, record: bytes, frame_bytes: int) -> tuple[int, int, int]:
        """(frame, offset within the uncompressed frame, length) of the record."""
        if self.buffer and len(self.buffer) + len(record) > frame_bytes:
            self._frame()
        place = len(self.sizes), len(self.buffer), len(record)
        self.buffer += record
        return place

    def _frame(self) -> None:
        packed = self.packer.compress(bytes(self.buffer))
        self.out.write(packed)
        self.written += len(packed)
        self.sizes.append((len(packed), len(self.buffer)))
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entries = struct.iter_unpack("<II", self._read(end - 9 - 8 * count, 8 * count))
        self.places, at = [], 0
        for packed, whole in entries:
            self.places.append((at, packed, whole))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, whole = self.places[k]
        return self.unpacker.decompress(self._read(at, packed), max_output_size=max(1, whole))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit (without payload) of the record refers_to."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says of its page; a response's payload is hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: None if fields[name] == "<urn:page:None>" else int(fields[name][10:-1])
    out = {"page_id": number("WARC-Record-ID"), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": number("WARC-Refers-To")}
    payload = block.partition(b"\r\n\r\n")[2]
    if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes every row of pages(page_id, url, html) as a record into bundles in
    folder (a path or URI that all tasks reach); returns the index, checkpointed:
    page_id, bundle, frame, at (offset within the frame), length.

    Of rows with an equal payload of at least min_revisit_bytes, those with the largest
    page_id are responses and the others revisit it; other rows are responses.
    Null html is an empty payload, null urls are empty; rows with a null page_id are
    responses, and records of repeated rows repeat. Equal payloads are found by digest
    with a partial aggregation; only groups of two or more are joined back, and payloads under
    min_revisit_bytes (all empty ones share a digest) are not shuffled at all. A task that
    runs again writes files of a new name; the index names those of the run that
    counted and is the folder's manifest: bundles that it doesn't name are left from lost
    attempts and may be deleted.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= min_revisit_bytes
    groups = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    columns = ["page_id", "url", "payload", "digest"]
    decided = rows.filter(large).join(groups, "digest", "left").select(*columns, F.when(F.col("page_id") != F.col("original"), F.col("original")).alias("refers_to"))
    decided = decided.unionByName(rows.filter(~large).select(*columns, F.lit(None).cast("long").alias("refers_to")))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        bundle, name, n = None, "", 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "bundle", "frame", "at", "length")}
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None or bundle.written > bundle_bytes:
                    if bundle:
                        bundle.close()
                    name, n = f"{TaskContext.get().partitionId():06d}-{n:04d}-{uuid.uuid4().hex}.warc.zst", n + 1
                    bundle = BundleWriter(store, f"{base}/{name}")
                place = bundle.add(record(page_id, url, payload, digest, refers_to, date), frame_bytes)
                for k, v in zip(out, (page_id, name, *place), strict=True):
                    out[k].append(v)
            if out["page_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32())]))
        if bundle:
            bundle.close()

    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    return cut(decided.mapInArrow(write, f"page_id long, {_INDEX}"))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the index's
    records, each taken from its frame; a frame is unpacked once."""

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, reader = None, None
        for t in runs(batches, 2):
            if t.column(0)[0].as_py() != name:
                name = t.column(0)[0].as_py()
                reader = BundleReader(store, f"{base}/{name}")
            frame = reader.frame(t.column(1)[0].as_py())
            found = [parse(frame[a : a + n]) for a, n in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    places = index.select("bundle", "frame", "at", "length")
    tasks = places.select("bundle").distinct().count()  # index bytes don't show the payloads: a fixed number of tasks stays
    return places.repartition(max(1, tasks), "bundle").sortWithinPartitions("bundle", "frame", "at").mapInArrow(fetch, _RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(read(spark, sf_dir, "pages"), folder), folder)


ORACLE_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p
), r as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as original from d
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> original then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> original then original end as refers_to
from r
"""
