"""WARC records in seekable Zstandard bundles.

Each task writes bundles of its records to shared storage: groups of records are independent frames, and a
footer in a skippable frame (the public seekable format) lists every frame's sizes, so that any Zstandard reader
reads a bundle and a reader that knows the footer decompresses one frame only.  The index maps a record to its bundle, frame, and
offset within the decompressed frame.

A task writes under a name of its own attempt and only names that reach the index count, so a task that is run
again leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark.llm.shipping import ship
from ledger_spark.session import scratch_path, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
LEAST_REVISIT = 100
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_INDEX = ("page_id long, bundle string, frame long, frame_at long, frame_size long, record_at long, record_size long")


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit carries the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The headers, HTTP head and payload of the record that `data` starts with."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def storage(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def footer(frames: list[tuple[int, int]]) -> bytes:
    """The seek table: compressed and decompressed size of each frame."""
    body = b"".join(struct.pack("<II", a, b) for a, b in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_footer(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes, out, at = struct.iter_unpack("<II", file.read(8 * count)), [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """An open bundle: records go to the current frame, frames to the file."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.path, self.file = path, store.open_output_stream(path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.at, self.held, self.size = 0, [], 0
        self.rows: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.rows.append((page_id, self.path, len(self.frames), self.at, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.pack(b"".join(self.held))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.done += [(*r[:4], len(packed), *r[4:]) for r in self.rows]
            self.at += len(packed)
            self.rows, self.held, self.size = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.file.write(footer(self.frames))
        self.file.close()
        return self.done


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write `records` (page_id, url, payload, digest, refers_to) to bundles below `folder`; their index."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = storage(folder)
        store.create_dir(root, recursive=True)
        bundle = None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                names=["page_id", "bundle", "frame", "frame_at", "frame_size", "record_at", "record_size"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                bundle = bundle or Bundle(store, f"{root}/{uuid.uuid4().hex}.warc.zst")
                bundle.add(page_id, record(page_id, url, payload, digest, refers_to))
                if bundle.at >= BUNDLE_BYTES:
                    yield rows(bundle.close())
                    bundle = None
        if bundle:
            yield rows(bundle.close())

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, _INDEX)


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records of `index`, read frame by frame and cut out by their offsets: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest is computed from its payload; a revisit's is that of its header.
    """
    ship(index.sparkSession)
    frames = index.groupBy("bundle", "frame_at", "frame_size").agg(
        F.collect_list(F.struct("record_at", "record_size")).alias("records"))  # a frame's records: bounded by its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = storage(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with store.open_input_file(row["bundle"]) as file:
                    file.seek(row["frame_at"])
                    data = unpack(file.read(row["frame_size"]))
                for r in row["records"]:
                    headers, http, payload = parse(data[r["record_at"]:r["record_at"] + r["record_size"]])
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if headers["WARC-Type"] == "response":
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"damaged record in {row['bundle']}")
                    page, refers = headers.get("WARC-Page-Id"), headers.get("WARC-Refers-To-Page-Id")
                    out.append((page and int(page), size, digest, headers["WARC-Type"], refers and int(refers), headers.get("WARC-Target-URI")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return frames.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def lookup(index: DataFrame, folder: str, page_ids: list[int]) -> DataFrame:
    """The records of `page_ids`, decompressing only their frames."""
    return read_bundles(index.where(F.col("page_id").isin(page_ids)), folder)


def deduplicated(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) as page_id, url, payload, digest, refers_to.

    A null html is an empty payload.  Of pages with equal payloads of `LEAST_REVISIT` bytes or more the smallest page_id is the
    response and the others refer to it; rows without page_id count as the largest, and stay responses if no row of
    theirs has one.  Repeated rows of the smallest page_id are all responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_REVISIT
    copies = pages.select("page_id", payload.alias("payload")).where(large).select(
        "page_id", F.sha2("payload", 256).alias("digest")).groupBy("digest").agg(
        F.min("page_id").cast("long").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    joined = keyed.where(large).join(copies, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return joined.union(keyed.where(~large).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = written(write_bundles(deduplicated(pages), folder), "warc-index")
    return read_bundles(index, folder).drop("url")


SQL1 = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, h, min(page_id) over (partition by h) as first from p)
select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest,
  case when octet_length(encode(h)) >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when octet_length(encode(h)) >= 100 and page_id <> first then first end as refers_to from q
"""
