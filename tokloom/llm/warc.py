"""WARC records in seekable Zstandard bundles (operator 8).

Records are grouped into frames that decompress on their own; a bundle ends in a
skippable frame with the seek table (compressed and plain size of every frame),
so a reader can find any frame from the end of the file. An index table maps
each record to its bundle, its frame and its place inside the frame.

Tasks write bundles below the given path through the store's own file system
(``pyarrow.fs`` for its scheme), under names unique to the attempt; the index is
a Spark table, committed as a whole, and only bundles it names count, so a task
that is lost or repeated leaves nothing behind that is read.

Defined results: null html is an empty payload, null url an empty target; a null
id is written as an empty name and read back as null; rows that repeat in id and
payload are all responses when theirs is the largest id; an empty table writes
no bundle and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the seekable format and of the records.
SEEK_FRAME_MAGIC, SEEK_TABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF2 = b"\r\n\r\n"

#: Reading tasks at most; beyond it a task reads several bundles in turn.
MAX_READ_TASKS = 100_000

INDEX = "page_id long, bundle string, frame long, frame_offset long, frame_bytes long, at long, length long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


class BundleWriter:
    """One bundle: records gathered into frames of about ``frame_bytes``."""

    def __init__(self, fs: pafs.FileSystem, path: str, frame_bytes: int, level: int):
        self.out = fs.open_output_stream(path, compression=None)   # the name must not set it
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes, self.parts, self.plain, self.written = frame_bytes, [], 0, 0
        self.table: list[tuple[int, int]] = []
        self.places: list[list] = []

    def add(self, page: int | None, record: bytes) -> None:
        self.places.append([page, len(self.table), self.plain, len(record)])
        self.parts.append(record)
        self.plain += len(record)
        if self.plain >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            frame = self.zstd.compress(b"".join(self.parts))
            self.out.write(frame)
            self.table.append((len(frame), self.plain))
            self.written += len(frame)
            self.parts, self.plain = [], 0

    def close(self) -> list[list]:
        """Writes the seek table; the places with their frames' offsets and sizes."""
        self.flush()
        body = b"".join(struct.pack("<II", *e) for e in self.table)
        body += struct.pack("<IBI", len(self.table), 0, SEEK_TABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(body)) + body)
        self.out.close()
        start = np.concatenate([[0], np.cumsum([c for c, _ in self.table])]).astype(int).tolist()
        return [[p, f, start[f], self.table[f][0], at, n] for p, f, at, n in self.places]


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame, read from the end of the file."""
    f.seek(f.size() - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_TABLE_MAGIC or flags & 0x7C:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    f.seek(f.size() - 9 - n * entry)
    body, out, at = f.read(n * entry), [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", body, i * entry)
        out.append((at, c, d))
        at += c
    return out


def page_urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool,
                date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + CRLF2
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {page_urn(page)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if is_revisit:
        head += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = http if is_revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF2 + block + CRLF2


def parse_records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """Place, length, record headers, HTTP headers and stored payload of the records of a frame."""
    at = 0

    def fields(raw: bytes) -> dict[str, str]:
        return {k: v for k, v in (x.split(": ", 1) for x in raw.decode().split("\r\n")[1:])}

    while at < len(frame):
        end = frame.index(CRLF2, at)
        head = fields(frame[at:end])
        block = frame[end + 4:end + 4 + int(head["Content-Length"])]
        split = block.index(CRLF2)
        after = end + 4 + len(block) + 4
        yield at, after - at, head, fields(block[:split]), block[split + 4:]
        at = after


def write_bundles(pages: DataFrame, path: str, min_bytes: int = 0, frame_bytes: int = 1 << 18,
                  bundle_bytes: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z",
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the index, itself a table below ``path``.

    Of equal payloads of at least ``min_bytes`` the largest id is the response
    that the others revisit.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("html"),
                        F.sha1(F.encode(raw, "UTF-8")).alias("sha"), F.octet_length(raw).alias("n"))
    narrow = rows.select("page_id", "sha", "n").where(F.col("n") >= min_bytes)
    top = narrow.groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # Only copies meet the join, and html never does: a hot payload's rows go by its id, not by its digest.
    revisits = (narrow.join(top, ["sha", "n"]).where("not (page_id <=> top)")
                .select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("top").alias("refers_to")).distinct())
    todo = (rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
            .select("page_id", "url", "html", "sha", "refers_to"))
    folder = f"{path.rstrip('/')}/bundles"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        bundle, name = None, ""

        def index() -> pa.RecordBatch:
            cols = list(zip(*bundle.close()))
            arrays = [pa.array(c, pa.int64()) for c in cols]
            return pa.RecordBatch.from_arrays([arrays[0], pa.array([name] * len(cols[0])), *arrays[1:]],
                                              ["page_id", "bundle", "frame", "frame_offset", "frame_bytes", "at", "length"])

        for b in batches:
            off, data = common.text_bytes(b.column("html"))
            view = memoryview(data)
            for i, (page, url, sha, ref) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha", "refers_to")))):
                if bundle is None:
                    name, made = f"{part:06d}-{attempt}-{made:04d}.warc.zst", made + 1
                    bundle = BundleWriter(fs, f"{base}/{name}", frame_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                bundle.add(page, make_record(page, url, bytes(view[off[i]:off[i + 1]]), digest, ref, ref is not None, date))
                if bundle.written >= bundle_bytes:
                    yield index()
                    bundle = None
        if bundle is not None:
            yield index()

    todo.mapInArrow(write, INDEX).write.parquet(f"{path.rstrip('/')}/index")
    return spark.read.parquet(f"{path.rstrip('/')}/index")


READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
        "bundle string, frame long, at long, payload binary")


def read_bundles(index: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles that the index names, one frame in memory at a time.

    A response whose payload does not have its digest is an error.
    """
    folder = f"{path.rstrip('/')}/bundles"
    bundles = index.select("bundle").distinct()
    # Names are small, bundles are not: a number given outright is not coalesced by their bytes.
    tasks = max(1, min(bundles.count(), MAX_READ_TASKS))

    def page(urn: str) -> int | None:
        v = urn[len("<urn:page:"):-1]
        return int(v) if v else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    for k, (at, size, plain) in enumerate(seek_table(f)):
                        f.seek(at)
                        frame = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=plain)
                        rows = []
                        for place, _, head, http, payload in parse_records(frame):
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"][5:]
                            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} is damaged")
                            rows.append((page(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind,
                                         page(head["WARC-Refers-To"]) if kind == "revisit" else None,
                                         head["WARC-Target-URI"], name, k, place, payload if with_payload else None))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), (
                                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
                                pa.int64(), pa.int64(), pa.binary()))],
                            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame",
                             "at", "payload"])

    return bundles.repartition(tasks).mapInArrow(read, READ)


def read_record(path: str, place: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its index row: a ranged read of one frame."""
    fs, base = file_system(f"{path.rstrip('/')}/bundles")
    with fs.open_input_file(f"{base}/{place['bundle']}") as f:
        f.seek(place["frame_offset"])
        frame = zstandard.ZstdDecompressor().decompress(f.read(place["frame_bytes"]))
    _, _, head, http, payload = next(parse_records(frame[place["at"]:place["at"] + place["length"]]))
    return head, http, payload


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as bundles into the shared folder and read back."""
    path = common.shared_path(spark, "op8-warc")
    index = write_bundles(common.read(spark, sf_dir, "pages"), path)
    return read_bundles(index, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
         ((strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 AS INT) + 1, 1)) - 1) * 16
          + strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 AS INT) + 2, 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INT)) & 31
         AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m"""
