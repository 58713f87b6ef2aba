"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole WARC records, and two skippable frames at its
end: a map of record identifiers to (frame, offset in the frame, length), and the seek table of frame sizes in the format
of Zstandard's seekable contribution. Ordinary decompressors read a bundle as one WARC file; a reader of one record needs
the footer and one frame. Bundles go to the shared folder through Arrow's file systems (file, hdfs, s3, gs ...)."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, new_folder

SKIPPABLE_MAP, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 128 << 20
FRAMES_A_TASK = 64
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None, sha1: str, copy: str = "") -> str:
    """A record's identifier: its page and payload, and for a row that repeats both in one bundle its place there."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{sha1}{copy and ':' + copy}>"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return None if page == "null" else int(page)


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, size: int, refers_to: int | None, identifier: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the payload's HTTP header and digest, and no payload."""
    revisit = payload is None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {identifier or urn(page_id, sha1)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to, sha1)}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; raises where lengths don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: {k.lower(): v.strip() for k, _, v in (y.partition(":") for y in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    size = int(warc["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a record's length doesn't fit: {warc}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _qualified(spark: SparkSession, folder: str) -> str:
    """folder with its scheme: one without belongs to the default file system, for executors as for Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", found)


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that names its scheme."""
    return pyarrow.fs.FileSystem.from_uri(folder)


class Bundle:
    """Writes one bundle, a frame at a time."""

    def __init__(self, folder: str, name: str):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        self.name, self.out = name, fs.open_output_stream(f"{path}/{name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.map: dict[str, tuple[int, int, int]] = {}
        self.part, self.size, self.written = [], 0, 0

    def add(self, key: str, data: bytes) -> None:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        self.map[key] = (len(self.frames), self.size, len(data))
        self.part.append(data)
        self.size += len(data)

    def flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self.part))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.part, self.size = [], 0

    def close(self) -> list[tuple[str, int]]:
        """Ends the bundle; its (name, frame) rows."""
        if self.size:
            self.flush()
        known = zstandard.ZstdCompressor(level=3).compress(json.dumps(self.map).encode())
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_MAP, len(known)) + known + struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        return [(self.name, i) for i in range(len(self.frames))]


class Reader:
    """Random access to a bundle's records."""

    def __init__(self, folder: str, name: str):
        fs, path = _open(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * count, end - 9 - 8 * count)))
        self.starts, at = [], 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed
        self.sizes = sizes
        kind, some = struct.unpack("<II", self.file.read_at(8, at))
        if kind != SKIPPABLE_MAP:
            raise ValueError(f"{name} has no record map")
        self.map = {k: tuple(v) for k, v in json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(some, at + 8))).items()}
        self.by_frame: dict[int, list[tuple[str, int, int]]] = {}
        for k, (f, start, length) in self.map.items():
            self.by_frame.setdefault(f, []).append((k, start, length))

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(self.sizes[i][0], self.starts[i]), max_output_size=self.sizes[i][1])

    def get(self, key: str) -> bytes:
        f, start, length = self.map[key]
        return self.frame(f)[start : start + length]


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes every row of pages as a record; gives the folder and its (bundle, frame) rows.

    Payloads are html in UTF-8, null as empty. Of rows with equal payloads of at least `least` bytes, that with the largest
    page_id is a response (each of them, where rows repeat it), the others revisit it. A null page_id is smaller than any,
    and is kept as null. The folder is new unless given, inside spark.checkpoint.dir; a task that runs again writes new
    bundles, and only those of the attempt that Spark kept are listed. A bundle's map has the records' WARC-Record-IDs; rows that
    repeat page_id and payload in several bundles have one identifier in each."""
    folder = _qualified(pages.sparkSession, folder or new_folder(pages.sparkSession, "warc"))
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_size", F.octet_length("html").cast("bigint"))
    last = base.where(F.col("_size") >= least).groupBy("_sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    rows = base.join(durable(last.select("_sha", "last"), "payloads"), "_sha", "left")
    revisit = F.col("last").isNotNull() & (F.coalesce(F.col("page_id") < F.col("last"), F.lit(True)))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "_sha", "_size", F.when(revisit, F.col("last")).alias("to"))

    def write(batches):
        bundle, serial, done = None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if bundle is None:
                    bundle = Bundle(folder, f"{uuid.uuid4().hex}.warc.zst")
                payload = None if r["html"] is None else r["html"].encode()
                sha1 = base64.b32encode(bytes.fromhex(r["_sha"])).decode()
                serial, name = serial + 1, urn(r["page_id"], sha1)
                if name in bundle.map:
                    name = urn(r["page_id"], sha1, str(serial))
                bundle.add(name, record(r["page_id"], r["url"], payload, sha1, r["_size"], r["to"], name))
                if bundle.written > BUNDLE_BYTES:
                    done += bundle.close()
                    bundle = None
        if bundle is not None:
            done += bundle.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["bundle", "frame"])

    return folder, durable(rows.mapInArrow(write, "bundle string, frame long"), "frames")


def read_archives(folder: str, frames: DataFrame) -> DataFrame:
    """RECORD rows of all records of these frames, from the bundles' own bytes; a payload that doesn't match its digest raises.

    A task reads about FRAMES_A_TASK frames, those of one stretch of a bundle together."""

    def read(batches):
        readers: dict[str, Reader] = {}
        for batch in batches:
            out = []
            for name, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in readers:
                    readers = {name: Reader(folder, name)}
                r = readers[name]
                data = r.frame(i)
                for _key, start, length in r.by_frame[i]:
                    warc, http, payload = parse(data[start : start + length])
                    page, to = page_of(warc["warc-record-id"]), page_of(warc.get("warc-refers-to", urn(None, "")))
                    kind, size, sha1 = warc["warc-type"], int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
                        raise ValueError(f"the payload of {page} in {name} doesn't match its digest")
                    out.append((page, size, sha1, kind, to))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = max(1, -(-frames.count() // FRAMES_A_TASK))
    dealt = frames.repartition(tasks, "bundle", F.expr(f"frame div {FRAMES_A_TASK}")).sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(read, RECORD)
