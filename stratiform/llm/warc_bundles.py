"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about `FRAME` bytes; frames follow each other in bundle files
of about `BUNDLE` bytes in the shared folder. A bundle ends with a seek table, a skippable frame with the compressed and
full size of each frame, so any reader can jump to a frame. The index maps a record's identifier to its bundle, its
frame and its offset within the frame. Reading goes by the index: a frame is unpacked once for all records asked of it.

Records with equal payloads of at least `min_bytes` bytes are found by SHA-1 and length: the one with the largest key is
the response, others revisit it. Only (key, digest, length) is shuffled for that; payloads move once, by key.

Bundle names hold the task attempt, and index rows name the bundle of the attempt that succeeded, so a lost executor or a
second attempt leaves at most an unused file. A task holds one frame and its compressed form.

Nulls and edge cases: a null payload is an empty one; a null URL is written as an empty target; line ends in a URL are
percent-encoded; a null key never revisits nor is revisited; rows that repeat a key with the response's payload are
responses too; an empty table gives an empty index; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.frames import shared_folder, stored

FRAME = 256 << 10
BUNDLE = 256 << 20
# Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:record:{'' if key is None else key}>"


def key_of(record: str | None) -> str | None:
    return (record.removeprefix("<urn:record:").removesuffix(">") or None) if record else None


def write_record(key: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of the record at the start of the bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class BundleWriter:
    """Writes frames to one bundle at a time and says where each record went."""

    def __init__(self, folder: str, frame: int, bundle: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        task = TaskContext.get()
        self.name = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "0"
        self.frame, self.bundle, self.made = frame, bundle, 0
        self.out, self.pending, self.size, self.pack = None, [], 0, zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, name: str, record: bytes) -> Iterator[tuple]:
        self.pending.append((name, record))
        self.size += len(record)
        if self.size >= self.frame:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.pending:
            return
        if self.out is None:
            self.file = f"{self.name}-{self.made:04d}.warc.zst"
            self.out, self.table = self.fs.open_output_stream(f"{self.path}/{self.file}", compression=None), []
            self.made += 1
        whole = b"".join(r for _, r in self.pending)
        packed = self.pack.compress(whole)
        self.out.write(packed)
        at = 0
        for name, record in self.pending:
            yield name, self.file, len(self.table), at, len(record)
            at += len(record)
        self.table.append((len(packed), len(whole)))
        self.pending, self.size = [], 0
        if sum(a for a, _ in self.table) >= self.bundle:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            entries = b"".join(struct.pack("<II", a, b) for a, b in self.table)
            self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))
            self.out.close()
            self.out = None


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or descriptor & 0x80:
            raise ValueError(f"{name}: no seek table without checksums at the end")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.places, at = [], 0
        for packed, whole in sizes:
            self.places.append((at, packed, whole))
            at += packed
        self.kept = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            at, packed, whole = self.places[k]
            data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at))
            if len(data) != whole:
                raise ValueError("frame and seek table differ")
            self.kept = (k, data)
        return self.kept[1]

    def close(self) -> None:
        self.file.close()


def revisits(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """(key, refers_to) of the records that repeat the payload of a larger key."""
    body = F.coalesce(F.col(payload), F.lit(""))
    marks = pages.select(F.col(key).alias("k"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("n")).filter(F.col("k").isNotNull() & (F.col("n") >= min_bytes))
    largest = marks.groupBy("sha1", "n").agg(F.max("k").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return marks.join(largest, ["sha1", "n"]).filter(F.col("k") < F.col("refers_to")).select("k", "refers_to").distinct()


def write_bundles(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", frame: int = FRAME, bundle: int = BUNDLE) -> tuple[str, DataFrame]:
    """Writes one record a row; the folder of the bundles and the stored index."""
    folder = shared_folder(pages.sparkSession, "warc")
    again = revisits(pages, key, payload, min_bytes)
    slim = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("p"))
    rows = slim.join(again, "k", "left").select(F.col("k").cast("string"), "u", "p", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, index = BundleWriter(folder, frame, bundle), []
        for batch in batches:
            for k, u, p, r in zip(*(c for c in batch.columns), strict=True):
                record = write_record(k.as_py(), u.as_py(), (p.as_py() or "").encode(), r.as_py(), date)
                index += writer.add(record_id(k.as_py()), record)
            if len(index) > 10_000:
                yield batch_of(index)
                index = []
        index += writer.flush()
        writer.close()
        if index:
            yield batch_of(index)

    return folder, stored(rows.mapInArrow(run, INDEX), "warc-index")


def batch_of(index: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], names=["record_id", "bundle", "frame", "offset", "length"])


def read_bundles(folder: str, index: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row a record of the index, read from its bundle: key, payload_bytes, payload_digest, record_type, refers_to (keys as
    text) and, if asked for, url and payload. The digest of a response is taken anew from what was read."""
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
    schema = ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if reader:
                        reader.close()
                    name, reader = row["bundle"], BundleReader(folder, row["bundle"])
                warc, http, payload = read_record(reader.frame(row["frame"])[row["offset"] : row["offset"] + row["length"]])
                kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(http["content-length"])):
                    raise ValueError(f"{row['record_id']}: payload and digest differ")
                found = (key_of(warc["warc-record-id"]), int(http["content-length"]), digest, kind, key_of(warc.get("warc-refers-to")))
                out.append((*found, warc["warc-target-uri"], payload) if with_payload else found)
                size += len(payload) if with_payload else 0
                if size > FRAME * 16:
                    yield rows_of(out, names)
                    out, size = [], 0
            if out:
                yield rows_of(out, names)
        if reader:
            reader.close()

    bundles = index.select("bundle").distinct().count()  # a task a bundle, however small the index
    return index.repartition(max(bundles, 1), "bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, schema)


def rows_of(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)
