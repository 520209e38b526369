"""Media columns: archives of PNG members, read by a Spark data source of byte ranges.

The source plans ranges of the archives' bytes; a range owns the members whose headers begin in it, streams them in Arrow
batches of bounded size and retries each member on its own, from its offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import materialize, workdir
from .storage import Writer, open_input, sizes

WIDTH = 192
#: An archive is closed at this many bytes or members (a zip archive without 64-bit fields holds 65,535).
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 256 << 20, 60_000
RANGE_BYTES, BATCH_BYTES, RETRIES = 64 << 20, 4 << 20, 3
#: Partitions of a scan about, however large the folder: ranges grow beyond it.
PARTITIONS = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"


def to_payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image, WIDTH samples a row, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    scan = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; every chunk's checksum is verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body = 8, b""
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        body += data if kind == b"IDAT" else b""
        at += 12 + size
    scan = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows aren't read")
    return scan[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and an 8 by 8 average hash of the image."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    edges = np.arange(9) * len(x) // 8
    bands = np.array([x[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean((0, 2)) for a, b in zip(np.minimum(edges[:-1], len(x) - 1), edges[1:])])
    bits = np.packbits(bands > bands.mean()).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{bits}"


class _Zip:
    """A zip archive of stored members, written front to back."""

    def __init__(self, uri: str) -> None:
        self.out, self.central = Writer(uri), []

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        common = (20, 0x800, 0, 0, 33)  # version, UTF-8 names, stored, midnight of 1980-01-01
        self.central.append(struct.pack(_CENTRAL, b"PK\1\2", 20, *common, crc, len(data), len(data), len(raw), 0, 0, 0, 0, 0, self.out.size) + raw)
        self.out.write(struct.pack(_LOCAL, b"PK\3\4", *common, crc, len(data), len(data), len(raw), 0) + raw)
        self.out.write(data)

    def close(self) -> tuple[int, int]:
        start, directory = self.out.size, b"".join(self.central)
        self.out.write(directory + struct.pack(_END, b"PK\5\6", 0, 0, len(self.central), len(self.central), len(directory), start, 0))
        self.out.close()
        return len(self.central), self.out.size


def _members(f) -> Iterator[tuple[int, int, int, str]]:
    """Offset, size, checksum and name of the members of an open archive, by offset."""
    f.seek(f.size() - struct.calcsize(_END))
    _, _, _, _, n, size, start, _ = struct.unpack(_END, f.read())
    f.seek(start)
    raw, at = f.read(size), 0
    for _ in range(n):
        x = struct.unpack_from(_CENTRAL, raw, at)
        at += struct.calcsize(_CENTRAL)
        yield x[16], x[8], x[7], raw[at : at + x[10]].decode()
        at += x[10] + x[11] + x[12]


class MemberError(IOError):
    pass


def _read_at(f, offset: int, size: int, crc: int) -> bytes:
    f.seek(offset)
    head = struct.unpack(_LOCAL, f.read(struct.calcsize(_LOCAL)))
    data = f.read(head[9] + head[10] + size)[head[9] + head[10] :]
    if head[0] != b"PK\3\4" or zlib.crc32(data) != crc:
        raise MemberError("checksum differs")
    return data


def read_member(uri: str, offset: int, size: int, crc: int, retries: int = RETRIES) -> bytes:
    """One member's bytes, verified; a failed read is tried again from the member's offset, the archive opened anew."""
    for attempt in range(retries + 1):
        try:
            with open_input(uri) as f:
                return _read_at(f, offset, size, crc)
        except (OSError, struct.error) as e:
            if attempt == retries:
                raise MemberError(f"{uri} at {offset}: {e}") from e
            time.sleep(0.1 * 2**attempt)
    raise AssertionError


class Ranges(InputPartition):
    """Byte ranges (archive, start, end) that one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        self.pieces = pieces


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.null_on_error = options.get("onerror", "fail") == "null"

    def partitions(self) -> list[Ranges]:
        found = sizes(self.folder, ".zip")
        if sizes(self.folder, "manifest.json"):
            with open_input(f"{self.folder}/manifest.json") as f:
                listed = set(json.loads(f.read()))
            found = [x for x in found if x[0] in listed]
        step = max(self.range_bytes, sum(n for _, n in found) // PARTITIONS)
        out, held = [[]], 0
        for name, size in found:
            for a in range(0, size, step):
                e = min(a + step, size)
                if held + e - a > step and out[-1]:  # small archives share a task
                    out.append([])
                    held = 0
                out[-1].append((name, a, e))
                held += e - a
        return [Ranges(x) for x in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for archive, start, end in partition.pieces:
            uri = f"{self.folder}/{archive}"
            with open_input(uri) as f:
                for offset, size, crc, name in _members(f):
                    if not start <= offset < end:
                        continue
                    rows.append((archive, offset, name, self._media(f, uri, offset, size, crc)))
                    held += size
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _media(self, f, uri: str, offset: int, size: int, crc: int) -> bytes | None:
        """Members stream through the open archive; one that fails is read again on its own."""
        try:
            return _read_at(f, offset, size, crc)
        except (OSError, struct.error):
            try:
                return read_member(uri, offset, size, crc, self.retries)
            except MemberError:
                if not self.null_on_error:
                    raise
                return None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["archive", "offset", "name", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("member_archive").load(folder): archive, offset, name and media of every member.

    Options: rangeBytes, retries, and onError: fail (default) or null (a member that can't be read has null media). If
    the folder has a manifest.json (a list of names), only the archives it lists are read.
    """

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RangeReader(self.options)


def _archiver(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, name, done = None, "", []
        attempt = uuid.uuid4().hex  # archives of failed attempts are in no manifest
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if archive is None:
                    name = f"part-{attempt}-{len(done):05d}.zip"
                    archive = _Zip(f"{folder}/{name}")
                n = len((text or "").encode("utf-8", "surrogatepass"))
                archive.add(f"{len(archive.central):05d}_{n}_{'' if doc_id is None else doc_id}.png", to_png(to_payload(text)))
                if archive.out.size >= ARCHIVE_BYTES or len(archive.central) >= ARCHIVE_MEMBERS:
                    done.append((name, *archive.close()))
                    archive = None
        if archive:
            done.append((name, *archive.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["archive", "members", "bytes"])

    return run


def write_archives(documents: DataFrame, folder: str) -> DataFrame:
    """Write every row's text as a PNG member of an archive in folder; returns the manifest: archive, members, bytes."""
    d = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    done = materialize(d.mapInArrow(_archiver(folder), "archive string, members long, bytes long"), "manifest")
    out = Writer(f"{folder}/manifest.json")  # names only: one for each ARCHIVE_BYTES at most, or each task
    out.write(json.dumps([r.archive for r in done.select("archive").toLocalIterator()]).encode())
    out.close()
    return done


def read_archives(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("member_archive").options(**options).load(folder)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for name, media in zip(b.column("name").to_pylist(), b.column("media").to_pylist()):
            _, n, doc_id = name.removesuffix(".png").split("_", 2)
            p = from_png(media)
            rows.append((doc_id or None, int(n), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
        if rows:
            s, i = pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (s, i, i, s, i, i, s, s))], DESCRIBED)


DESCRIBED = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(documents: DataFrame) -> DataFrame:
    """Write the documents' texts as media and describe what is read back: the columns of DESCRIBED.

    One row for each input row, repeated rows too. A null text is empty: one row of blanks. A null or empty-string
    doc_id comes back as null; other types return through their text form, of 65,000 bytes at most (a member's name).
    """
    spark = documents.sparkSession
    folder = workdir(spark, "media")
    write_archives(documents, folder)
    kind = dict(documents.dtypes)["doc_id"]
    out = read_archives(spark, folder).select("name", "media").mapInArrow(
        _describe, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
