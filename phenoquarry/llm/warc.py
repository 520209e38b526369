"""WARC archives with an index that is merged externally.

Writers close an archive after a bounded number of bytes and write its index run, sorted by URL key, timestamp and page,
beside it. Runs are merged by a k-way loser tree: in passes of FAN_IN runs until few are left, then by key ranges, one
task each, which together hold the captures in global order. Records are read back at the places the merged index names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_enough, workdir
from .storage import Writer, open_input

ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
FAN_IN = 128
#: Entries in a block of a run, blocks in a block of its index, and places of a small run that help to choose key ranges.
BLOCK, INDEX_BLOCK, FENCES = 512, 256, 16
RANGE_ENTRIES = 200_000
BATCH_ROWS = 2_000
BROADCAST_ROWS = 500_000
_EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


# Index runs ----------------------------------------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels from the last to the first, then what follows; in lower case, without scheme."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    m = re.match(r"([^/?#]*)(.*)", rest, re.S)
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2].lower()}"


class RunWriter:
    """Sorted entries (lists that begin with URL key, timestamp, page number) in compressed blocks, with an index of two levels.

    Index blocks hold the first keys and places of BLOCK entries each and lie between the data; the footer lists the index
    blocks. Neither writer nor reader ever holds a whole run's index.
    """

    def __init__(self, uri: str) -> None:
        self.out, self.block, self.fences, self.top, self.n = Writer(uri), [], [], [], 0

    def add(self, entry: list) -> None:
        self.block.append(entry)
        self.n += 1
        if len(self.block) == BLOCK:
            self._flush()

    def _write(self, rows: list) -> list:
        data = zlib.compress(json.dumps(rows).encode(), 1)
        at = self.out.size
        self.out.write(data)
        return [at, len(data)]

    def _flush(self) -> None:
        if self.block:
            self.fences.append([self.block[0][:3], *self._write(self.block)])
            self.block = []
            if len(self.fences) == INDEX_BLOCK:
                self._flush_index()

    def _flush_index(self) -> None:
        if self.fences:
            self.top.append([self.fences[0][0], *self._write(self.fences)])
            self.last, self.fences = self.fences, []

    def close(self) -> tuple[int, list]:
        """Number of entries, and first keys spread over the run: a few of a small one, one of each index block of a large one."""
        self._flush()
        self._flush_index()
        foot = json.dumps(self.top).encode()
        self.out.write(foot + struct.pack("<Q", len(foot)))
        self.out.close()
        if len(self.top) > FENCES:
            return self.n, [x[0] for x in self.top]
        some = [x[0] for x in self.top] + [x[0] for x in self.last[1 :: max(1, len(self.last) // FENCES)]] if self.top else []
        return self.n, sorted(some)


def read_run(uri: str, low: list | None = None, high: list | None = None) -> Iterator[list]:
    """Entries with low <= key < high, block by block."""

    def within(rows: list) -> Iterator[list]:
        at = max(0, bisect.bisect_left(rows, low, key=lambda x: x[0]) - 1) if low else 0
        for first, offset, n in rows[at:]:
            if high and first >= high:
                return
            f.seek(offset)
            yield json.loads(zlib.decompress(f.read(n)))

    with open_input(uri) as f:
        f.seek(f.size() - 8)
        (size,) = struct.unpack("<Q", f.read(8))
        f.seek(f.size() - 8 - size)
        for fences in within(json.loads(f.read(size))):
            for entries in within(fences):
                for e in entries:
                    if (not low or e[:3] >= low) and (not high or e[:3] < high):
                        yield e


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, so the next winner costs one path of comparisons."""

    def __init__(self, sources: list[Iterator[list]]) -> None:
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a[:3], i) < (b[:3], j)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:  # first to arrive while the tree is built
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[list]:
        while (e := self.heads[w := self.tree[0]]) is not None:
            yield e
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


def _merge_group(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names in b.column("runs").to_pylist():
                name = f"merged-{uuid.uuid4().hex}.run"
                out = RunWriter(f"{folder}/{name}")
                for e in LoserTree([read_run(f"{folder}/{x}") for x in names]):
                    out.add(e)
                n, fences = out.close()
                yield _run_row([(name, n, fences)])

    return run


RUN = "run string, entries long, fences string"


def _run_row(done: list[tuple[str, int, list]]) -> pa.RecordBatch:
    names, n, fences = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64()), pa.array([json.dumps(x) for x in fences])], ["run", "entries", "fences"])


MERGED = "part int, position long, url_key string, captured_at string, page_id string, archive string, offset long, size long"


def _merge_ranges(folder: str, runs: list[str], bounds: list[list]):
    """bounds: first keys of all ranges but the first, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                low = bounds[part - 1] if part else None
                high = bounds[part] if part < len(bounds) else None
                rows, position = [], 0
                for key, at, _, page, archive, offset, size in LoserTree([read_run(f"{folder}/{x}", low, high) for x in runs]):
                    rows.append((part, position, key, at, page, archive, offset, size))
                    position += 1
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in MERGED.split(", ")])

    return run


def merge_runs(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """Capture histories in global order (part, then position within it) from sorted runs in a folder: the columns of MERGED."""
    n = runs.count()
    while n > FAN_IN:  # groups of about FAN_IN runs, which only their own tasks know
        groups = -(-n // FAN_IN)
        dealt = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.collect_list("run").alias("runs"))
        runs = materialize(dealt.repartition(groups, "g").select("runs").mapInArrow(_merge_group(folder), RUN), "runs")
        n = runs.count()
    rows = [(r.run, r.entries, r.fences) for r in runs.collect()]  # FAN_IN at most
    total = sum(x[1] for x in rows)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // RANGE_ENTRIES))
    fences = sorted(f for x in rows for f in json.loads(x[2]))
    bounds = sorted(fences[len(fences) * i // parts] for i in range(1, parts)) if fences else []
    bounds = [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]
    d = spark.range(0, len(bounds) + 1, 1, len(bounds) + 1)
    return d.mapInArrow(_merge_ranges(folder, [x[0] for x in rows], bounds), MERGED)


# Records -------------------------------------------------------------------------------------------------------------


def _date(page_id: str | None) -> str:
    """Pages carry no capture time: page n counts as captured n seconds (modulo 2**31) after the year 2000 began."""
    n = int(page_id) % (1 << 31) if page_id and re.fullmatch(r"-?\d+", page_id) else 0
    return (_EPOCH + timedelta(seconds=n)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _urn(page_id: str | None) -> str:
    """A record's name; any text survives it, and null is no text."""
    return "<urn:null>" if page_id is None else f"<urn:page:{quote(page_id, safe='', errors='surrogatepass')}>"


def _page(urn: str) -> str | None:
    return None if urn == "<urn:null>" else unquote(urn[10:-1], errors="surrogatepass")


def record(page_id: str | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: str | None, revisit: bool) -> bytes:
    """A WARC/1.1 record as a gzip member of its own: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_date(page_id)}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha1:{_base32(sha1_hex)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a response's digest is that of what was read."""
    raw = gzip.decompress(member)
    head, body = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page, kind = _page(fields["WARC-Record-ID"]), fields["WARC-Type"]
    if kind == "response" and (_base32(hashlib.sha1(payload).hexdigest()) != digest or len(payload) != size):
        raise ValueError(f"payload of page {page} isn't what was written")
    return page, size, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _archiver(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, done, out, entries = uuid.uuid4().hex, [], None, []
        name = ""

        def finish() -> None:
            out.close()
            index = RunWriter(f"{folder}/{name}.run")
            for e in sorted(entries, key=lambda e: e[:3]):
                index.add(e)
            done.append((f"{name}.run", *index.close()))

        for b in batches:
            for page, url, html, digest, refers, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))):
                if out is None:
                    name = f"pages-{attempt}-{len(done):05d}.warc.gz"
                    out, entries = Writer(f"{folder}/{name}"), []
                data = record(page, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers, revisit)
                number = int(page) if page and re.fullmatch(r"-?\d+", page) else -1
                entries.append([url_key(url), _date(page), number, page, name, out.size, len(data)])
                out.write(data)
                if out.size >= ARCHIVE_BYTES or len(entries) >= ARCHIVE_RECORDS:
                    finish()
                    out = None
        if out:
            finish()
        if done:
            yield _run_row(done)

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into archives in folder; returns their index runs.

    Of records with equal payloads (SHA-1), that with the largest page_id is the response and the others revisit it; null
    is below all ids, and rows that share the largest id are all responses. A null html is an empty payload.
    """
    kind = pages.schema["page_id"].dataType
    p = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    shared = p.groupBy("digest").agg(F.max("page_id").cast(kind).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared.select(F.col("digest").alias("d"), "keeper"), "shared")
    # Only digests that repeat are joined; beyond the bound the join is shuffled and its skewed partitions split.
    side = F.broadcast(shared) if small_enough(shared, BROADCAST_ROWS) else shared
    p = p.join(side, p["digest"] == side["d"], "left")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    refers = F.when(revisit, F.col("keeper").cast("string"))
    p = p.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", refers.alias("refers_to"), revisit.alias("revisit"))
    return materialize(p.mapInArrow(_archiver(folder), RUN), "runs")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, io.BytesIO()
        for b in batches:
            rows = []
            for archive, offset, size in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "size"))):
                if archive != name:
                    f.close()
                    name, f = archive, open_input(f"{folder}/{archive}")
                f.seek(offset)
                rows.append(parse(f.read(size)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
                kept = ("part", "position", "url_key", "captured_at")
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *cols], [*kept, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        f.close()

    return run


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """The records at the places that captures (MERGED) name, each archive read front to back."""
    at = captures.select("part", "position", "url_key", "captured_at", "archive", "offset", "size")
    at = at.repartition("archive").sortWithinPartitions("archive", "offset")
    schema = "part int, position long, url_key string, captured_at string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return at.mapInArrow(_reader(folder), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as WARC archives, merge their indexes and read every record back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at, and part and position (the
    place in the globally ordered capture history); one row for each input row.
    """
    spark = pages.sparkSession
    folder = workdir(spark, "warc")
    kind = pages.schema["page_id"].dataType
    captures = materialize(merge_runs(spark, folder, write_warc(pages, folder)), "captures")
    out = read_captures(captures, folder)
    return out.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
        "url_key", "captured_at", "part", "position",
    )
