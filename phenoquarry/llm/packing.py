"""Sequence packing: shortest-pack-first over the histogram of piece lengths, patterns joined back to pieces by rank."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

LENGTH = 2048
END = 1
#: Distinct word chunks whose ids a worker keeps.
KEPT = 800_000
#: Where a run of white space isn't cut at its last blank: the run may be one token, so such a text goes whole.
_RUN = re.compile("[\\s\u180e] (?![^\\s\u180e])")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level BPE's vocabulary has for each byte: itself if printable, else one from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class Chunks(dict):
    """Ids, as little-endian bytes, of text chunks that a byte-level BPE never merges across: from a blank on, or the text's first."""

    def __init__(self, tokenizer: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        #: Strings that the tokenizer takes out of a text before anything else: a text with one goes whole.
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():  # one pre-token: straight to the merges
            word = chunk.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)
            self[chunk] = ids = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
            return ids
        head, line, tail = chunk.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self[line] + self[tail]
        if chunk[-1:] in (".", ",") and chunk[-2:-1].isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = self.tokens(chunk)
        if len(chunk) < 100:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > KEPT:
            self.clear()
        if _RUN.search(text) or any(x in text for x in self.special):
            return self.tokens(text)
        words = text.split(" ")
        return b"".join(map(self.__getitem__, [words[0], *[" " + w for w in words[1:]]]))

    def tokens(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(1)
def _chunks(tokenizer: str, special_as_text: bool) -> Chunks:
    return Chunks(tokenizer, special_as_text)


def _cutter(tokenizer: str, length: int, end: int, with_ids: bool, special_as_text: bool):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, pid, seen = _chunks(tokenizer, special_as_text), TaskContext.get().partitionId(), Counter()
        for b in batches:
            row, start, size, crc, total, rank, ids = [], [], [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                data = chunks.of(text or "") + last
                n = len(data) // 4
                for s in range(0, n, length):
                    part = data[4 * s : 4 * (s + length)]
                    m = len(part) // 4
                    row.append(k), start.append(s), size.append(m), crc.append(zlib.crc32(part)), total.append(n), rank.append(seen[m])
                    seen[m] += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, size, crc, total)], pa.array([pid] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "rank", *["ids"] * with_ids])

    return run


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, piece lengths) for pieces of the given lengths.

    Lengths are placed longest first. Each goes into the packs with most room, a whole pattern's packs at a time; where
    fewer pieces are left than the pattern has packs, the pattern is split. Without room, packs are opened.
    """
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        fresh: list[tuple[int, int, tuple[int, ...]]] = []
        while left:
            room = max((r for r, packs in by_room.items() if packs and r >= size), default=0)
            if room:
                n, pattern = by_room[room].pop()
                if n > left:
                    by_room[room].append((n - left, pattern))
                    n = left
                by_room[room - size].append((n, (*pattern, size)))
            else:
                per = length // size  # as many of this length as fit: they'd be placed one by one otherwise
                n = max(1, left // per)
                per = min(per, left)
                fresh.append((n, length - per * size, (size,) * per))
                n *= per
            left -= n
        for n, room, pattern in fresh:
            by_room[room].append((n, pattern))
    return sorted((p for packs in by_room.values() for p in packs), key=lambda p: (p[1], p[0]), reverse=True)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Columns length, first rank, first sequence, offset: ordered by length and rank. Bounded by the lengths, not the pieces."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for n, pattern in patterns:
        offset = 0
        for size in pattern:
            out.append((size, rank[size], sequence, offset))
            rank[size] += n
            offset += size
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _placer(table: np.ndarray):
    keys = table[:, 0] << 48 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, size.astype(np.int64) << 48 | rank, "right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            rest = [c for c in b.schema.names if c not in ("rank",)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(sequence), pa.array(table[at, 3])], [*rest, "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array) if with_ids is set.

    Every row is a document of its own (repeated rows too): its ids and the end id, cut into pieces of `length` and a
    rest. A null text is empty and so one end id. An empty table gives an empty result. Special tokens' strings in a text
    become their ids, as the tokenizer has it, or ordinary text if special_as_text is set.
    """
    d = documents.select("doc_id", "text")
    long = T.LongType()
    fields = [d.schema["doc_id"], *[T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens")], T.StructField("pid", T.IntegerType()), T.StructField("rank", long)]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    pieces = materialize(d.mapInArrow(_cutter(tokenizer, length, end, with_ids, special_as_text), T.StructType(fields)), "pieces")
    # Ranks within a task become ranks over all: each task's count for each length, summed over the tasks before it.
    counts = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `length` rows at most
    table = slots(pack_histogram(histogram, length))
    ranked = pieces.join(counts.drop("n").hint("merge"), ["length", "pid"])  # it grows with the tasks: not to be broadcast
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = ranked.select(*names, "rank")
    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", long), T.StructField("offset", long)])
    return ranked.mapInArrow(_placer(table), schema)
