"""Line dedup: exact copies by digest, near copies by a deletion-neighbourhood join, and the earliest line stays.

Lines are compared word by word, so white space doesn't count. Lines without a letter or digit stay. Of lines of any
other length exact copies go; near copies are lines within `edits` words of each other (changed, added or lost), of at
least WORDS_PER_EDIT words for each edit.

Near copies meet by deletion variants: what is left of a line when up to `edits` of its words are deleted, hashed. A
variant's key holds the places of the deletions where equal variants alone would not prove the bound, so a group needs
no pairs: its least line is every other one's partner, whose word edit distance is then verified. An exact filter comes
first and keeps the variants few: of edits + 1 segments of a line one is untouched, so only lines that share a segment
with another line emit variants, and only by deletions outside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, small_enough, text_key

#: Words that may differ, and words that a line needs for each of them.
EDITS, WORDS_PER_EDIT = 1, 8
#: Rows up to which keys or repeated lines are broadcast (24 bytes each at most); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows up to which shared segment keys are broadcast as filters (two to four bytes a key); beyond it they are joined by a shuffle.
FILTER_ROWS = 32_000_000
#: Text bytes that are parsed at once (a word is never cut).
PIECE = 1 << 20
SAME, SHORTER, LONGER = 0, 1, 2
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SAYS = np.zeros(256, bool)
_SAYS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_BASE))


class _Sums:
    """Prefix sums of a polynomial (modulo 2**64) over values: any run's hash in constant time."""

    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        if len(_Sums._powers) < n + 1:
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                full = np.full(n + 1, base, np.uint64)
                full[0] = 1
                setattr(_Sums, name, np.cumprod(full, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _Sums._powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * _Sums._inverse[lo]


_CUT = re.compile(rb"[\t\n\x0b\x0c\r ]")


class Lines:
    """The lines that say anything of pieces of text: doc, n, first (word), m (words), id1, id2; and all words' hashes."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]) -> None:
        """pieces: document, number of its first line, text that ends with its last line."""
        with np.errstate(over="ignore"):
            self.data = b"\n".join([*(p[2] for p in pieces), b""])
            b = np.frombuffer(self.data, np.uint8)
            self._find_words(b)
            stop = np.flatnonzero(b == 10)
            begin = np.append(0, stop[:-1] + 1) if len(stop) else stop
            first, last = np.searchsorted(self.start, begin), np.searchsorted(self.start, stop)
            sizes = np.array([len(p[2]) + 1 for p in pieces])
            piece = np.searchsorted(np.cumsum(sizes), stop, "right")
            said = np.append(0, np.cumsum(self.says))
            kept = said[last] > said[first]
            starts = np.searchsorted(begin, np.cumsum(sizes) - sizes)
            n = np.arange(len(stop)) - starts[piece] + np.array([p[1] for p in pieces])[piece]
            self.doc, self.n = np.array([p[0] for p in pieces])[piece][kept], n[kept].astype(np.int32)
            self.first, self.m = first[kept], (last - first)[kept]
            self.sums = _Sums(self.words)
            self.id1 = _mix(self.sums.of(self.first, self.first + self.m) + self.m.astype(np.uint64) * _U(_BASE))
            self.id2 = _mix(_Sums(_mix(self.words + _U(1))).of(self.first, self.first + self.m) ^ self.m.astype(np.uint64))

    def _find_words(self, b: np.ndarray) -> None:
        """start, end, hash and whether it holds a letter or digit of every word, some bytes at a time, cut at blanks."""
        starts, ends, words, says, at = [], [], [], [], 0
        while at < len(b):
            found = _CUT.search(self.data, at + PIECE) if at + PIECE < len(b) else None
            to = found.start() + 1 if found else len(b)
            part = b[at:to]
            edge = np.flatnonzero(np.diff(np.append(True, _BLANK[part])))
            s, e = edge[::2], edge[1::2]
            saying = np.append(0, np.cumsum(_SAYS[part], dtype=np.int32))
            starts.append(s + at)
            ends.append(e + at)
            words.append(_mix(_Sums(_BYTES[part]).of(s, e)))
            says.append(saying[e] > saying[s])
            at = to
        none = np.zeros(0, np.int64)
        self.start, self.end = (np.concatenate(x) if x else none for x in (starts, ends))
        self.words, self.says = np.concatenate(words) if words else none.astype(np.uint64), np.concatenate(says) if says else none.astype(bool)

    def text(self, i: int) -> str:
        """The line's words, single blanks between them."""
        a, e = self.first[i], self.first[i] + self.m[i]
        return " ".join(self.data[s:t].decode("utf-8", "surrogatepass") for s, t in zip(self.start[a:e], self.end[a:e]))


def _texts(b: pa.RecordBatch, step: int = 256) -> Iterator[tuple[int, str | None]]:
    for at in range(0, b.num_rows, step):
        yield from enumerate(b.column("text").slice(at, step).to_pylist(), at)


def _parsed(b: pa.RecordBatch) -> Iterator[Lines]:
    pieces, held = [], 0
    for i, text in _texts(b):
        data, n = (text or "").encode("utf-8", "surrogatepass"), 0
        while True:
            cut = data.find(b"\n", PIECE) if len(data) > PIECE else -1
            part, data = (data[:cut], data[cut + 1 :]) if cut >= 0 else (data, None)
            pieces.append((i, n, part))
            held += len(part) + 1
            if held >= PIECE:
                yield Lines(pieces)
                pieces, held = [], 0
            if data is None:
                break
            n += part.count(b"\n") + 1
    if pieces:
        yield Lines(pieces)


def _probes(edits: int) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """(longer, runs): how much longer a line is than the one whose segments are sought, and its untouched runs of segments
    (from, to, shift). Of edits + 1 segments `edits` are touched, and shifts can't change by more than that in all."""
    out = set()
    for touched in combinations(range(edits + 1), edits):
        ends = [-1, *touched, edits + 1]
        for longer in range(edits + 1):
            for mid in product(range(-edits, edits + 1), repeat=edits - 1):
                shifts = [0, *mid, longer]
                if sum(abs(y - x) for x, y in zip(shifts, shifts[1:])) <= edits:
                    out.add((longer, tuple((a + 1, e, s) for a, e, s in zip(ends, ends[1:], shifts) if e > a + 1)))
    return sorted(out)


def _levels(edits: int) -> list[tuple[int, int]]:
    """(edits, most words of the shorter line; 0: any) of the classes of pairs, by the shorter line's words."""
    return [(d, (d + 1) * WORDS_PER_EDIT - 1 if d < edits else 0) for d in range(1, edits + 1)]


def _segment_keys(x: Lines, edits: int) -> Iterator[tuple[int, int, int, tuple, np.ndarray, np.ndarray]]:
    """(edits, how much longer, side, runs, lines, keys): a key for equal untouched segments, from either side of a pair.

    The shorter (or one of equally long) has its own segments as they are; the other side has them where shifts put them.
    """
    for d, most in _levels(edits):
        emitted = set()
        for longer, runs in _probes(d):
            plain = tuple((lo, hi, 0) for lo, hi, _ in runs)
            for side in (SHORTER, LONGER) if longer else (SAME,):
                own = x.m - longer if side == LONGER else x.m  # words of the line whose segments these are
                place = plain if side == SHORTER else runs
                at = np.flatnonzero((own >= d * WORDS_PER_EDIT) & (own <= (most or np.inf)))
                if (longer, side, place) in emitted or not len(at):
                    continue
                emitted.add((longer, side, place))
                m, f = own[at], x.first[at]
                key = m.astype(np.uint64) * _U(_BASE) + _U((d * 64 + longer) * 4096)
                for lo, hi, s in place:
                    key = _mix(key ^ _U(lo * 64 + hi)) + x.sums.of(f + m * lo // (d + 1) + s, f + m * hi // (d + 1) + s)
                yield d, longer, side, place, at, _mix(key)


#: Rows of lines (place and id), and rows of segment keys for a bucket (keys and ids, eight bytes each): one reading makes both.
PARSED = "n int, id1 long, id2 long, bucket int, ks binary, ids binary"


def _packed(k: np.ndarray, i: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Keys and ids by bucket; of a key two lines at most, so that a hot one is small from every task."""
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    new = np.append(True, k[1:] != k[:-1])
    last = np.append(new[1:], True)
    kept = new | (last & (i != i[np.flatnonzero(new)[np.cumsum(new) - 1]]))
    k, i = k[kept], i[kept]
    of = (k % _U(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    k, i, of = k[order], i[order], of[order]
    edge = np.append(0, np.flatnonzero(np.diff(of)) + 1)
    ends = np.append(edge[1:], len(of))
    return of[edge], *([x[a:e].tobytes() for a, e in zip(edge, ends)] for x in (k, i))


def _parser(edits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, ids, held, kind = [], [], 0, None

        def keys() -> pa.RecordBatch:
            of, k, i = _packed(np.concatenate(ks), np.concatenate(ids), buckets)
            absent = [pa.nulls(len(of), t) for t in (kind, pa.string(), pa.int32(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*absent, pa.array(of), pa.array(k, pa.binary()), pa.array(i, pa.binary())], names)

        names = ["doc_id", "key", "n", "id1", "id2", "bucket", "ks", "ids"]
        with np.errstate(over="ignore"):
            for b in batches:
                kind = b.column("doc_id").type
                for x in _parsed(b):
                    doc, n = pa.array(x.doc, pa.int64()), len(x.doc)
                    absent = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(doc), b.column("key").take(doc), pa.array(x.n), pa.array(x.id1.view(np.int64)), pa.array(x.id2.view(np.int64)), *absent], names)
                    for *_, at, key in _segment_keys(x, edits):
                        ks.append(key)
                        ids.append(x.id1[at])
                        held += len(at)
                    if held > 500_000:
                        yield keys()
                        ks, ids, held = [], [], 0
            if held:
                yield keys()

    return run


def _sharing(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        return _shared(t, buckets)

    return run


def _shared(t: pa.Table, buckets: int) -> pa.Table:
    """Of the keys of a bucket those of different lines."""
    k, i = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64) for c in ("ks", "ids"))
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    both = (k[1:] == k[:-1]) & (i[1:] != i[:-1])
    k = np.unique(k[1:][both])
    return pa.table({"bucket": pa.array((k % _U(buckets)).astype(np.int32)), "k": pa.array(k.view(np.int64))})


def _spots(k: np.ndarray, mask: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Three places of a key in its bucket's filter."""
    for shift in (0, 21, 42):
        yield _mix(k + _U(_BASE) * _U(shift + 1)) & mask


def _filter(t: pa.Table) -> pa.Table:
    """The Bloom filter of a bucket's keys: 16 to 32 bits for each, so that at most one other key in 200 passes."""
    k = t.column("k").to_numpy().view(np.uint64)
    size = 1 << max(6, (16 * len(k) - 1).bit_length())
    bits = np.zeros(size, bool)
    with np.errstate(over="ignore"):
        for at in _spots(k, _U(size - 1)):
            bits[at] = True
    return pa.table({"bucket": t.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


class Filters:
    """The filters of all buckets end to end; a key of none of them may pass, one of theirs always does."""

    def __init__(self, found: list[tuple[int, bytes]], buckets: int) -> None:
        self.buckets, self.bits = buckets, np.frombuffer(b"".join(x for _, x in found), np.uint8)
        self.first, self.mask = np.zeros(buckets, np.uint64), np.zeros(buckets, np.uint64)
        self.held, at = np.zeros(buckets, bool), 0
        for bucket, x in found:
            self.first[bucket], self.mask[bucket], self.held[bucket] = at, 8 * len(x) - 1, True
            at += 8 * len(x)

    def passes(self, k: np.ndarray) -> np.ndarray:
        """Indices of the keys that pass."""
        bucket = (k % _U(self.buckets)).astype(np.int64)
        left = np.flatnonzero(self.held[bucket])
        for n in range(3):
            of = bucket[left]
            at = self.first[of] + list(_spots(k[left], self.mask[of]))[n]
            left = left[self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & np.uint8(1) == 1]
        return left


#: Lines with shared segments: n, ids, the words, and for each shared segment its key, side, how much longer, and runs.
ALIVE = "n int, id1 long, id2 long, line string, meets array<struct<k:long,d:int,longer:int,side:int,runs:array<int>>>"
_MEETS = pa.list_(pa.struct([("k", pa.int64()), ("d", pa.int32()), ("longer", pa.int32()), ("side", pa.int32()), ("runs", pa.list_(pa.int32()))]))


def _reviver(edits: int, shared):
    """Lines with a shared segment (sorted keys), or with one that passes for it (Filters); all lines of enough words if the
    shared keys are too many to be brought here (None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        with np.errstate(over="ignore"):
            for b in batches:
                for x in _parsed(b):
                    meets: dict[int, list] = {}
                    for d, longer, side, runs, at, key in _segment_keys(x, edits):
                        k = key.view(np.int64)
                        hit = np.arange(len(k))
                        if isinstance(known, Filters):
                            hit = known.passes(key)
                        elif known is not None:
                            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k) if len(known) else hit[:0]
                        flat = [v for r in runs for v in r]
                        for line, one in zip(at[hit].tolist(), k[hit].tolist()):
                            meets.setdefault(line, []).append({"k": one, "d": d, "longer": longer, "side": side, "runs": flat})
                    if meets:
                        at = np.array(sorted(meets))
                        doc = pa.array(x.doc[at], pa.int64())
                        cols = [pa.array(x.n[at]), pa.array(x.id1[at].view(np.int64)), pa.array(x.id2[at].view(np.int64)), pa.array([x.text(i) for i in at]), pa.array([meets[i] for i in at.tolist()], _MEETS)]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(doc), b.column("key").take(doc), *cols], ["doc_id", "key", "n", "id1", "id2", "line", "meets"])

    return run


def _touched(m: int, d: int, longer: int, side: int, runs: list[int]) -> list[tuple[int, int]] | None:
    """The parts of a line of m words between its untouched runs; None if they'd overlap."""
    own, at, out = m - longer if side == LONGER else m, 0, []
    for lo, hi, s in zip(runs[::3], runs[1::3], runs[2::3]):
        out.append((at, own * lo // (d + 1) + s))
        at = own * hi // (d + 1) + s
    out.append((at, m))
    return None if any(a > e for a, e in out) else out


#: By edits and how much longer one line is: (side, words deleted, gaps that the key names).
_NAMED = {
    (1, 0): [(SAME, 1, 1)],
    (1, 1): [(SHORTER, 0, 0), (LONGER, 1, 0)],
    (2, 0): [(SAME, 1, 0), (SAME, 2, 2)],  # a word moved; two words changed
    (2, 1): [(SHORTER, 0, 0), (LONGER, 1, 0), (SHORTER, 1, 1), (LONGER, 2, 1)],  # a word added; one added and one changed
    (2, 2): [(SHORTER, 0, 0), (LONGER, 2, 0)],
}


def variants(words: np.ndarray, k: int, d: int, longer: int, side: int, runs: list[int]) -> Iterator[np.ndarray]:
    """Keys of the deletion variants of a line (hashes of its words) outside its untouched runs, for its side."""
    parts = _touched(len(words), d, longer, side, runs)
    if parts is None:
        return
    items = np.concatenate([x for a, e in parts for x in (words[a:e], _MARK)])  # parts end with a mark that stays
    free = np.ones(len(items), bool)
    free[np.cumsum([e - a + 1 for a, e in parts]) - 1] = False
    at = np.flatnonzero(free)
    s = _Sums(items).sums
    back = _Sums._inverse[:3] if len(items) > 1 else np.ones(3, np.uint64)
    for own, r, named in _NAMED[(d, longer)]:
        if own != side:
            continue
        # What is left without the deleted words, as if it stood together; a gap is the place in it at which one was deleted.
        if r == 0:
            left, gaps = s[-1:], []
        elif r == 1:
            left, gaps = s[at] + (s[-1] - s[at + 1]) * back[1], [at]
        else:
            i, j = (at[x] for x in np.triu_indices(len(at), 1))
            left, gaps = s[i] + (s[j] - s[i + 1]) * back[1] + (s[-1] - s[j + 1]) * back[2], [i, j - 1]
        kept = r - longer if side == LONGER else r
        left = _mix(left + _mix(np.array([k], np.int64).view(np.uint64) + _U((longer * 4 + named) * 4 + kept)))
        if named == r:
            yield _mix(left + sum(((g + 1).astype(np.uint64) * _U(_BASE + 2 * n) for n, g in enumerate(gaps)), _U(0)))
        else:
            for g in gaps if named else [None]:
                yield _mix(left + (_U(0) if g is None else (g + 1).astype(np.uint64) * _U(_BASE)))


_MARK = np.array([0x5851F42D4C957F2D], np.uint64)


def _varier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(keys: list, sides: list, ids: list) -> pa.RecordBatch:
        n = [len(x) for x in keys]
        cols = [np.concatenate(keys).view(np.int64), np.repeat(np.array(sides, np.int32), n), np.repeat(np.array(ids, np.int64), n)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["v", "side", "id1"])

    with np.errstate(over="ignore"):
        _Sums(np.zeros(1 << 12, np.uint64))  # powers are made once
        for b in batches:
            keys, sides, ids, held = [], [], [], 0
            for line, id1, meets in zip(*(b.column(c).to_pylist() for c in ("line", "id1", "meets"))):
                words = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in line.split(" ")], np.uint64)
                for m in meets:
                    for v in variants(words, **m):
                        keys.append(v)
                        sides.append(m["side"])
                        ids.append(id1)
                        held += len(v)
                if held > 200_000:
                    yield out(keys, sides, ids)
                    keys, sides, ids, held = [], [], [], 0
            if keys:
                yield out(keys, sides, ids)


def word_distance(a: list[str], b: list[str], bound: int) -> int:
    """Levenshtein distance of two word sequences, bound + 1 if it is larger than the bound."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            was, row[j] = row[j], min(was + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > bound:
            return bound + 1
    return min(row[-1], bound + 1)


def near(a: str, b: str, edits: int = EDITS) -> bool:
    """Are two lines (words with single blanks between them) within the bound for their words?"""
    x, y = a.split(" "), b.split(" ")
    allowed = min(edits, min(len(x), len(y)) // WORDS_PER_EDIT)
    return allowed > 0 and word_distance(x, y, allowed) <= allowed


def _verifier(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [near(x, y, edits) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist())]
            yield b.select(["id1", "id2"]).filter(pa.array(good, pa.bool_()))

    return run


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def _near(documents: DataFrame, keys: DataFrame, edits: int, buckets: int) -> DataFrame:
    """id1, id2 of distinct lines near an earlier one; keys: bucket, ks, ids of the lines' segments.

    Lines that pass a filter without a shared segment emit variants that meet none: they cost a little and change nothing.
    """
    spark, head = documents.sparkSession, documents.schema["doc_id"]
    rest = lambda ddl: T.StructType([head, T.StructField("key", T.StringType()), *T.StructType.fromDDL(ddl)])
    shared = materialize(keys.groupBy("bucket").applyInArrow(_sharing(buckets), "bucket int, k long"), "segments")
    n_shared = shared.count()
    if n_shared <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(np.sort(shared.select("k").toArrow().column("k").to_numpy()))
        alive = documents.mapInArrow(_reviver(edits, known), rest(ALIVE))
    elif n_shared <= FILTER_ROWS:
        found = shared.groupBy("bucket").applyInArrow(_filter, "bucket int, bits binary").toArrow()
        known = spark.sparkContext.broadcast(Filters(list(zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist())), buckets))
        alive = documents.mapInArrow(_reviver(edits, known), rest(ALIVE))
    else:
        every = documents.mapInArrow(_reviver(edits, None), rest(ALIVE)).select("doc_id", "key", "n", "id1", "id2", "line", F.explode("meets").alias("m"))
        every = every.join(shared.select("k"), every["m.k"] == shared["k"], "left_semi")
        alive = every.groupBy("doc_id", "key", "n", "id1", "id2").agg(F.first("line").alias("line"), F.collect_list("m").alias("meets"))
    alive = alive.select(F.struct("doc_id", "key", "n").alias("at"), "id1", "id2", F.struct("line", "meets").alias("x"))
    alive = materialize(alive.groupBy("id1", "id2").agg(F.min("at").alias("at"), F.first("x").alias("x")).select("at", "id1", "id2", "x.line", "x.meets"), "alive")
    every = materialize(alive.select("line", "id1", "meets").mapInArrow(_varier, "v long, side int, id1 long"), "variants")

    # Variants that meet are few; only theirs get their lines' places again.
    met = materialize(every.groupBy("v").agg(F.min("id1").alias("x"), F.max("id1").alias("y")).where("x <> y").select("v"), "met")
    rows = every.join(_sized(met), "v", "left_semi").join(alive.select("at", "id1", "id2", "line"), "id1")
    rows = materialize(rows.select("v", "side", F.struct("at", "id1", "id2", "line").alias("me")), "meeting")
    discard(every, met, shared)
    least = rows.groupBy("v").agg(*[F.min(F.when(F.col("side") == s, F.col("me"))).alias(f"m{s}") for s in (SAME, SHORTER, LONGER)])
    partner = F.when(F.col("side") == SAME, F.col("m0")).when(F.col("side") == SHORTER, F.col("m2")).otherwise(F.col("m1"))
    pairs = rows.join(least, "v").select("me.*", partner.alias("q")).where(F.col("q.at") < F.col("at"))
    pairs = pairs.groupBy("id1", "id2", F.col("q.id1").alias("o1"), F.col("q.id2").alias("o2")).agg(F.first("line").alias("line"), F.first("q.line").alias("other"))
    out = materialize(pairs.select("id1", "id2", "line", "other").mapInArrow(_verifier(edits), "id1 long, id2 long").distinct(), "near")
    discard(alive, rows)
    return out


def dropped_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, key (digest of the text) and drops (line numbers from 0, distinct) of each document that loses lines.

    Order of lines: doc_id (null first), text digest, line number. A line goes if an earlier line equals it or is near
    it, whether or not that one goes too. Rows that repeat doc_id and text are one document.
    """
    if edits not in (0, 1, 2):
        raise ValueError("edits must be 0, 1 or 2")
    d = documents.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    # As many buckets as the cluster's shuffles have partitions, some times over: they grow with the input as those do.
    buckets = 4 * max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = materialize(d.mapInArrow(_parser(edits, buckets), T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("key", T.StringType()), *T.StructType.fromDDL(PARSED)])), "lines")
    lines = parsed.where("bucket is null").select(F.struct("doc_id", "key", "n").alias("at"), "id1", "id2")
    firsts = lines.groupBy("id1", "id2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    fate = firsts.where("c > 1").select("id1", "id2", "first", F.lit(False).alias("near"))
    if edits:
        close = _near(d, parsed.where("bucket is not null").select("bucket", "ks", "ids"), edits, buckets)
        fate = fate.unionByName(close.select("id1", "id2", F.lit(None).cast(fate.schema["first"].dataType).alias("first"), F.lit(True).alias("near")))
        fate = fate.groupBy("id1", "id2").agg(F.max("first").alias("first"), F.max("near").alias("near"))
    fate = materialize(fate, "fates")
    gone = lines.join(_sized(fate), ["id1", "id2"]).where("near or at <> first")
    out = materialize(gone.groupBy("at.doc_id", "at.key").agg(F.collect_set("at.n").alias("drops")), "dropped")
    discard(parsed, fate)
    return out


def dedup_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents with their text cut to the lines that stay, and n_lines and n_dropped (longs) after their own columns.

    A null text stays null, without lines; a text whose lines all go becomes empty. Lines without a letter (any byte
    outside ASCII counts as one) or digit stay. Columns named n_lines or n_dropped are replaced; other names can't clash.
    """
    gone = dropped_lines(documents, edits).select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "drops")
    d = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("own"), text_key(F.col("text")).alias("digest"))
    d = d.join(gone, d["own"].eqNullSafe(gone["i"]) & (d["digest"] == gone["k"]), "left")
    text, ls = F.col("row.text"), F.split("row.text", "\n")
    kept = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(F.filter(ls, lambda _, i: ~F.array_contains("drops", i)), "\n"))
    return d.select(
        *[kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped")],
        F.when(text.isNull(), 0).otherwise(F.size(ls)).cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
    )
