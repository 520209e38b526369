"""Exact substring dedup over byte strings of WIDTH, by a suffix sort that compares with polynomial hashes.

Every window of WIDTH bytes has an anchor, its least k-gram by hash, so equal windows have equal anchors. Neighbouring
windows of one anchor form a block. Blocks with equal prefix-polynomial hashes are claimed to be copies; the claim holds
only if digests (128 bits) of their bytes agree, within a chunk if the bytes do, and the least document keeps them. Where
one anchor stands in different blocks (the edges of what documents share), the blocks' bytes are brought together and
the suffixes at equal distance from the anchor are mergesorted: a comparison finds the common extension by binary search
over prefix hashes, and neighbours that come out equal are verified byte by byte.

An anchor with many blocks is hot: its windows are then compared by window, keyed by their own bytes, so they spread
evenly. A chunk knows its own hot anchors and asks about each with one row, so no group holds all blocks of a hot anchor.

Documents lie in chunk files in the shared folder. A chunk asks for its distinct blocks and windows, the answers come back
by chunk, and texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, workdir
from .storage import Writer, open_input

WIDTH, GRAM = 50, 25
#: Text bytes of a chunk, of a piece of a document that is hashed at once, and of a bucket of questions.
CHUNK, PIECE, BUCKET = 8 << 20, 1 << 20, 8 << 20
#: Blocks of one anchor from which on their windows are compared by window, not by anchor, so that no group is large.
HOT = 2_000
#: The same for the blocks of one chunk, which decides without asking.
LOCAL_HOT = 128
#: A block's code: kept, claimed by a smaller document, its anchor has other blocks, or very many; and a flag for blocks
#: that several chunks have.
KEPT, CLAIMED, MIXED, MANY, SHARED = 0, 1, 2, 3, 4
NULL_ID = -(1 << 63)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = _U(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


class Prefixes:
    """Prefix polynomial hashes (modulo 2**64) of a byte array: any substring's hash in constant time."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(Prefixes._powers) < n + 1:
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                full = np.full(n + 1, base, np.uint64)
                full[0] = 1
                setattr(Prefixes, name, np.cumprod(full, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * Prefixes._powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * Prefixes._inverse[start]

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * Prefixes._inverse[:n]


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    step, m = 1, v
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (width - step)], m[width - step :]) if width > step else m


def blocks(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Blocks of a chunk's texts, in order: doc (index), start, count (of windows), rel (anchor less start), a, b (hashes of anchor and block)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "start", "count", "rel", "a", "b")}
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        begins = np.cumsum(sizes) - sizes
        of_piece = np.repeat(np.arange(len(pieces)), sizes)
        prefixes = Prefixes(data)
        h = _mix(prefixes.all(GRAM))
        anchor = (_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), WIDTH - GRAM + 1) & _LOW).astype(np.int64)
        valid = of_piece[: len(anchor)] == of_piece[WIDTH - 1 :]
        change = np.ones(len(anchor) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (of_piece[1 : len(anchor)] != of_piece[: len(anchor) - 1])
        edges = np.flatnonzero(change)
        at, count = edges[:-1], np.diff(edges)
        good = valid[at]
        at, count = at[good], count[good]
        rel = anchor[at] - at
        piece = of_piece[at]
        out["doc"].append(np.array([p[0] for p in pieces])[piece])
        out["start"].append(at - begins[piece] + np.array([p[1] for p in pieces])[piece])
        out["count"].append(count)
        out["rel"].append(rel)
        out["a"].append(h[anchor[at]])
        shape = (count.astype(np.uint64) << _U(32)) | rel.astype(np.uint64)
        out["b"].append(_mix(prefixes.of(at, count + WIDTH - 1) ^ _mix(shape + _U(1))))
        pieces.clear()

    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            for s in range(0, len(t) - WIDTH + 1, PIECE):
                part = t[s : s + PIECE + WIDTH - 1]
                pieces.append((i, s, part))
                held += len(part)
                if held >= PIECE:
                    flush()
                    held = 0
        if pieces:
            flush()
    none = np.zeros(0, np.int64)
    return {k: np.concatenate(v) if v else none.astype(np.uint64 if k in "ab" else np.int64) for k, v in out.items()}


class Chunk:
    """A chunk file's documents (ordered by id) and their blocks; `first`: an occurrence of each distinct block, in the least document."""

    def __init__(self, uri: str) -> None:
        with open_input(uri) as f:
            t = pa.ipc.open_file(f).read_all()
        self.ids = t.column("doc_id").combine_chunks()
        self.order = np.array([NULL_ID if x is None else x for x in self.ids.to_pylist()], np.int64)
        self.texts = t.column("text").to_pylist()
        self.blocks = blocks(self.texts)
        _, self.first, self.distinct = np.unique(self.blocks["b"], return_index=True, return_inverse=True)
        self.least = self.order[self.blocks["doc"][self.first]]
        _, lead, anchor, times = np.unique(self.blocks["a"][self.first], return_index=True, return_inverse=True, return_counts=True)
        self.hot = times[anchor] > LOCAL_HOT
        #: Which distinct blocks are asked about: of a hot anchor's one.
        self.asked = ~self.hot
        self.asked[lead] = True

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Bucket and the numbers of the distinct blocks that are asked about."""
        of = ((self.blocks["a"][self.first] & _LOW) % _U(n)).astype(np.int64)
        asked = np.flatnonzero(self.asked)
        for k, part in _by(of[asked]):
            yield k, asked[part]

    def body(self, i: int) -> bytes:
        """The bytes of an occurrence of a block."""
        start = self.blocks["start"][i]
        return self.texts[self.blocks["doc"][i]][start : start + self.blocks["count"][i] + WIDTH - 1]

    def claims(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct blocks that other chunks have too, and digests of their bytes (two words each)."""
        at = np.flatnonzero(codes & SHARED)
        raw = b"".join(hashlib.blake2b(self.body(i), digest_size=16).digest() for i in self.first[at])
        return at, np.frombuffer(raw, np.uint64).reshape(-1, 2)

    def genuine(self, wanted: np.ndarray) -> np.ndarray:
        """Of the wanted occurrences those whose bytes are those of their distinct block, which the first one stands for."""
        out = wanted.copy()
        for i in np.flatnonzero(wanted & (self.first[self.distinct] != np.arange(len(wanted)))):
            out[i] = self.body(i) == self.body(self.first[self.distinct[i]])
        return out

    def fragments(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        """Of the distinct blocks coded MIXED, a fragment each; of those coded MANY, one for each window, keyed by its bytes."""
        amb, hot = np.flatnonzero(codes & 3 == MIXED), np.flatnonzero(codes & 3 == MANY)
        count = self.blocks["count"][self.first]
        n_hot = count[hot]
        block = np.concatenate([amb, np.repeat(hot, n_hot)])
        skip = np.concatenate([np.zeros(len(amb), np.int64), np.arange(n_hot.sum()) - np.repeat(np.cumsum(n_hot) - n_hot, n_hot)])
        size = np.concatenate([count[amb], np.ones(len(block) - len(amb), np.int64)])
        at = self.first[block]
        key = self.blocks["a"][at].copy()
        body = [self.texts[d][s : s + n + WIDTH - 1] for d, s, n in zip(self.blocks["doc"][at], self.blocks["start"][at] + skip, size)]
        for i in range(len(amb), len(block)):
            key[i] = int.from_bytes(hashlib.blake2b(body[i], digest_size=8).digest(), "little")
        return {"block": block, "skip": skip, "size": size, "rel": self.blocks["rel"][at] - skip, "key": key, "body": np.array(body, object), "least": self.least[block]}


def _by(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, edges) if len(of) else []:
        yield int(of[part[0]]), part


def _chunker(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, rows, held, done = uuid.uuid4().hex, [], 0, []

        def flush() -> None:
            rows.sort(key=lambda r: NULL_ID if r[0] is None else r[0])
            t = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            name = f"{attempt}-{len(done):05d}.chunk"
            out = Writer(f"{folder}/{name}")
            out.write(sink.getvalue())
            out.close()
            done.append((name, sum(len(r[1]) for r in rows)))
            rows.clear()

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                rows.append((doc_id, data))
                held += len(data) + 100
                if held >= CHUNK:
                    flush()
                    held = 0
        if rows:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["chunk", "bytes"])

    return run


def _asker(folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("chunk").to_pylist():
                c = Chunk(f"{folder}/{name}")
                a, b = c.blocks["a"][c.first] >> _U(32), c.blocks["b"][c.first]
                rows = [(k, name, a[p].astype(np.uint32).tobytes(), b[p].tobytes(), c.least[p].tobytes(), c.hot[p].tobytes()) for k, p in c.buckets(buckets)]
                if not rows:  # no window at all: the chunk still has to come back
                    rows = [(0, name, b"", b"", b"", b"")]
                for i in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 1000]), (pa.int32(), pa.string(), *[pa.binary()] * 4))], ["bucket", "chunk", "a", "b", "d", "hot"])

    return run


def _answer_blocks(t: pa.Table) -> pa.Table:
    """A code for each block asked about."""
    cols = {c: t.column(c).to_pylist() for c in ("a", "b", "d", "hot")}
    sizes = [len(x) // 4 for x in cols["a"]]
    a, b, d, hot = (np.frombuffer(b"".join(cols[c]), k) for c, k in (("a", np.uint32), ("b", np.uint64), ("d", np.int64), ("hot", bool)))
    codes = np.zeros(len(a), np.uint8)
    if len(a):
        order = np.lexsort((d, b))
        start = np.append(True, b[order][1:] != b[order][:-1])
        group = np.cumsum(start) - 1
        least, ua = d[order][start], a[order][start]
        claimed = np.zeros(len(a), bool)
        claimed[order] = least[group] < d[order]
        shared = np.bincount(group) > 1
        by_a = np.lexsort((least, ua))
        edge = np.append(True, ua[by_a][1:] != ua[by_a][:-1])
        g = np.cumsum(edge) - 1
        lo, hi = least[by_a][edge], least[by_a][np.append(edge[1:], True)]
        is_hot = np.zeros(len(ua), bool)
        is_hot[group[hot[order]]] = True
        many = (np.bincount(g) > HOT) | (np.bincount(g, is_hot[by_a]) > 0)
        code_of = np.zeros(len(ua), np.uint8)
        code_of[by_a] = np.where(many[g], MANY, np.where((lo == hi)[g], KEPT, MIXED))
        own = np.zeros(len(a), np.int64)
        own[order] = group
        codes = np.where(code_of[own] == MANY, MANY, np.where(claimed, CLAIMED, code_of[own]) + SHARED * shared[own]).astype(np.uint8)
    ends = np.cumsum(sizes)
    parts = [codes[e - n : e].tobytes() for e, n in zip(ends, sizes)]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "codes": pa.array(parts, pa.binary())})


def _codes(c: Chunk, t: pa.Table, buckets: int) -> np.ndarray:
    answers = dict(zip(t.column("bucket").to_pylist(), t.column("codes").to_pylist()))
    codes = np.where(c.hot, MANY, KEPT).astype(np.uint8)
    for k, part in c.buckets(buckets):
        codes[part] = np.frombuffer(answers[k], np.uint8)
    return codes


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(keys) & _LOW) % _U(buckets)).astype(np.int64)


def _fragmenter(folder: str, buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        name = key[0].as_py()
        c = Chunk(f"{folder}/{name}")
        codes = _codes(c, t, buckets)
        f, (claimed, digests) = c.fragments(codes), c.claims(codes)
        parts, claims = dict(_by(_spread(f["key"], buckets))), dict(_by(_spread(c.blocks["b"][c.first[claimed]], buckets)))
        rows, none = [], np.zeros(0, np.int64)
        for k in sorted({*parts, *claims}):
            p, q = parts.get(k, none), claims.get(k, none)
            sizes = np.stack([f["size"][p], f["rel"][p]]).astype(np.int32)
            rows.append((k, name, f["key"][p].tobytes(), f["least"][p].tobytes(), sizes.tobytes(), b"".join(f["body"][p]), digests[q].tobytes(), c.least[claimed[q]].tobytes()))
        cols = list(zip(*rows)) or [[]] * 8
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("bucket", "chunk", "key", "d", "sizes", "body", "digests", "owners"), cols, (pa.int32(), pa.string(), *[pa.binary()] * 6))})

    return run


def common_extension(p: Prefixes, i: np.ndarray, j: np.ndarray, limit: int = WIDTH) -> np.ndarray:
    """Length up to limit to which the suffixes at i and j agree, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), np.full(len(i), limit)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi + 1) // 2, lo)
        same = p.of(i, mid) == p.of(j, mid)
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def _less(data: np.ndarray, p: Prefixes, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    n = common_extension(p, i, j)
    at = np.minimum(n, WIDTH - 1)
    return np.where(n == WIDTH, or_equal, data[i + at] < data[j + at])


def suffix_sort(data: np.ndarray, p: Prefixes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes at `at`, whose groups lie together, within their groups: a bottom-up mergesort, all merges of a level at once."""
    n = len(at)
    edges = np.append(True, group[1:] != group[:-1])
    begin = np.flatnonzero(edges)[np.cumsum(edges) - 1]
    size = np.diff(np.append(np.flatnonzero(edges), n))[np.cumsum(edges) - 1]
    order, place = np.arange(n), np.arange(n) - begin
    width = 1
    while width < size.max(initial=0):
        run = place // width
        mate = run ^ 1
        lo = begin + np.minimum(mate * width, size)
        hi = begin + np.minimum((mate + 1) * width, size)
        first, right = lo.copy(), (run & 1).astype(bool)
        while len(k := np.flatnonzero(lo < hi)):  # how many of the mate's run come before: left runs first among equals
            mid = (lo[k] + hi[k]) // 2
            before = _less(data, p, at[order[mid]], at[order[k]], right[k])
            lo[k], hi[k] = np.where(before, mid + 1, lo[k]), np.where(before, hi[k], mid)
        target = begin + (run // 2) * 2 * width + (place - run * width) + (lo - first)
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, 2 * width
    return order


def _answer_windows(t: pa.Table) -> pa.Table:
    """For each fragment, which of its windows (bits) a smaller document has at the same distance from the same anchor; for
    each claimed block, whether a smaller document has one of the same digest."""
    cols = {c: t.column(c).to_pylist() for c in ("key", "d", "sizes", "body", "digests", "owners")}
    counts = [len(x) // 8 for x in cols["key"]]
    key = np.frombuffer(b"".join(cols["key"]), np.uint64)
    d = np.frombuffer(b"".join(cols["d"]), np.int64)
    shape = np.concatenate([np.frombuffer(x, np.int32).reshape(2, -1) for x in cols["sizes"]], axis=1).astype(np.int64)
    size, rel = shape
    data = np.frombuffer(b"".join(cols["body"]), np.uint8)
    begin = np.cumsum(size + WIDTH - 1) - (size + WIDTH - 1)
    masks = np.zeros(len(key), np.uint32)
    with np.errstate(over="ignore"):
        prefixes = Prefixes(data)
        # Whole anchors at a time, as many as make a bounded number of suffixes.
        by_key = np.argsort(key, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, key[by_key][1:] != key[by_key][:-1])), len(key))
        total = np.append(0, np.cumsum(size[by_key]))
        k = 0
        while k < len(edges) - 1:
            e = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + 200_000, "right")) - 1)
            _settle(by_key[edges[k] : edges[e]], key, d, size, rel, begin, data, prefixes, masks)
            k = e
    ends = np.cumsum(counts)
    parts = [masks[e - n : e].tobytes() for e, n in zip(ends, counts)]
    digests, owner = np.frombuffer(b"".join(cols["digests"]), np.uint64).reshape(-1, 2), np.frombuffer(b"".join(cols["owners"]), np.int64)
    proven = np.zeros(len(owner), bool)
    if len(owner):
        order = np.lexsort((owner, digests[:, 1], digests[:, 0]))
        start = np.append(True, (digests[order][1:] != digests[order][:-1]).any(1))
        proven[order] = owner[order][start][np.cumsum(start) - 1] < owner[order]
    ends, counts = np.cumsum([len(x) // 8 for x in cols["owners"]]), [len(x) // 8 for x in cols["owners"]]
    proofs = [proven[e - n : e].tobytes() for e, n in zip(ends, counts)]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "masks": pa.array(parts, pa.binary()), "proofs": pa.array(proofs, pa.binary())})


def _settle(frag, key, d, size, rel, begin, data, prefixes, masks) -> None:
    if not len(frag):  # a bucket of claims alone
        return
    n = size[frag]
    f = np.repeat(frag, n)
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    distance = rel[f] - t
    order = np.lexsort((d[f], distance, key[f]))
    f, t, distance = f[order], t[order], distance[order]
    group = np.cumsum(np.append(True, (key[f][1:] != key[f][:-1]) | (distance[1:] != distance[:-1])))
    alone = np.bincount(group)[group] == 1
    f, t, group = f[~alone], t[~alone], group[~alone]
    if not len(f):
        return
    at = begin[f] + t
    s = suffix_sort(data, prefixes, at, group)  # equal ones stay ordered by document
    f, t, at, group = f[s], t[s], at[s], group[s]
    same = (group[1:] == group[:-1]) & (common_extension(prefixes, at[1:], at[:-1]) == WIDTH)
    claimed = np.flatnonzero(same)
    for i in range(0, len(claimed), 100_000):  # collision verification, byte by byte
        c = claimed[i : i + 100_000]
        span = np.arange(WIDTH)
        same[c] = (data[at[c][:, None] + span] == data[at[c + 1][:, None] + span]).all(1)
    start = np.append(True, ~same)
    least = np.minimum.reduceat(d[f], np.flatnonzero(start))[np.cumsum(start) - 1]
    gone = least < d[f]
    np.bitwise_or.at(masks, f[gone], np.uint32(1) << t[gone].astype(np.uint32))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finisher(folder: str, buckets: int, with_text: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        name = (key[0] if isinstance(key, tuple) else key).as_py()
        c = Chunk(f"{folder}/{name}")
        codes = _codes(c, left, buckets)
        f = c.fragments(codes)
        answers = {k: (m, p) for k, m, p in zip(*(right.column(x).to_pylist() for x in ("bucket", "masks", "proofs")))}
        masks = np.zeros(len(f["block"]), np.uint32)
        for k, p in _by(_spread(f["key"], buckets)):
            masks[p] = np.frombuffer(answers[k][0], np.uint32)
        claimed = np.flatnonzero(codes & SHARED)
        proven = np.zeros(len(c.first), bool)
        for k, p in _by(_spread(c.blocks["b"][c.first[claimed]], buckets)):
            proven[claimed[p]] = np.frombuffer(answers[k][1], bool)
        windows = np.zeros(len(c.first), np.uint32)  # of the distinct blocks, WIDTH - GRAM + 1 windows at most
        np.bitwise_or.at(windows, f["block"], masks << f["skip"].astype(np.uint32))
        doc, start, count = (c.blocks[k] for k in ("doc", "start", "count"))
        whole = proven[c.distinct] | (c.order[doc] > c.least[c.distinct])
        genuine = c.genuine(whole | (windows[c.distinct] > 0))
        whole &= genuine
        part = np.flatnonzero(~whole & genuine & (windows[c.distinct] > 0))
        n = count[part]
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = (np.repeat(windows[c.distinct[part]], n) >> t.astype(np.uint32)) & np.uint32(1) > 0
        docs = np.concatenate([doc[whole], np.repeat(doc[part], n)[hit]])
        lo = np.concatenate([start[whole], (np.repeat(start[part], n) + t)[hit]])
        hi = lo + WIDTH - 1 + np.concatenate([count[whole], np.ones(hit.sum(), np.int64)])
        sizes = np.array([len(x) for x in c.texts], np.int64)
        offset = np.cumsum(sizes) - sizes
        delta = np.zeros(sizes.sum() + 1, np.int32)
        np.add.at(delta, offset[docs] + lo, 1)
        np.add.at(delta, offset[docs] + hi, -1)
        covered = np.cumsum(delta[:-1]) > 0
        rows = []
        for text, o, size in zip(c.texts, offset, sizes):
            gone = covered[o : o + size]
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((int(size), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        long, cols = pa.int64(), list(zip(*rows))
        out = {"doc_id": c.ids, **{k: pa.array(x, y) for k, x, y in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, (long, long, long, pa.string()))}}
        return pa.table(out | ({"kept": pa.array(cols[4], pa.binary())} if with_text else {}))

    return run


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes (kept) if with_text is set.

    A byte goes if a string of WIDTH bytes over it also starts in a document with a smaller doc_id. doc_ids are integers;
    null counts as smaller than all. Rows that share a doc_id take nothing from each other. A null text is empty; texts
    under WIDTH bytes stay whole.
    """
    spark = documents.sparkSession
    folder = workdir(spark, "chunks")
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_ids must be integers: 'smaller' is their order")
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = materialize(d.mapInArrow(_chunker(folder), "chunk string, bytes long"), "manifest")
    n, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(32, total // BUCKET)
    dealt = chunks.repartition(max(1, n)) if n else chunks
    asked = dealt.mapInArrow(_asker(folder, buckets), "bucket int, chunk string, a binary, b binary, d binary, hot binary")
    codes = materialize(asked.groupBy("bucket").applyInArrow(_answer_blocks, "chunk string, bucket int, codes binary"), "codes")
    parts = codes.groupBy("chunk").applyInArrow(_fragmenter(folder, buckets), "bucket int, chunk string, key binary, d binary, sizes binary, body binary, digests binary, owners binary")
    masks = materialize(parts.groupBy("bucket").applyInArrow(_answer_windows, "chunk string, bucket int, masks binary, proofs binary"), "masks")
    both = codes.groupBy("chunk").cogroup(masks.groupBy("chunk"))
    return both.applyInArrow(_finisher(folder, buckets, with_text), RESULT + (", kept binary" if with_text else ""))
