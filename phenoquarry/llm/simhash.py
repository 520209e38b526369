"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits come from word shingles. Their bits are grouped into partitions of correlated bits, and dynamic
programming allots each partition its own distance threshold so that the thresholds, each plus one, sum to the bound
plus one; then any two fingerprints within the bound agree within its threshold in at least one partition. Signatures
(the partition's bits with any `threshold` of them blanked) bring such fingerprints together, and every link is verified
on all 64 bits. Groups emit links that span them, not all pairs; a group beyond GROUP fingerprints is refined by more
bits, exactly, until it is small or has so few free bits that its size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_enough, text_key
from .components import connected_components

BITS = 64
BOUND = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that one group may hold before it is refined, and free bits at which it no longer has to be (2**16 at most).
GROUP, FREE = 4096, 16
#: Costs that the allotment weighs, in nanoseconds: a signature row moved, a pair compared.
ROW_NS, PAIR_NS = 1500, 3


def fingerprint(text: str | None) -> int:
    """SimHash of a text as a signed 64-bit integer; a text without words has fingerprint zero."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = list(accumulate(len(x) + 1 for x in w))
        starts = [0, *ends[: -SHINGLE]]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), np.uint64, len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The fingerprint (signed) of hashes (unsigned): a bit is set if over half of them have it."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(x) for x in b.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), fp], ["doc_id", "key", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text) and fp (signed) of every row; null text has no words."""
    d = documents.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return d.mapInArrow(_fingerprints, T.StructType([d.schema["doc_id"], T.StructField("key", T.StringType()), T.StructField("fp", T.LongType())]))


def _bits(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        x = _bits(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
        total += x.T @ x
        n += len(x)
    flat = np.append(total.ravel(), n)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], ["i", "x"])


def bit_statistics(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together (64 by 64), and the number of fingerprints, over all of them."""
    rows = nodes.select("fp").mapInArrow(_cooccurrence, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.i] = r.x
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width, each grown from a bit by the bits most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(rho, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own = [max(sorted(left), key=lambda i: rho[i, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            own.append(max(sorted(left), key=lambda i: rho[i, own].sum()))
            left.discard(own[-1])
        out.append(sorted(own))
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allot(parts: list[list[int]], equal_pairs: list[float], odds: np.ndarray, n: int, bound: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost, by dynamic programming over partitions and the units (threshold plus one) left."""
    units = bound + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, equal in zip(parts, equal_pairs):
        sums = np.zeros(units)
        sums[0] = 1  # elementary symmetric sums of the odds that a bit differs
        for b in bits:
            sums[1:] += sums[:-1] * odds[b]
        cost = [0.0]
        for t in range(units):
            rows = n * comb(len(bits), t)
            cost.append(rows * ROW_NS + equal * float(sums[: t + 1].sum()) * PAIR_NS)
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (c, ts) in best.items():
            for u in range(units - had + 1):
                new = (c + cost[u], [*ts, u - 1])
                if had + u not in step or new < step[had + u]:
                    step[had + u] = new
        best = step
    return best[units]


def plan_partitions(nodes: DataFrame, bound: int = BOUND) -> list[tuple[list[int], int]]:
    """Partitions (bit lists) with their thresholds, from statistics of all fingerprints; -1 leaves a partition out."""
    together, n = bit_statistics(nodes)
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    odds = differ / np.maximum(1 - differ, 1e-9)
    choices = [group_bits(together, n, m) for m in range(2, bound + 2)]
    flat = [bits for parts in choices for bits in parts]
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(b)))).alias("v")) for i, b in enumerate(flat)])
    same = nodes.select(F.explode(values).alias("x")).groupBy("x").count().groupBy("x.i").agg(F.sum(F.col("count").cast("double") ** 2).alias("s"))
    same = {r.i: r.s for r in same.collect()}
    best, at = None, 0
    for parts in choices:
        equal = [max(0.0, same.get(at + k, 0.0) - n) / 2 for k in range(len(parts))]
        at += len(parts)
        cost, ts = allot(parts, equal, odds, n, bound)
        if best is None or cost < best[0]:
            best = (cost, list(zip(parts, ts)))
    return best[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keyed(f: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """A key for equal fixed masks and equal bits under them."""
    return _mix(_mix(f & fixed) + fixed)


def _rows(sig: np.ndarray, fp: np.ndarray, fixed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (sig, fp, fixed)], ["sig", "fp", "fixed"])


SIGNATURE = "sig long, fp long, fixed long"


def _signer(plan: list[tuple[list[int], int]]):
    fixed = [np.uint64(_mask(bits) & ~_mask(c)) for bits, t in plan if t >= 0 for c in combinations(bits, t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for m in fixed:
                ms = np.full(len(f), m)
                yield _rows(_keyed(f, ms), f, ms)

    return run


def _refiner(bound: int):
    """Rows of large groups again, once for each of bound + 1 parts of their free bits, that part then fixed as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, had = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "fixed"))
            for m in np.unique(had):
                own = f[had == m]
                free = [k for k in range(BITS) if not int(m) >> k & 1]
                for k in range(bound + 1):
                    ms = np.full(len(own), m | np.uint64(_mask(free[k :: bound + 1])))
                    yield _rows(_keyed(own, ms), own, ms)

    return run


def spanning_links(f: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (within the bound) that connect what links within the bound connect; each fingerprint is met once."""
    a, b, left = [], [], f
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bound
            if near.any():
                met = left[near]
                a.append(np.full(len(met), x))
                b.append(met)
                queue.extend(met)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linker(bound: int):
    """Sorted signature rows to verified links; small groups are compared in step, larger ones by spanning_links()."""

    def groups(sig: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(sig)) + 1
        starts, ends = np.append(0, edge), np.append(edge, len(sig))
        size = np.repeat(ends - starts, ends - starts)
        a, b = [], []
        few = size <= 64
        s, g = sig[few], f[few]
        for lag in range(1, int(size[few].max(initial=1))):
            same = s[lag:] == s[:-lag]
            if not same.any():
                break
            x, y = g[:-lag][same], g[lag:][same]
            near = np.bitwise_count(x ^ y) <= bound
            a.append(x[near])
            b.append(y[near])
        for k in np.flatnonzero(ends - starts > 64):
            for out, part in zip((a, b), spanning_links(f[starts[k] : ends[k]], bound)):
                out.append(part)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            sig = np.concatenate([sig, b.column("sig").to_numpy(zero_copy_only=False)])
            f = np.concatenate([f, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
            if cut > 10_000:  # whole groups only; the last one may go on
                yield from groups(sig[:cut], f[:cut])
                sig, f = sig[cut:], f[cut:]
        if len(sig):
            yield from groups(sig, f)

    return run


def links(nodes: DataFrame, bound: int = BOUND) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints (column fp) that connect all that links connect."""
    plan = plan_partitions(nodes, bound)
    rows = materialize(nodes.select("fp").mapInArrow(_signer(plan), SIGNATURE), "signatures")
    out = None
    while True:
        large = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.first("fixed").alias("m"))
        large = materialize(large.where((F.col("n") > GROUP) & (BITS - F.bit_count("m") > FREE)).select("sig"), "large")
        n_large = large.count()
        mark = F.broadcast(large) if small_enough(large, 1_000_000) else large
        small = rows.join(mark, "sig", "left_anti") if n_large else rows
        ready = small.select("sig", "fp").repartition("sig").sortWithinPartitions("sig", "fp")
        found = ready.mapInArrow(_linker(bound), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not n_large:
            return out
        rows = materialize(rows.join(mark, "sig", "left_semi").select("fp", "fixed").mapInArrow(_refiner(bound), SIGNATURE).distinct(), "signatures")


def _resolved(documents: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all documents, and each distinct one's component: its least doc_id and the document that stays."""
    prints = materialize(fingerprints(documents), "prints")
    who = F.min(F.struct("doc_id", "key"))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), who.alias("stays")), "nodes")
    roots = connected_components(links(nodes, bound))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "stays", F.coalesce("root", "fp").alias("root"))
    nodes = materialize(nodes, "nodes")
    comps = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.min("stays").alias("stays"))
    return prints, materialize(nodes.select("fp", "root").join(comps, "root").select("fp", "component_id", "stays"), "components")


def near_duplicates(documents: DataFrame, bound: int = BOUND) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links; nulls don't count).

    Empty and null texts have fingerprint zero and are linked like any other. Rows that repeat are rows of one component.
    """
    prints, comps = _resolved(documents, bound)
    return prints.join(comps, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, bound: int = BOUND) -> DataFrame:
    """One document of each component, with all its columns: the least (doc_id, text digest); of rows that repeat both, one."""
    _, comps = _resolved(documents, bound)
    stays = comps.select(F.col("stays.doc_id").alias("s_id"), F.col("stays.key").alias("s_key")).distinct()
    d = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("own"), text_key(F.col("text")).alias("digest"))
    kept = d.join(stays, d["own"].eqNullSafe(stays["s_id"]) & (d["digest"] == stays["s_key"]), "left_semi")
    return kept.dropDuplicates(["own", "digest"]).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
