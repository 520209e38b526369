"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point alone. A trigram's vector binds (multiplies)
its letters' vectors, permuted by their place; a document's vector bundles (adds) those of its trigrams, and a language's
prototype bundles the unit vectors of its labelled documents, less the mean over languages. A document gets the language
of highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 512
N = 3
UNKNOWN = "und"
#: Trigram vectors that a worker keeps at most (one byte for each dimension).
KEPT = 100_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _letters(codes: np.ndarray) -> np.ndarray:
    """A row of DIM signs for each code point, from a counter-based generator: the same on every machine."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(DIM) + np.arange(DIM, dtype=np.uint64) + _GOLDEN
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return np.where((x >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int8)


def _bind(grams: np.ndarray) -> np.ndarray:
    """Vectors of packed trigrams (three code points of 21 bits)."""
    out = np.ones((len(grams), DIM), np.int8)
    for place in range(N):
        codes, back = np.unique((grams >> np.int64(21 * place)) & np.int64((1 << 21) - 1), return_inverse=True)
        out *= np.roll(_letters(codes), place, axis=1)[back]
    return out


class Encoder:
    """Texts to document vectors (float32, not scaled); None for a text without letters."""

    def __init__(self) -> None:
        self.known, self.table = np.zeros(0, np.int64), np.zeros((0, DIM), np.int8)
        self.is_letter = np.zeros(0x110000, np.int8) - 1  # not looked up yet

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of letters and single blanks (any run of others is a blank), with counts."""
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        flags = self.is_letter[x]
        for c in np.unique(x[flags < 0]):
            self.is_letter[c] = chr(c).isalpha()
        flags = self.is_letter[x]
        if not flags.any():
            return None
        x = np.where(flags, x, 32)
        x = np.concatenate([[32], x, [32]])
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
        packed = x[:-2] | x[1:-1] << 21 | x[2:] << 42
        return np.unique(packed, return_counts=True)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        found = [self.grams(t) if t else None for t in texts]
        fresh = [g[0] for g in found if g]
        if fresh:
            new = np.setdiff1d(np.unique(np.concatenate(fresh)), self.known)
            if len(new):
                if len(self.known) + len(new) > KEPT:
                    self.known, self.table = self.known[:0], self.table[:0]
                    new = np.unique(np.concatenate(fresh))
                known = np.concatenate([self.known, new])
                order = np.argsort(known)
                self.known, self.table = known[order], np.concatenate([self.table, _bind(new)])[order]
        return [None if g is None else g[1].astype(np.float32) @ self.table[np.searchsorted(self.known, g[0])].astype(np.float32) for g in found]


#: Texts that are encoded together.
STEP = 64


def _encoded(b: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple[int, np.ndarray | None]]:
    for i in range(0, b.num_rows, STEP):
        for k, v in enumerate(encoder.encode(b.column("text").slice(i, STEP).to_pylist())):
            yield i + k, v


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, sums = Encoder(), {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for i, v in _encoded(b, encoder):
            if v is not None and (norm := float(np.linalg.norm(v))) > 0:
                sums.setdefault(langs[i], np.zeros(DIM))[:] += v / norm
    for lang, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(s)], ["lang", "i", "x"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit rows, centred) from rows (text, lang); rows without either are passed over.

    All rows count. What comes to the driver is one vector for each language.
    """
    d = labelled.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    rows = d.mapInArrow(_bundles, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in rows})
    at = {lang: k for k, lang in enumerate(langs)}
    p = np.zeros((len(langs), DIM))
    for r in rows:
        p[at[r.lang], r.i] = r.x
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return langs, p


def _predictor(langs: list[str], prototypes: np.ndarray):
    mean = prototypes.mean(0) if len(langs) > 1 else np.zeros(DIM)
    p = prototypes - mean
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in batches:
            pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for i, v in _encoded(b, encoder):
                if v is not None and langs:
                    v = v / max(float(np.linalg.norm(v)), 1e-12)
                    cos = prototypes @ v
                    k = int(np.argmax(p @ (v - mean)))
                    pred[i], score[i] = langs[k], min(1.0, max(0.0, float(cos[k])))
            kept = [b.column(c) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred), pa.array(score)], [*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    return run


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns in keep (not text) with lang_pred and score: the cosine with the language's prototype, at least 0.

    A null text, or one without a letter, is `und` with score 0, and so is every text if no language was learned. One
    row for each input row.
    """
    d = documents.select(*keep, "text")
    schema = T.StructType([d.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return d.mapInArrow(_predictor(*model), schema)


def is_held_out():
    """crc32 of the doc_id as text, modulo 3, is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that aren't held out."""
    model = train(documents.where(~is_held_out()))
    return predict(documents.withColumn("held_out", is_held_out()), model, ["doc_id", "held_out"])


def reject_unidentified(documents: DataFrame, least_score: float) -> DataFrame:
    """The documents, with their own columns, whose language is found: some letter, and a cosine of least_score or more."""
    model = train(documents.where(~is_held_out()))
    langs, p = model
    names = documents.columns
    packed = documents.select(F.struct(*names).alias("row"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept(batches, langs, p, least_score)

    return packed.mapInArrow(keep, packed.schema).select("row.*")


def _kept(batches, langs, prototypes, least_score):
    predict_batch = _predictor(langs, prototypes)
    for b in batches:
        b = pa.RecordBatch.from_arrays([b.column("row").field("text"), b.column("row")], ["text", "row"])
        for out in predict_batch(iter([b])):
            good = [i for i, (x, s) in enumerate(zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist())) if x != UNKNOWN and s >= least_score]
            yield out.select(["row"]).take(pa.array(good, pa.int64()))
