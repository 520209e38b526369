"""Line dedup against brute force over all pairs of lines, with one and with two edits."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from phenoquarry.llm import linededup as L


def plain(rows, edits):
    """(doc_id, text that stays, lines, dropped) of every row."""
    place = lambda i, t: (i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
    says = lambda x: any(ord(c) > 127 or c.isalnum() for c in x)
    norm = lambda x: " ".join(x.split())
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: place(r[0], r[1])):
        for n, line in enumerate((t or "").split("\n")):
            if says(line):
                first.setdefault(norm(line), (*place(i, t), n))
    close = {x for x in first for y in first if first[y] < first[x] and L.near(x, y, edits)} if edits else set()
    out = []
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        keep = [s for n, s in enumerate(ls) if not says(s) or (norm(s) not in close and first[norm(s)] == (*place(i, t), n))]
        out.append((i, None if t is None else "\n".join(keep), 0 if t is None else len(ls), 0 if t is None else len(ls) - len(keep)))
    return out, len(close)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 8, 9, 15, 16, 17, 18, 24, 40]))]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randrange(4)):
                what, at = rng.randrange(4), rng.randrange(len(own))
                if what == 0:
                    own[at] = rng.choice(vocabulary)
                elif what == 1 and len(own) > 2:
                    del own[at]
                elif what == 2:
                    own.insert(at, rng.choice(vocabulary))
                else:
                    own.insert(rng.randrange(len(own)), own.pop(at))
            rows.append((" " * rng.randrange(2) + (" " * rng.randrange(1, 3)).join(own)))
    rng.shuffle(rows)
    return [(i, "\n".join(rows[5 * i : 5 * i + 5]), None) for i in range(40)] + [(77, "short line here\n---\nshort line here\n\n---", None), (None, "w1 w2", None), (78, None, None), (79, "", None), (78, None, None)]


@pytest.mark.parametrize(("edits", "broadcast"), [(0, 1), (1, 1_000_000), (1, 0), (2, 1_000_000), (2, 0)])
def test_generated_lines(spark, monkeypatch, edits, broadcast):
    monkeypatch.setattr(L, "BROADCAST_ROWS", broadcast)
    rows = corpus(5)
    want, n_close = plain(rows, edits)
    assert n_close > 20 if edits else n_close == 0
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t, _ in rows], "doc_id long, text string, __key string, n_lines int").repartition(3)
    got = L.dedup_lines(docs, edits)
    assert got.columns == ["doc_id", "text", "__key", "n_lines", "n_dropped"]
    assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()))) == sorted(map(str, want))


def test_odd_rows(rows, documents):
    some = [r for r in rows if len(r[1] or "") < 100_000]
    want, _ = plain(some, 1)
    got = L.dedup_lines(documents.where("text is null or length(text) < 100000"))
    assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()))) == sorted(map(str, want))
    assert L.dedup_lines(documents.limit(0)).count() == 0


def test_parsing_in_parts(monkeypatch):
    """Words, lines and their numbers don't depend on how many bytes are parsed at once."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bb", "é", " ", "  ", "\n", "\t", "-", "9", "\r"]) for _ in range(rng.randrange(300))) for _ in range(60)] + ["", "x" * 500, "y " * 300, "\n\n", None]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    every = lambda: [(d, n, i, j, x.text(k)) for x in L._parsed(batch) for k, (d, n, i, j) in enumerate(zip(x.doc.tolist(), x.n.tolist(), x.id1.tolist(), x.id2.tolist()))]
    whole = every()
    assert {(d, n, t) for d, n, _, _, t in whole} == {(d, n, " ".join(line.split())) for d, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if any(ord(c) > 127 or c.isalnum() for c in line)}
    assert len({t for *_, t in whole}) == len({(i, j) for _, _, i, j, _ in whole})
    for piece in (1, 7, 64):
        monkeypatch.setattr(L, "PIECE", piece)
        assert every() == whole


def test_distance():
    assert L.word_distance(list("kitten"), list("sitting"), 3) == 3 and L.word_distance(list("kitten"), list("sitting"), 2) == 3
    with pytest.raises(ValueError):
        L.dropped_lines(None, 3)


def test_filters_let_all_their_keys_pass_and_few_others():
    rng = np.random.default_rng(3)
    own, other = (rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in "ab")
    buckets = [own[own % 7 == b] for b in range(6)]  # none in the last one
    tables = [L._filter(pa.table({"bucket": pa.array([b] * len(k), pa.int32()), "k": pa.array(k.view(np.int64))})) for b, k in enumerate(buckets)]
    f = L.Filters([(t.column("bucket")[0].as_py(), t.column("bits")[0].as_py()) for t in tables], 7)
    with np.errstate(over="ignore"):
        assert len(f.bits) <= 4 * len(own)
        assert f.passes(np.concatenate(buckets)).tolist() == list(range(sum(map(len, buckets))))
        assert len(f.passes(own[own % 7 == 6])) == 0
        assert len(f.passes(other)) < len(other) / 100


@pytest.mark.parametrize("filtered", [True, False])
def test_many_shared_segments_do_not_shuffle_all_lines(spark, monkeypatch, filtered):
    """Beyond BROADCAST_ROWS shared keys, lines are still chosen where they are read; only beyond FILTER_ROWS by a join."""
    seen, reviver = [], L._reviver
    monkeypatch.setattr(L, "_reviver", lambda edits, shared: seen.append(shared) or reviver(edits, shared))
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    if not filtered:
        monkeypatch.setattr(L, "FILTER_ROWS", 0)
    words = [f"w{i}" for i in range(10)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(10)] + [(20 + k, f"line {k} " + " ".join(f"u{k}v{i}" for i in range(9))) for k in range(30)]
    got = {r.doc_id: r.drops for r in L.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: [0] for k in range(1, 10) if any(L.near(rows[j][1], rows[k][1]) for j in range(k))}
    assert (seen[0] is not None) == filtered
