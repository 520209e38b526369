"""Decontamination, SimHash, language ID, substrings, packing, line dedup and licences against brute force on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from tokenizers import Tokenizer

from phenoquarry.llm import components, decontam, langid, packing, simhash, substring

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def same_rows(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_decontamination(rows, documents, benchmark, broadcast_rows):
    windows = defaultdict(set)
    for b in benchmark.collect():
        w = words(b.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])] |= {str(b.item_id)} if b.item_id is not None else set()
    want = []
    for i, t, _ in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[x]
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    got = decontam.decontaminate(documents, benchmark, broadcast_rows=broadcast_rows).drop("key").collect()
    same_rows([tuple(r) for r in got], want)
    clean = Counter(i for i, _, _, _, _, bad in want if not bad)
    assert Counter(r.doc_id for r in decontam.remove_contaminated(documents, benchmark).collect()) == clean


def test_empty_tables(documents, benchmark):
    none = documents.limit(0)
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert decontam.decontaminate(documents, benchmark.limit(0)).where("contaminated").count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert langid.identify(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def closure(prints, bound):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bound:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash(rows, documents):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    root = closure(prints, 3)
    least = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{p:016x}", least.get(r)) for (i, _, _), p, r in zip(rows, prints, root)]
    same_rows([tuple(x) for x in simhash.near_duplicates(documents).collect()], want)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == len(set(root))


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    """Many fingerprints near one another: groups are refined, and what is linked stays the same."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(60):
            prints.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "GROUP", 8)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(nodes)).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = [roots.get(x, x) for x in signed]
    want = closure(prints, 3)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_allotment_is_complete():
    parts = [list(range(k, 64, 3)) for k in range(3)]
    cost, ts = simhash.allot(parts, [1e6, 10.0, 10.0], np.full(64, 0.5), 1000, 3)
    assert sum(t + 1 for t in ts) == 4 and cost > 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_language(rows, documents):
    got = langid.identify(documents).collect()
    assert len(got) == len(rows)
    lang = defaultdict(list)
    for i, t, la in rows:
        lang[i].append((t, la))
    held = right = 0
    for r in got:
        texts = [t for t, _ in lang[r.doc_id]]
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if all(not any(c.isalpha() for c in t or "") for t in texts):
            assert r.lang_pred == "und"
        elif r.held_out and r.doc_id < 9000:
            held += 1
            right += r.lang_pred == lang[r.doc_id][0][1]
    assert right / held > 0.9


def test_language_vectors_and_prototypes(spark, rows):
    """Letters, trigrams, documents, prototypes and cosines, one trigram at a time, without any of the encoder's tables."""
    some = [r for r in rows if len(r[1] or "") < 3000][:150]

    def vector(text):
        if not any(c.isalpha() for c in text or ""):
            return None
        x = re.sub(r" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        out = np.zeros(langid.DIM)
        for gram in zip(x, x[1:], x[2:]):
            bound = np.ones(langid.DIM)
            for place, c in enumerate(gram):
                bound *= np.roll(langid._letters(np.array([ord(c)]))[0].astype(float), place)
            out += bound
        return out / max(np.linalg.norm(out), 1e-12)

    vectors = [vector(t) for _, t, _ in some]
    held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in some]
    langs = sorted({la for (_, t, la), v, h in zip(some, vectors, held) if la and t is not None and v is not None and not h})
    sums = np.array([sum((v for (_, t, la), v, h in zip(some, vectors, held) if la == k and v is not None and not h), np.zeros(langid.DIM)) for k in langs])
    protos = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    centred = protos - protos.mean(0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    want = []
    for (i, _, _), v, h in zip(some, vectors, held):
        k = None if v is None else int(np.argmax(centred @ (v - protos.mean(0))))
        want.append((i, h, "und" if k is None else langs[k], 0.0 if k is None else round(min(1, max(0, protos[k] @ v)), 4)))
    got = langid.identify(spark.createDataFrame([r for r in some], "doc_id long, text string, lang string")).collect()
    close = Counter((i, h, p) for i, h, p, _ in want)
    assert Counter((r.doc_id, r.held_out, r.lang_pred) for r in got) == close
    scores = defaultdict(list)
    for i, _, p, s in want:
        scores[(i, p)].append(s)
    assert all(min(abs(r.score - s) for s in scores[(r.doc_id, r.lang_pred)]) < 1e-3 for r in got)


def test_substrings(rows, documents):
    order = sorted(range(len(rows)), key=lambda k: -(1 << 63) if rows[k][0] is None else rows[k][0])
    first, want = {}, []
    for k in order:
        i = -(1 << 63) if rows[k][0] is None else rows[k][0]
        b = (rows[k][1] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t, _ in rows:
        b, own = (t or "").encode(), -(1 << 63) if i is None else i
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < own:
                gone[p : p + 50] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    same_rows([tuple(r) for r in substring.remove_repeats(documents).collect()], want)


def in_process(folder, chunks, buckets=3):
    """remove_repeats() without Spark, so that its bounds and hashes can be replaced: rows by doc_id."""
    batches = lambda rows: iter([pa.RecordBatch.from_pylist(rows)])
    done = [x for rows in chunks for b in substring._chunker(folder)(batches([{"doc_id": i, "text": t} for i, t in rows])) for x in b.to_pylist()]
    asked = pa.Table.from_batches(substring._asker(folder, buckets)(batches([{"chunk": x["chunk"]} for x in done])))
    by = lambda t, c: [(k, t.filter(pa.compute.equal(t.column(c), k))) for k in t.column(c).unique()]
    codes = pa.concat_tables([substring._answer_blocks(t) for _, t in by(asked, "bucket")])
    parts = pa.concat_tables([substring._fragmenter(folder, buckets)((k,), t) for k, t in by(codes, "chunk")])
    masks = [substring._answer_windows(t) for _, t in by(parts, "bucket")]
    masks = pa.concat_tables(masks) if masks else None
    out = [substring._finisher(folder, buckets, False)((k,), t, masks.filter(pa.compute.equal(masks.column("chunk"), k))) for k, t in by(codes, "chunk")]
    return sorted(((r["doc_id"], r["n_removed"]) for t in out for r in t.to_pylist()))


@pytest.mark.parametrize("change", [{}, {"HOT": 5}, {"HOT": 1 << 30}, {"LOCAL_HOT": 3}, {"PIECE": 64}, {"weak": True}])
def test_substrings_in_process(tmp_path, monkeypatch, change):
    """Documents cut into small pieces, many contexts of one anchor (in one chunk or in all), hashes that collide."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdef"), n))
    phrase = "the quick brown fox jumps over the lazy dog and runs "
    texts = [letters(rng.integers(5, 40)) + phrase[: rng.integers(40, 54)] + letters(rng.integers(5, 300)) for _ in range(80)]
    texts += [texts[3], texts[7] + texts[3], texts[9][:120] + letters(40) + texts[9][100:]]
    seen, plain = {}, []
    for i, t in enumerate(texts):
        b, gone = t.encode(), set()
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone |= set(range(p, p + 50))
        plain.append((i, len(gone)))
    weak = change.pop("weak", False)
    for name, value in change.items():
        monkeypatch.setattr(substring, name, value)
    if weak:  # whole blocks get one of 64 hashes: claims that bytes don't bear out take nothing away
        blocks = substring.blocks
        monkeypatch.setattr(substring, "blocks", lambda t: (x := blocks(t)) | {"b": x["b"] % np.uint64(64)})
    rows = list(enumerate(texts))
    got = in_process(str(tmp_path), [rows[0::3], rows[1::3], rows[2::3]])
    if weak:
        assert all(g[1] <= w[1] for g, w in zip(got, plain))
    else:
        assert got == plain and sum(x for _, x in plain)


def test_suffix_sort():
    data = np.frombuffer(b"banana" * 20 + b"bandana" * 15 + b"x" * 60, np.uint8)
    at = np.random.default_rng(0).permutation(len(data) - 50)
    group = np.zeros(len(at), int)
    with np.errstate(over="ignore"):
        order = substring.suffix_sort(data, substring.Prefixes(data), at, group)
    keys = [bytes(data[a : a + 50]) for a in at[order]]
    assert keys == sorted(keys)


@pytest.mark.parametrize("special_as_text", [False, True])
def test_packing(rows, documents, spark, special_as_text):
    """Every piece of every document against the untouched tokenizer: start, length, checksum and whole document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    if special_as_text:
        tok.encode_special_tokens = True
    own = [*((i, t) for i, t, _ in rows), (9100, "a<|endoftext|>b"), (9101, "<|endoftext|>" * 2100), (9102, "tail <|endoftext|>"), (9103, "<|endoftext" + "|> x")]
    extra = spark.createDataFrame(own[-4:], "doc_id long, text string")
    want = Counter()
    for i, t in own:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    got = packing.pack(documents.select("doc_id", "text").union(extra), path, with_ids=True, special_as_text=special_as_text).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("special_as_text", [False, True])
def test_chunked_ids_equal_plain_ids(special_as_text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, chunks = Tokenizer.from_file(path), packing.Chunks(path, special_as_text)
    if special_as_text:
        tok.encode_special_tokens = True
    rng = np.random.default_rng(2)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "9", "!", "日", "\r\n", "the", "\xa0", "\u3000", "<|endoftext|>", "\u200b", "."]
    for _ in range(4000):
        t = "".join(rng.choice(bits, rng.integers(0, 14)))
        assert np.frombuffer(chunks.of(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_patterns_hold_all_pieces():
    rng = np.random.default_rng(4)
    counts = Counter(int(x) for x in rng.integers(1, 2049, 5000))
    counts[7] += 10_000
    patterns = packing.pack_histogram(dict(counts))
    placed = Counter()
    for n, p in patterns:
        assert sum(p) <= 2048
        for size in p:
            placed[size] += n
    assert placed == counts
    assert sum(counts[k] * k for k in counts) / (2048 * sum(n for n, _ in patterns)) > 0.95
