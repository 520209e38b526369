"""Benchmark decontamination: prefix-filtered set join over item-sized word windows.

Only DataFrame functions run on this path. A first pass counts how often each benchmark shingle occurs in the corpus;
that orders shingles by rarity. Containment of a whole window needs a prefix of one: its rarest shingle. The second pass
joins the corpus's shingles with these prefix tokens alone; a place that meets one is a candidate if the window's length
and the shingle's position in it fit the document. Only candidates' documents are read again to compare the words.
What is shuffled beyond the broadcast bounds are keys and places, never words of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_enough, text_key

#: What lies between words. split() on it is many times faster on the JVM than extracting the words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: Rows up to which a benchmark-side table is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: words, n (their number) and item_ids (distinct, as strings; null ids are not listed)."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    each = w.select("item_id", "n", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("n")))).alias("words"))
    return each.groupBy("words", "n").agg(F.collect_set("item_id").alias("item_ids"))


def _shingle(hashes: Column, start: Column, size) -> Column:
    """Of an array of word hashes; chained over the elements, so equal to xxhash64() of them as arguments."""
    return F.xxhash64(F.slice(hashes, start, size))


def _hashes(words: Column | str) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_GAP), "")).cast("long")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def _places(docs: DataFrame, size: int) -> DataFrame:
    """The other columns of docs, n_words, p (0-based word) and h for every shingle of `size` words of docs (wh: hashes of words)."""
    rest = [c for c in docs.columns if c != "wh"]
    # Positions are exploded, not hashes: then the hash is made in generated code, without an array of them.
    # An outer explode and no filter: either filter would be pushed below and tokenise every text once more.
    places = F.when(F.size("wh") >= size, F.sequence(F.lit(0), F.size("wh") - size))
    at = docs.select(*rest, "wh", F.explode_outer(places).alias("p"))
    h = F.xxhash64(*[F.try_element_at("wh", F.col("p") + k) for k in range(1, size + 1)])  # as _shingle() has it
    return at.select(*rest, F.size("wh").alias("n_words"), "p", h.alias("h"))


def contaminated_windows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified occurrences: doc_id, key (digest of the text), start (1-based word), n (words) and item_ids.

    A document here is a (doc_id, text) pair; rows that repeat both count once. Null and empty texts have no words, and
    an item without words has no window. Extra columns are ignored.
    """
    windows = benchmark_windows(benchmark, window).withColumn("s", F.least(F.col("n"), F.lit(SHINGLE)))
    offsets = F.sequence(F.lit(0), F.col("n") - F.col("s"))
    tokens = F.transform(offsets, lambda o: F.struct(_shingle(_hashes("words"), o + 1, F.col("s")).alias("h"), o.alias("o")))
    windows = materialize(windows.select("words", "n", "s", "item_ids", tokens.alias("tokens")), "windows")
    sizes = sorted(r.s for r in windows.select("s").distinct().collect())  # at most SHINGLE values

    docs = documents.select("doc_id", text_key(F.col("text")).alias("key"), _hashes(words_of(F.col("text"))).alias("wh"))
    known = windows.select("s", F.explode("tokens.h").alias("h")).distinct()
    rarity = None
    for s in sizes:
        own = materialize(known.where(F.col("s") == s).select("h"), "tokens")
        counted = _places(docs.select("wh"), s).select("h").join(_sized(own, broadcast_rows), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        counted = counted.select(F.lit(s).alias("s"), "h", "df")
        rarity = counted if rarity is None else rarity.unionByName(counted)
    if rarity is None:
        return documents.sparkSession.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, key string, start int, n int, item_ids array<string>")
    rarity = materialize(rarity, "rarity")

    # A window with a shingle that occurs nowhere has no candidate; of equally rare shingles the least hash is the prefix.
    ranked = windows.select("words", "n", "s", F.size("tokens").alias("all"), F.explode("tokens").alias("t"))
    ranked = ranked.select("words", "n", "s", "all", F.col("t.h").alias("h"), F.col("t.o").alias("o")).join(rarity, ["s", "h"])
    prefix = ranked.groupBy("words", "n", "s", "all").agg(F.min(F.struct("df", "h", "o")).alias("t"), F.count(F.lit(1)).alias("found"))
    prefix = materialize(prefix.where("found = all").select("words", "n", "s", F.col("t.h").alias("h"), F.col("t.o").alias("o")), "prefix")
    cand = None
    for s in sizes:
        at = _places(docs, s).join(_sized(prefix.where(F.col("s") == s), broadcast_rows // 10), "h")
        start = F.col("p") - F.col("o")
        at = at.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc_id", "key", (start + 1).alias("start"), "n", "words")
        cand = at if cand is None else cand.unionByName(at)
    cand = materialize(cand.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "words")).alias("places")), "candidates")

    side = cand.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key"), "places")
    side = F.broadcast(side) if small_enough(side, broadcast_rows // 100) else side
    d = documents.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    d = d.join(side, d["doc_id"].eqNullSafe(side["c_id"]) & (d["key"] == side["c_key"]))
    held = lambda w: F.filter("places", lambda c: F.slice(w, c["start"], c["n"]) == c["words"])
    # transform() over an array of one: the words are split once for a document, not once for a place.
    good = F.element_at(F.transform(F.array(words_of(F.col("text"))), held), 1)
    good = d.select("doc_id", "key", F.explode(good).alias("c")).select("doc_id", "key", "c.start", "c.n", "c.words").distinct()
    return good.join(windows.select("words", "n", "item_ids"), ["words", "n"]).select("doc_id", "key", "start", "n", "item_ids")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and key (digest of the text).

    Every input row gets one row, repeated rows the same one; null text has no words and so no hit.
    """
    found = contaminated_windows(documents, benchmark, window, broadcast_rows)
    hit = F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
    found = found.groupBy("doc_id", "key").agg(F.size(F.array_distinct(hit)).cast("long").alias("n_hit"), ids.alias("items"))
    d = documents.select("doc_id", text_key(F.col("text")).alias("key"), n_words(F.col("text")).alias("n_words"))
    f = found.withColumnRenamed("doc_id", "f_id").withColumnRenamed("key", "f_key")
    out = d.join(f, d.doc_id.eqNullSafe(f.f_id) & (d.key == f.f_key), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "key",
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a window of any benchmark item, with all their columns; a document with a hit goes whole."""
    found = contaminated_windows(documents, benchmark, window).select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key")).distinct()
    found = materialize(found, "leaks")
    own = text_key(documents["text"])
    return documents.join(found, documents["doc_id"].eqNullSafe(found["f_id"]) & (own == found["f_key"]), "left_anti")
