"""The pipeline's stages: their order, columns, and what each keeps, on the odd rows and the smallest tables."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline as p
from phenoquarry.llm import decontam, langid

DATA = "/root/testdata/sf0.001"


def least_of_components(texts):
    """Least id of each group of texts linked by 0.8 or more of their five-word shingles in common, over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        was = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if was == least:
            break
    return set(least.values())


def test_stages(spark):
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols = docs.columns
    model = langid.train(docs.where(~langid.is_held_out()))
    good = langid.predict(docs, model, ["doc_id"]).where((F.col("lang_pred") != "und") & (F.col("score") >= p.LEAST_COSINE))
    a = p.language_id(spark, docs, DATA).cache()
    assert a.columns == cols and {r.doc_id for r in a.collect()} == {r.doc_id for r in good.collect()}
    b = p.line_dedup(spark, a, DATA).cache()
    assert b.columns == cols and b.count() == a.count() and b.where("n_chars <> length(text)").count() == 0
    c = p.near_dedup(spark, b, DATA).cache()
    assert {r.doc_id for r in c.collect()} == least_of_components({r.doc_id: r.text for r in b.collect()})
    d = p.decontaminate(spark, c, DATA).cache()
    bad = decontam.decontaminate(c, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated")
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - {r.doc_id for r in bad.collect()}
    e = p.pack(spark, d, DATA)
    whole = e.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.where("n <> m").count() == 0 and whole.count() == d.count()
    again = p.run(spark, DATA)
    assert Counter(map(tuple, again.select("doc_id", "start", "length", "ids_crc32").collect())) == Counter(map(tuple, e.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_odd_rows_pass_through(spark, documents):
    docs = documents
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == documents.columns
    assert p.pack(spark, docs, DATA).count() > 0
