import pyarrow.parquet as pq
import pytest

#: Rows that no operator may trip over: nulls, empty and blank texts, repeated rows, equal texts, one long text.
ODD = [
    (None, None, None), (None, "only an id is missing here, nothing else at all", "en"), (9001, None, "en"), (9002, "", "en"), (9003, "   \n\n ", None),
    (9004, "Übergrößen naïve café, ünder the bridge of sighs again", "de"), (9004, "Übergrößen naïve café, ünder the bridge of sighs again", "de"),
    (9005, "Übergrößen naïve café, ünder the bridge of sighs again", "de"), (9006, "12345 !!! ???", "en"), (9007, "a", "en"),
    (9008, "line that is long enough to count\nline that is long enough to cOunt\nLicensed under the Apache License, Version 2.0.\nRELEASED under the MIT License", "en"),
    (9009, "line that is long enough to count\nline that is long enough too count", "en"), (9010, "word " * 30_000, "en"), (9011, "x" * 120, "en"), (9012, "x" * 49, "en"), (9013, "日本語の文章です。" * 20, "ja"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, fp string, h long, w string, score double, __key string, row int"


@pytest.fixture(scope="session")
def rows():
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return [(d["doc_id"], d["text"], d["lang"]) for d in table] + ODD


@pytest.fixture(scope="session")
def documents(spark, rows):
    """With extra columns whose names the operators use themselves."""
    full = [(*r, "s", len(r[1] or ""), "k", 1, "f", 2, "w", 0.5, "kk", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def benchmark(spark):
    table = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
    items = [(b["item_id"], b["text"]) for b in table] + [(900, None), (901, ""), (902, "naïve café"), (None, "bridge of sighs"), (903, "BRIDGE of sighs"), (904, "!!!")]
    return spark.createDataFrame(items, "item_id long, text string")
