"""Readers, writers, project codec, CSV and the page stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from phenoquarry.functions import identity
from phenoquarry.operators import checks
from phenoquarry.sources import readers
from phenoquarry.streaming import pages


def _evidence(spark):
    rows = [("page A", "sha", "primary", "tile_0001", i, i % 2) for i in range(4)]
    d = spark.createDataFrame(rows, "page_id string, source_sha256 string, provider string, source_tile_id string, source_prediction_index int, source_component_index int")
    d = d.withColumn("class_id", F.lit(0)).withColumn("class_name", F.lit("awn")).withColumn("confidence", F.lit(0.5))
    box = F.struct(*[F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    d = d.withColumn("tile", box).withColumn("box", box).withColumn("rings", F.lit(None).cast(readers.RINGS))
    own = identity.evidence_id(*[F.col(c) for c in ("page_id", "class_name", "provider", "source_tile_id", "source_prediction_index", "source_component_index")])
    return d.withColumn("evidence_id", own)


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "snap")
    readers.write_snapshots(_evidence(spark), path)
    back = readers.read_snapshots(spark, path)
    assert back.count() == 4 and checks.duplicates(back, "evidence_id").count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readers.write_snapshots(_evidence(spark), path)


def test_changed_snapshot_is_refused(spark, tmp_path):
    path = str(tmp_path / "snap")
    readers.write_snapshots(_evidence(spark).withColumn("evidence_id", F.lit("ev_x")), path)
    with pytest.raises(readers.FormatError):
        readers.read_snapshots(spark, path)


def test_project_codec(spark):
    rows = [("s", None, "img", 10, 20), ("r", "s", "img", 10, 20)]
    d = spark.createDataFrame(rows, "page_id string, source_page_id string, src string, width int, height int")
    coded = readers.encode_project(d)
    assert {r.page_id: r.src for r in coded.collect()} == {"s": "img", "r": None}
    assert {r.page_id: r.src for r in readers.decode_project(coded).collect()} == {"s": "img", "r": "img"}
    with pytest.raises(readers.FormatError):
        readers.decode_project(coded.where("page_id = 'r'"))


def test_patch_presence_counts(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "y")], "page_id string, groups string")
    p = spark.createDataFrame([("a", 1, "z"), ("a", 2, None)], "page_id string, version int, groups string")
    assert {r.page_id: r.groups for r in readers.apply_patches(m, p, ["groups"]).collect()} == {"a": None, "b": "y"}


def test_csv_text(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, '=1+"x"', 1.0005), (1, 2, "plain", None)], "page_id int, ordinal int, name string, length_mm double")
    out = readers.simple_csv(d).first().csv
    assert out == "﻿ID,Awn length (mm)\r\n\"'=1+\"\"x\"\"\",1.000\r\n\"plain\","
    n = readers.zip_pages(spark.createDataFrame([(1, "p", out)], "ordinal int, name string, csv string"), str(tmp_path / "z.zip"))
    assert n == 1 and zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["1_p.csv"]


def test_registry_and_natural_order(spark):
    o = spark.createDataFrame([("m", "yolo", "official")], "model_id string, adapter string, origin string")
    c = spark.createDataFrame([("m", "yolo", "custom"), ("n", "nope", "custom"), (None, "yolo", "custom"), ("k", "yolo", "custom")], o.schema)
    assert {(r.model_id, r.origin) for r in readers.merge_registries(o, c, ["yolo"]).collect()} == {("m", "official"), ("k", "custom")}
    f = spark.createDataFrame([("p10.png", "image/png"), ("p9.png", "image/png"), ("x.gif", "image/gif")], "name string, mime string")
    assert [r.name for r in readers.import_images(f).orderBy("position").collect()] == ["p9.png", "p10.png"]


def test_forced_attachments_may_be_missing(spark, tmp_path):
    assert readers.forced_attachments(spark, str(tmp_path / "none.json")).count() == 0


def test_partition_faults(spark):
    whole = spark.range(5)
    faults = checks.partition_faults(whole, [whole.where("id < 3"), whole.where("id in (2, 3)"), spark.createDataFrame([(9,)], "id long")], "id")
    assert {(r.key, r.fault) for r in faults.collect()} == {(2, "repeated"), (4, "missing"), (9, "foreign")}


def test_stream_of_pages(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    readers.write_snapshots(_evidence(spark), src)
    q = pages.process(pages.snapshot_stream(spark, src), lambda d: d.groupBy("page_id").count(), out, ck).start()
    q.processAllAvailable()
    q.stop()
    assert [r["count"] for r in spark.read.parquet(out).collect()] == [4]
