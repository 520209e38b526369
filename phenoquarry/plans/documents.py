"""Registered queries over sources, sinks, identities and checks: documents are written and read back, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, polyline, text
from ..operators import checks, documents, matching
from ..sources import readers
from ..sources.scratch import scratch
from .relational import _query, _r

_ID = """'ev_' || class_name || '_p' || page_id || '_' || substr(sha256('{"namespace":"detection_evidence","payload":{"page_id":"p' || page_id || '","prediction_index":' || det_id || ',"provider":"primary","tile_id":"t' || tile_id || '"}}'), 1, 20)"""


def _evidence(det: DataFrame) -> DataFrame:
    c = F.col
    page, tile, box = F.concat(F.lit("p"), c("page_id").cast("string")), F.concat(F.lit("t"), c("tile_id").cast("string")), F.struct("x1", "y1", "x2", "y2")
    d = det.select(
        page.alias("page_id"), F.lit("s").alias("source_sha256"), identity.evidence_id(page, c("class_name"), F.lit("primary"), tile, c("det_id").cast("int"), F.lit(0)).alias("evidence_id"),
        c("class_id").cast("int").alias("class_id"), "class_name", "confidence", F.lit("primary").alias("provider"), tile.alias("source_tile_id"), c("det_id").cast("int").alias("source_prediction_index"),
        F.lit(0).alias("source_component_index"), F.struct(c("tx1").alias("x1"), c("ty1").alias("y1"), (c("tx1") + 640).alias("x2"), (c("ty1") + 640).alias("y2")).alias("tile"), box.alias("box"), F.lit(None).cast(readers.RINGS).alias("rings"),
    )
    return d


@_query("S10_K1_evidence_round_trip", f"select 'p' || page_id as page_id, {_ID} as evidence_id, confidence, x1, y2 from fx_detections", "fx_detections")
def _s10(det):
    path = scratch(det.sparkSession, "evidence")
    readers.write_snapshots(_evidence(det), path)
    return readers.read_snapshots(det.sparkSession, path).select("page_id", "evidence_id", "confidence", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"))


@_query("C3_snapshot_ids", "select 'p' || page_id as page_id, 'snap_' || substr(sha256(string_agg(id, chr(10) order by id)), 1, 20) as snapshot_id from (select page_id, " + _ID + " as id from fx_detections) z group by page_id", "fx_detections")
def _c3(det):
    return _evidence(det).groupBy("page_id").agg(F.collect_list(F.struct("evidence_id")).alias("e")).select("page_id", readers.snapshot_id(F.col("e")).alias("snapshot_id"))


@_query(
    "K2_K3_K4_S11_S12_S13_stage_documents",
    "select 'reconciliation' as stage, page_id, class_name as item, count(*) as n from fx_detections group by all union all select 'seeds', page_id, case when confidence < 0.2 then 'unresolved' else 'seeded' end, count(*) from fx_detections group by all union all select 'cleanup', page_id, case when x1 <= 2 or y1 <= 2 then 'rejected' else 'keep' end, count(*) from fx_detections where class_id = 1 group by all",
    "fx_detections",
)
def _stages(det):
    count = F.count(F.lit(1)).alias("n")
    seeds = matching.physical_seeds(det.withColumn("status", F.when(F.col("confidence") < 0.2, "ambiguous").otherwise("fused")))
    stages = {
        "reconciliation": det.groupBy("page_id", F.col("class_name").alias("item")).agg(count),
        "seeds": seeds.groupBy("page_id", F.col("outcome").alias("item")).agg(count),
        "cleanup": det.where("class_id = 1").groupBy("page_id", F.when((F.col("x1") <= 2) | (F.col("y1") <= 2), "rejected").otherwise("keep").alias("item")).agg(count),
    }
    out = None
    for name, d in stages.items():
        path = scratch(det.sparkSession, name)
        readers.write_stage(d, path, "json")
        back = readers.read_stage(det.sparkSession, path, "page_id long, item string, n long", ["page_id", "item", "n"]).select(F.lit(name).alias("stage"), "page_id", "item", "n")
        out = back if out is None else out.unionByName(back)
    return out


@_query("S3_S4_S9_tile_scan", "select page_id, det_id, x1 + tx1 as x1, y2 + ty1 as y2, class_name from fx_detections where confidence >= 0.25 and x2 > x1", "fx_detections")
def _s3(det):
    d = det.withColumn("tile", F.struct(F.col("tx1").alias("x1"), F.col("ty1").alias("y1"))).withColumn("source_prediction_index", F.col("det_id"))
    return readers.scan_tiles(d, 0.25).select("page_id", F.col("source_prediction_index").alias("det_id"), "x1", "y2", "class_name")


def _outputs(det: DataFrame, box: bool) -> DataFrame:
    """Raw model outputs: masks of four pixels at the corners of the boxes, one of them weak."""
    c = F.col
    at = lambda x, y, p: F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"), p.alias("p"))
    pixels = F.array(at(c("x1"), c("y1"), F.lit(0.9)), at(c("x2"), c("y1"), F.lit(0.8)), at(c("x1"), c("y2"), F.lit(0.7)), at(c("x2") + 50, c("y2") + 50, c("confidence")))
    own = [(c(k) if box else F.lit(None).cast("double")).alias(k) for k in ("x1", "y1", "x2", "y2")]
    return det.select(c("det_id").alias("prediction_id"), (c("class_id") + c("det_id") % 5 * 2).alias("label"), c("confidence").alias("score"), pixels.alias("pixels"), *own)


_LABEL = "class_id + det_id % 5 * 2"


@_query("S6_detr_adapter", f"select det_id as prediction_id, class_id, x1, y2, 4 as mask_px from fx_detections where {_LABEL} in (0, 1) and confidence >= 0.3", "fx_detections")
def _s6(det):
    return readers.adapter_boxes(_outputs(det, True), {0: 0, 1: 1}, 0.3).select("prediction_id", F.col("class_id").cast("bigint").alias("class_id"), "x1", "y2", "mask_px")


@_query("S7_mask_box_adapter", f"select det_id as prediction_id, 1 - ({_LABEL} - 2) as class_id, floor(x1) as x1, floor(y1) as y1, floor(x2) + 51 as x2, floor(y2) + 51 as y2 from fx_detections where {_LABEL} in (2, 3) and confidence >= 0.3", "fx_detections")
def _s7(det):
    return readers.adapter_boxes(_outputs(det, False), {2: 1, 3: 0}, 0.3).select("prediction_id", F.col("class_id").cast("bigint").alias("class_id"), "x1", "y1", "x2", "y2")


@_query("S8_mask_threshold_adapter", f"select det_id as prediction_id, case when confidence >= 0.5 then floor(x2) + 51 else floor(x2) + 1 end as x2, case when confidence >= 0.5 then 4 else 3 end as mask_px from fx_detections where {_LABEL} in (0, 1)", "fx_detections")
def _s8(det):
    return readers.adapter_boxes(_outputs(det, False), {0: 0, 1: 1}, 0.0, 0.5).select("prediction_id", "x2", "mask_px")


@_query("S14_adapted_predictions", "select page_id, tile_id, cast(i as int) as source_prediction_index, confidence from (select *, row_number() over (partition by page_id, tile_id order by det_id) - 1 as i from fx_detections) z where det_id % 5 <> 0", "fx_detections")
def _s14(det):
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    rings = F.when(F.col("det_id") % 5 != 0, F.array(ring)).otherwise(F.array(F.slice(ring, 1, 2)))
    d = det.groupBy(F.struct("page_id", "tile_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("det_id", "confidence", rings.alias("rings")))).alias("predictions"))
    return readers.adapt_predictions(d).select("page_id.page_id", "page_id.tile_id", "source_prediction_index", "confidence")


@_query("S15_rejections", "select det_id from fx_detections where class_id = 1 and det_id % 3 <> 0", "fx_detections")
def _s15(det):
    manifest = det.where("class_id = 1 and det_id % 3 = 0").select(F.col("det_id").alias("detection_id"), F.lit("reject").alias("decision"))
    return det.where("class_id = 1").join(readers.rejected_ids(manifest).withColumnRenamed("detection_id", "det_id"), "det_id", "left_anti").select("det_id")


@_query("S16_forced_attachments", "select det_id, case when det_id % 40 = 0 then det_id + 8 else det_id end as target_id from fx_detections where class_id = 1", "fx_detections")
def _s16(det):
    spark, path = det.sparkSession, scratch(det.sparkSession, "attachments")
    none = readers.forced_attachments(spark, path)  # nothing is written yet: no rows
    s = det.where("class_id = 1").select(F.col("page_id").cast("string").alias("page_id"), F.col("det_id").cast("string").alias("fragment_id"))
    s.where("cast(fragment_id as bigint) % 40 = 0").withColumn("target_id", (F.col("fragment_id").cast("long") + 8).cast("string")).write.json(path)
    forced = readers.forced_attachments(spark, path).unionByName(none)
    d = s.join(forced, ["page_id", "fragment_id"], "left")
    return d.select(F.col("fragment_id").cast("long").alias("det_id"), F.coalesce("target_id", "fragment_id").cast("long").alias("target_id"))


@_query("S17_valid_rings", "select det_id as id, case when det_id % 4 = 0 then 2 else 1 end::int as n from fx_detections where det_id % 4 <> 1", "fx_detections")
def _s17(det):
    c = F.col
    square = F.array(*[polyline.point(c(x), c(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    flat, few = F.array(polyline.point(c("x1"), c("y1")), polyline.point(c("x2"), c("y1")), polyline.point(c("x1"), c("y1"))), F.slice(square, 1, 2)
    rings = F.when(c("det_id") % 4 == 0, F.array(square, flat, square)).when(c("det_id") % 4 == 1, F.array(flat, few)).otherwise(F.array(few, square))
    return readers.rings_of(det.select(c("det_id").alias("id"), rings.alias("rings"))).select("id", F.size("rings").alias("n"))


def _stored(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Project pages: sources with an image, and results of their source's size that hold a copy."""
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), F.lit(None).cast("string").alias("source_page_id"), "width", "height", F.concat(F.lit("img"), "page_id").alias("src"), F.lit(None).cast("string").alias("inference"))
    of = results.join(pages.withColumnRenamed("page_id", "source_page_id"), "source_page_id")
    mine = of.select(F.concat(F.lit("r"), F.col("result_id").cast("string")).alias("page_id"), F.col("source_page_id").cast("string").alias("source_page_id"), "width", "height", F.concat(F.lit("img"), "source_page_id").alias("src"), F.concat(F.lit("run"), "model_id").alias("inference"))
    return own.unionByName(mine)


_STORED = "select page_id::varchar as page_id, null::varchar as source_page_id, 'img' || page_id as src, null::varchar as inference from fx_source_pages union all select 'r' || result_id, source_page_id::varchar, 'img' || source_page_id, 'run' || model_id from fx_results join fx_source_pages on page_id = source_page_id"


@_query("S18_K10_project_round_trip", f"select page_id, source_page_id, src from ({_STORED}) z", "fx_source_pages", "fx_results")
def _s18(pages, results):
    coded = readers.encode_project(_stored(pages, results))
    return readers.decode_project(coded).select("page_id", "source_page_id", "src")


@_query("K10_encoded_project", f"select page_id, case when source_page_id is null then src end as src from ({_STORED}) z", "fx_source_pages", "fx_results")
def _k10(pages, results):
    return readers.encode_project(_stored(pages, results)).select("page_id", "src")


@_query("S19_K13_patched_pages", "select page_id, case when page_id % 4 = 0 then null when page_id % 4 = 1 then 'edit2' else 'base' end as groups, case when page_id % 4 <= 1 then page_id + 0.5 else mm_per_px end as mm_per_px from fx_source_pages", "fx_source_pages")
def _s19(pages):
    base = pages.select("page_id", F.lit("base").alias("groups"), "mm_per_px")
    edit = lambda v, groups: pages.where("page_id % 4 <= 1").select("page_id", F.lit(v).alias("version"), groups.alias("groups"), (F.col("page_id") + v / 4).alias("mm_per_px"))
    last = F.when(F.col("page_id") % 4 == 1, "edit2")  # null is a value of the patch too
    return readers.apply_patches(base, edit(1, F.lit("edit1")).unionByName(edit(2, last)), ["groups", "mm_per_px"])


@_query("K11_K12_storage_parts", f"with p as ({_STORED}) select 'manifest' as part, count(*) as n from p union all select 'inference', count(*) from p where inference is not null union all select 'assets', count(distinct src) from p union all select 'unreferenced', count(distinct src) from p where src not in (select src from p where source_page_id is null and page_id::bigint % 3 <> 0)", "fx_source_pages", "fx_results")
def _k11(pages, results):
    stored = _stored(pages, results)
    parts = readers.split_project(stored)
    kept = stored.where("source_page_id is null and cast(page_id as bigint) % 3 <> 0").select("src")
    parts["unreferenced"] = readers.unreferenced(parts["assets"], kept, "src")
    out = None
    for name, d in parts.items():
        n = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@_query("S22_model_registry", "select 'm' || page_id as model_id, case when page_id % 2 = 0 then 'official' else 'custom' end as origin from fx_source_pages where page_id % 2 = 0 or page_id % 3 = 0", "fx_source_pages")
def _s22(pages):
    row = lambda d, origin, adapter: d.select(F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("model_id"), F.lit(origin).alias("origin"), adapter.alias("adapter"))
    official = row(pages.where("page_id % 2 = 0"), "official", F.lit("yolo"))
    custom = row(pages, "custom", F.when(F.col("page_id") % 3 == 0, "detr").otherwise("unheard-of"))
    return readers.merge_registries(official, custom, ["yolo", "detr"]).select("model_id", "origin")


@_query("S21_image_limits", "select page_id from fx_source_pages where page_id % 60 <= 40 and width*height <= 25000000", "fx_source_pages")
def _s21(pages):
    return pages.where(checks.observation_limits(F.col("page_id") % 60, F.col("width"), F.col("height"))).select("page_id")


@_query("S23_X16_pinned_files", "select 'part-' || page_id % 3 as file, case page_id % 3 when 0 then 'verified' when 1 then 'changed' else 'unknown' end as state from (select distinct page_id % 3 as page_id from fx_source_pages) z", "fx_source_pages")
def _s23(pages):
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "weights")
    d = pages.select((F.col("page_id") % 3).alias("k")).distinct()
    d.select(F.concat(F.lit("weights "), F.col("k").cast("string")).alias("value"), "k").write.partitionBy("k").text(path)
    files = readers.file_digests(spark, f"{path}/*/*.txt").withColumn("k", F.regexp_extract("path", "k=([0-9]+)", 1))
    files = files.select(F.concat(F.lit("part-"), "k").alias("path"), "sha256")
    content = F.concat(F.lit("weights "), F.col("k").cast("string"), F.when(F.col("k") == 1, "?").otherwise("\n"))
    pinned = d.where("k < 2").select(F.concat(F.lit("part-"), F.col("k").cast("string")).alias("path"), F.sha2(content, 256).alias("sha256"))
    return readers.verified_files(files, pinned).select(F.col("path").alias("file"), "state")


def _representatives(det: DataFrame) -> DataFrame:
    return det.where("class_id = 1 and det_id % 5 <> 0").select("page_id", F.col("det_id").alias("spikelet_id"), (F.col("det_id") % 100 / 4).alias("length_mm"), F.when(F.col("det_id") % 3 == 0, "short").otherwise("ok").alias("status"))


@_query(
    "K5_A31_closeout",
    "select page_id, count(*) as n_spikelets, sum(case when det_id % 5 <> 0 then 1 else 0 end)::bigint as n_representatives, sum(case when det_id % 5 = 0 or det_id % 3 = 0 then 1 else 0 end)::bigint as n_diagnostics, sum(case when det_id % 5 <> 0 then (det_id % 100)/4.0 else 0 end) as length_mm, sha256(coalesce(string_agg(case when det_id % 5 <> 0 then det_id || '|' || case when det_id % 3 = 0 then 'short' else 'ok' end end, chr(10) order by det_id || '|' || case when det_id % 3 = 0 then 'short' else 'ok' end), '')) as representatives_sha256 from fx_detections where class_id = 1 group by page_id",
    "fx_detections",
)
def _k5(det):
    out = readers.closeout(_representatives(det), det.where("class_id = 1").select("page_id", F.col("det_id").alias("spikelet_id")))
    return out["summary"].join(out["manifest"], "page_id")


@_query("K6_result_documents", "select page_id, 2 as version, count(*)::int as n, round(sum((det_id % 100)/4.0), 6) as length_mm from fx_detections where class_id = 1 and det_id % 5 <> 0 group by page_id", "fx_detections")
def _k6(det):
    d = readers.result_documents(_representatives(det))
    doc = F.from_json("document", "version int, measurements array<struct<spikelet_id:long,length_mm:double,status:string>>")
    d = d.select("page_id", doc.alias("d"))
    return d.select("page_id", "d.version", F.size("d.measurements").alias("n"), _r(F.aggregate("d.measurements", F.lit(0.0), lambda a, m: a + m["length_mm"])).alias("length_mm"))


_CELL = """'"' || replace(case when regexp_matches({0}, '^\\s*[=+@-]') then '''' || {0} else {0} end, '"', '""') || '"'"""
_MM = "coalesce(printf('%.3f', length_mm), '')"


@_query("K8_detailed_lines", f"""select name_id, '"img.png",' || {_CELL.format('name')} || ',"' || {_MM} || '","' || {_MM} || '","automatic","' || case when name_id % 2 = 0 then 'low_confidence; crossing' else '' end || '","true","false","m","p"' as line from fx_names""", "fx_names")
def _k8(names):
    c = F.col
    d = names.select("name_id", F.lit("img.png").alias("source_name"), "name", c("length_mm").alias("automatic_mm"), c("length_mm").alias("final_mm"), F.lit("automatic").alias("status"),
                     F.when(c("name_id") % 2 == 0, F.array(F.lit("low_confidence"), F.lit("crossing"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.lit(True).alias("modified"), F.lit(None).cast("boolean").alias("confirmed"), F.lit("m").alias("model"), F.lit("p").alias("pipeline"))
    return readers.detailed_lines(d).select("name_id", "line")


@_query("K9_zip_pages", "select row_number() over (order by page_id) || '_p' || page_id || '.csv' as member, 3::bigint as bytes from (select page_id from fx_source_pages order by page_id limit 20) z", "fx_source_pages")
def _k9(pages):
    import tempfile
    import zipfile

    d = pages.orderBy("page_id").limit(20).select(F.col("page_id").alias("ordinal"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.lit("a,b").alias("csv"))
    with tempfile.TemporaryDirectory() as folder:  # an export is a file on the user's machine: the driver's
        readers.zip_pages(d, f"{folder}/x.zip")
        rows = [(i.filename, i.file_size) for i in zipfile.ZipFile(f"{folder}/x.zip").infolist()]
    return pages.sparkSession.createDataFrame(rows, "member string, bytes long")


@_query("K14_html_reports", "select page_id, '<h1>Run</h1><table>' || string_agg('<tr><td>' || det_id || '</td><td>' || case when det_id % 2 = 0 then 'a&amp;b' else '&lt;i&gt;' end || '</td></tr>', '' order by det_id) || '</table>' as html from fx_detections where class_id = 1 group by page_id", "fx_detections")
def _k14(det):
    cells = F.array(F.col("det_id").cast("string"), F.when(F.col("det_id") % 2 == 0, "a&b").otherwise("<i>"))
    return readers.html_report(det.where("class_id = 1").select("page_id", F.col("det_id").alias("ordinal"), cells.alias("cells")), "Run")


@_query("K15_page_payload", "select page_id, count(*) as n, sum(case when class_id = 0 then 1 else 0 end)::bigint as n_awn, sum(case when det_id % 9 = 0 then 1 else 0 end)::bigint as n_merged, 0.25::double as confidence, min(det_id) as first_id from fx_detections group by page_id", "fx_detections")
def _k15(det):
    merges = det.where("det_id % 9 = 0").select("page_id", F.col("det_id").alias("a"), (F.col("det_id") + 1).alias("b"))
    d = readers.page_payload({"confidence": 0.25, "nms": 0.7}, det, merges)
    j = lambda p, kind: F.get_json_object("payload", p).cast(kind)
    return d.select("page_id", j("$.counts.n", "long").alias("n"), j("$.counts.n_awn", "long").alias("n_awn"), j("$.counts.n_merged", "long").alias("n_merged"), j("$.config.confidence", "double").alias("confidence"), j("$.predictions[0].det_id", "long").alias("first_id"))


@_query("K16_public_jobs", "select page_id as job_id, case when page_id % 3 = 0 then 'done' else 'running' end as state, case when page_id % 3 = 0 then 'r' || page_id end as result from fx_source_pages", "fx_source_pages")
def _k16(pages):
    state = F.when(F.col("page_id") % 3 == 0, "done").otherwise("running")
    return readers.public_jobs(pages.select(F.col("page_id").alias("job_id"), state.alias("state"), F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("result"), F.lit("x").alias("preview"), F.lit("/tmp/f").alias("result_file")))


@_query("S20_natural_names", "select name, cast(row_number() over (order by k, name) as int) as position from (select distinct 'IMG ' || page_id % 200 || case when page_id % 2 = 0 then '.png' else '_b.png' end as name, page_id % 200 * 10 + page_id % 2 as k from fx_source_pages) z", "fx_source_pages")
def _s20(pages):
    n = F.col("page_id") % 200
    f = pages.select(F.concat(F.lit("IMG "), n.cast("string"), F.when(F.col("page_id") % 2 == 0, ".png").otherwise("_b.png")).alias("name"), F.lit("image/png").alias("mime")).distinct()
    return readers.import_images(f.unionByName(f.limit(1).select("name", F.lit("text/plain").alias("mime")))).select("name", "position")


@_query("J22_product_groups", "select s.page_id, s.det_id as spikelet_id, coalesce(case when s.det_id % 3 = 0 then 2 when s.det_id % 3 = 1 then 1 end, 0) as points from fx_detections s where class_id = 1", "fx_detections")
def _j22(det):
    s = det.where("class_id = 1").select("page_id", F.col("det_id").alias("spikelet_id"))
    line = lambda n: F.array_repeat(polyline.point(F.lit(0.0), F.lit(0.0)), n)
    first = s.where("spikelet_id % 3 <= 1").select("page_id", "spikelet_id", F.lit(1).alias("ordinal"), line(1).alias("line"))
    again = s.where("spikelet_id % 3 = 0").select("page_id", "spikelet_id", F.lit(2).alias("ordinal"), line(2).alias("line"))
    return readers.product_groups(first.unionByName(again), s).select("page_id", "spikelet_id", F.size("line").alias("points"))


@_query("U1_U2_hypothesis_union", "select page_id, count(*) as n, count(distinct tile_id) as n_tiles, string_agg(distinct tile_id::varchar, ',' order by tile_id::varchar) as tiles from fx_detections group by page_id", "fx_detections")
def _u1(det):
    d = documents.all_hypotheses(det.where("class_id = 1"), det.where("class_id = 0"))
    out = documents.distinct_union(d.select("page_id", F.array(F.col("tile_id").cast("string")).alias("ids")), "page_id", "ids")
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).join(out, "page_id").select("page_id", "n", F.size("ids").cast("long").alias("n_tiles"), F.array_join("ids", ",").alias("tiles"))


@_query("A10_premerge_union", "select page_id, det_id // 8 as target, count(*) as n_members, string_agg(distinct (det_id % 6)::varchar, ',' order by (det_id % 6)::varchar) as evidence, min(x1) as x1, max(y2) as y2 from fx_detections where class_id = 1 group by all", "fx_detections")
def _a10(det):
    d = det.where("class_id = 1").withColumn("target", F.floor(F.col("det_id") / 8)).withColumn("evidence_ids", F.array((F.col("det_id") % 6).cast("string")))
    return documents.merge_members(d).select("page_id", "target", "n_members", F.array_join("evidence_ids", ",").alias("evidence"), "x1", "y2")


@_query("A17_canonical_spikelets", "select det_id as spikelet_id, round((y1 + y2)/2*0.085, 6) as centroid_y, round(y2*0.085, 6) as top_y, round(0.3*det_id % 7, 6) as top_overlap from fx_detections where class_id = 1", "fx_detections")
def _a17(det):
    d = det.where("class_id = 1").withColumn("overlap", 0.3 * F.col("det_id") % 7)
    scored = d.select("*", F.lit(1).alias("k")).unionByName(d.select("*", F.lit(0).alias("k")).withColumn("overlap", F.lit(0.0)))
    return documents.canonical_spikelets(scored, 0.085).select("spikelet_id", _r("centroid_y").alias("centroid_y"), _r("top_y").alias("top_y"), _r("top_overlap").alias("top_overlap"))


@_query("A43_floor_percentile", "select page_id, list_sort(list(confidence))[floor(0.95*(count(*) - 1))::int + 1] as p95, max(confidence) as worst from fx_detections group by page_id", "fx_detections")
def _a43(det):
    return det.groupBy("page_id").agg(documents.floor_percentile(F.col("confidence"), 0.95).alias("p95"), F.max("confidence").alias("worst"))


@_query("C2_override_faults", "select name_id as key, concat_ws(',', case when name_id % 4 = 3 then 'allowed' end, case when name_id % 6 in (0, 1) then 'one_identity' end, case when name_id % 5 = 0 then 'not_empty' end) as faults from fx_names where name_id % 4 = 3 or name_id % 6 in (0, 1) or name_id % 5 = 0", "fx_names")
def _c2(names):
    k = F.col("name_id")
    d = names.select("name_id", F.when(k % 4 == 3, "colour").otherwise("accession").alias("field"), F.when(k % 6 != 1, F.lit("a")).alias("accession"), F.when(k % 6 == 0, F.lit(1)).alias("line_no"), F.lit(2).alias("strain_no"), F.when(k % 5 == 0, "").otherwise("v").alias("value"))
    return checks.rule_faults(d, "name_id", documents.override_rules(["accession", "line_no", "strain_no"])).select("key", F.array_join("faults", ",").alias("faults"))


@_query("C4_entity_class_faults", "select det_id as key, 'class' as faults from fx_detections where det_id % 11 = 0 and class_id = 0", "fx_detections")
def _c4(det):
    d = det.withColumn("kind", F.when(F.col("det_id") % 11 == 0, "spikelet").otherwise(F.col("class_name")))
    return checks.rule_faults(d, "det_id", documents.entity_rules()).select("key", F.array_join("faults", ",").alias("faults"))


@_query("C6_measurement_cover", "select det_id as key, case when det_id % 7 = 0 then 'missing' else 'repeated' end as fault from fx_detections where class_id = 1 and (det_id % 7 = 0 or det_id % 13 = 0)", "fx_detections")
def _c6(det):
    s = det.where("class_id = 1").select("det_id")
    rows = s.where("det_id % 7 <> 0")
    return checks.partition_faults(s, [rows, rows.where("det_id % 13 = 0")], "det_id")


@_query("C7_box_faults", "select det_id as key, concat_ws(',', case when det_id % 5 = 0 then 'ordered_box' end, case when det_id % 7 = 0 then 'confidence' end, case when det_id % 9 = 0 then 'class' end) as faults from fx_detections where det_id % 5 = 0 or det_id % 7 = 0 or det_id % 9 = 0", "fx_detections")
def _c7(det):
    k = F.col("det_id")
    d = det.withColumn("x1", F.when(k % 5 == 0, F.col("x2")).otherwise(F.col("x1"))).withColumn("confidence", F.when(k % 14 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(1.5)).otherwise(F.col("confidence"))).withColumn("class_name", F.when(k % 9 == 0, "leaf").otherwise(F.col("class_name")))
    return checks.rule_faults(d, "det_id", checks.box_rules()).select("key", F.array_join("faults", ",").alias("faults"))


@_query("C5_C9_page_and_group_faults", "select page_id as key, concat_ws(',', case when page_id % 5 = 0 then 'size' end, case when page_id % 7 = 0 then 'calibration' end) as faults from fx_source_pages where page_id % 5 = 0 or page_id % 7 = 0 union all select page_id + 1000000000, concat_ws(',', case when page_id % 4 = 0 then 'name' end, case when page_id % 6 = 0 then 'polygon' end, case when page_id % 10 = 0 then 'line' end) from fx_source_pages where page_id % 4 = 0 or page_id % 6 = 0 or page_id % 10 = 0", "fx_source_pages")
def _c5(pages):
    k = F.col("page_id")
    d = pages.withColumn("width", F.when(k % 5 == 0, 0).otherwise(F.col("width"))).withColumn("mm_per_px", F.when(k % 7 == 0, F.lit(10.0)).otherwise(F.col("mm_per_px")))
    p = lambda x, y: polyline.point(F.lit(float(x)), F.lit(float(y)))
    groups = pages.select((k + 1000000000).alias("uid"), "width", "height", F.when(k % 4 == 0, F.lit("  ")).otherwise(F.lit("awn")).alias("name"), F.when(k % 6 == 0, F.array(p(0, 0), p(1, 1))).otherwise(F.array(p(0, 0), p(9, 0), p(9, 9))).alias("polygon"),
                          F.when(k % 10 == 0, F.array(p(-1, 0), p(1, 1))).otherwise(F.array().cast(f"array<{polyline.POINT}>")).alias("line"))
    rules = checks.group_rules(F.col("width"), F.col("height"))
    both = checks.rule_faults(d, "page_id", checks.page_rules()).unionByName(checks.rule_faults(groups, "uid", rules))
    return both.select("key", F.array_join("faults", ",").alias("faults"))


@_query("C8_primitive_faults", "select det_id as key, 'shape' as faults from fx_detections where (det_id % 5 = 0 and det_id % 2 = 0) or (det_id % 5 = 1 and det_id % 3 = 0) or (det_id % 5 = 2 and det_id % 4 = 0) or (det_id % 5 = 3 and det_id % 7 = 0) or (det_id % 5 = 4 and det_id % 3 = 0)", "fx_detections")
def _c8(det):
    k, p = F.col("det_id"), polyline.point(F.col("x1"), F.col("y1"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("polygon", "polyline", "point", "connection", "label")]), (k % 5 + 1).cast("int"))
    n = F.when(k % 5 == 0, F.when(k % 2 == 0, 2).otherwise(3)).when(k % 5 == 1, F.when(k % 3 == 0, 1).otherwise(2)).when(k % 5 == 2, F.when(k % 4 == 0, 2).otherwise(1)).when(k % 5 == 3, 2).otherwise(1)
    same = F.when((k % 5 == 3) & (k % 7 == 0), F.lit("a")).otherwise(F.lit("b"))
    label = F.when((k % 5 == 4) & (k % 3 == 0), F.lit(" ")).otherwise(F.lit("text"))
    d = det.select("det_id", kind.alias("kind"), F.array_repeat(p, n).alias("points"), F.lit("a").alias("from_id"), same.alias("to_id"), label.alias("label"))
    return checks.rule_faults(d, "det_id", documents.primitive_rules()).select("key", F.array_join("faults", ",").alias("faults"))


@_query("P8_load_scale", "select page_id, mm_per_px as scale, case when mm_per_px is null then 'missing' else 'ok' end as state from fx_source_pages", "fx_source_pages")
def _p8(pages):
    return documents.load_scale(pages).select("page_id", "scale", "state")


@_query("P36_X15_provenance", """select det_id, 'prov_' || substr(sha256('{"namespace":"operation_provenance","payload":{"implementation":"v1","inputs":["a' || det_id % 10 || '","b"],"operation":"seed","output":"o' || det_id || '"}}'), 1, 20) as provenance_id from fx_detections where class_id = 1""", "fx_detections")
def _p36(det):
    d = det.where("class_id = 1").select("det_id", F.lit("seed").alias("operation"), F.lit("v1").alias("implementation"), F.array(F.lit("b"), F.concat(F.lit("a"), (F.col("det_id") % 10).cast("string"))).alias("inputs"), F.concat(F.lit("o"), F.col("det_id").cast("string")).alias("output"))
    return documents.with_provenance(d).select("det_id", "provenance_id")


@_query("P36_latest_metadata", "select page_id, tile_id, max(det_id) as det_id, arg_max(confidence, det_id) as confidence from fx_detections where confidence >= 0.1 group by all", "fx_detections")
def _p36b(det):
    d = det.withColumn("metadata", F.when(F.col("confidence") >= 0.1, F.col("confidence")))
    return documents.latest_metadata(d, ["page_id", "tile_id"], "det_id", "metadata").select("page_id", "tile_id", "det_id", F.col("metadata").alias("confidence"))


@_query("P37_json_faults", "select det_id as key, case when det_id % 3 = 0 then 'nan' else 'infinite' end as fault from fx_detections where det_id % 3 = 0 or det_id % 7 = 0", "fx_detections")
def _p37(det):
    k = F.col("det_id")
    d = det.withColumn("confidence", F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).otherwise(F.col("confidence")))
    return documents.json_faults(d, "det_id", ["x1", "confidence"])


@_query("P38_O4_rotated_boxes", "select det_id as uid, round(-(y1 + y2)/2, 6) as cx, round((x1 + x2)/2, 6) as cy, round(x2 - x1, 6) as height from fx_detections where class_id = 1", "fx_detections")
def _p38(det):
    ring = F.array(*[polyline.point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    d = documents.reading_boxes(det.where("class_id = 1").select(F.col("det_id").alias("uid"), ring.alias("polygon")), 90.0)
    return d.select("uid", _r("cx").alias("cx"), _r("cy").alias("cy"), _r("height").alias("height"))


@_query("P39_svg_paths", "select det_id, 'M' || x1::int || ' ' || y1::int || 'L' || x2::int || ' ' || y1::int || 'L' || x2::int || ' ' || y2::int || 'Z' as d, round(0.25 + 0.75*confidence, 6) as opacity from fx_detections", "fx_detections")
def _p39(det):
    ring = F.array(*[F.array(F.col(x).cast("int"), F.col(y).cast("int")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"))])
    return det.select("det_id", documents.svg_path(F.array(ring)).alias("d"), _r(documents.opacity(F.col("confidence"))).alias("opacity"))


@_query("P40_F15_normalised_groups", "select det_id as uid, 'Awn ' || row_number() over (partition by page_id order by det_id) as label, 'model' as origin, case when det_id % 5 = 0 then 'needs_review' when det_id % 3 = 0 then 'needs_review' else 'automatic' end as review from fx_detections where class_id = 1", "fx_detections")
def _p40(det):
    k = F.col("det_id")
    old = det.where("class_id = 1").select("page_id", k.alias("id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("origin"), F.when(k % 5 == 0, F.lit(True)).alias("needs_review"), (k % 3 == 0).alias("derived_review"))
    return documents.normalise_measurements(old).select(F.col("id").alias("uid"), "label", "origin", "review")


@_query("P41_settings", "select name_id, case when name_id % 4 = 0 then 0.25 when name_id % 4 = 1 then 0.0 when name_id % 4 = 2 then 1.0 else 0.5 end as confidence, case when name_id % 3 = 0 then 'dark' else 'system' end as theme from fx_names", "fx_names")
def _p41(names):
    k = F.col("name_id")
    d = names.select("name_id", F.when(k % 4 == 0, F.lit("abc")).when(k % 4 == 1, F.lit("-3")).when(k % 4 == 2, F.lit("7")).otherwise(F.lit("0.5")).alias("confidence"), F.when(k % 3 == 0, "dark").otherwise("neon").alias("theme"))
    return documents.normalise_settings(d, {"confidence": (0.25, 0.0, 1.0)}, {"theme": ("system", ["system", "light", "dark"])}).select("name_id", "confidence", "theme")


@_query("F10_claims_meet", "select a.hop as a, b.hop as b, a.spikelet_id from fx_steps a join fx_steps b on a.spikelet_id = b.spikelet_id and a.hop < b.hop where (a.hop % 3 <> 0 and b.hop % 3 <> 0) or (a.hop % 5 = 0 or b.hop % 5 = 0) or least(a.join_excess_turn_deg + 4, b.join_excess_turn_deg + 4) > greatest(a.join_excess_turn_deg, b.join_excess_turn_deg)", "fx_steps")
def _f10(steps):
    lo = F.col("join_excess_turn_deg")
    claim = F.struct(F.when(F.col("hop") % 5 != 0, lo).alias("lo"), F.when(F.col("hop") % 5 != 0, lo + 4).alias("hi"), (F.col("hop") % 3 == 0).alias("partial"))
    d = steps.select("spikelet_id", "hop", claim.alias("claim"))
    both = d.alias("l").join(d.alias("r"), (F.col("l.spikelet_id") == F.col("r.spikelet_id")) & (F.col("l.hop") < F.col("r.hop")))
    return both.where(documents.claims_meet(F.col("l.claim"), F.col("r.claim"))).select(F.col("l.hop").alias("a"), F.col("r.hop").alias("b"), F.col("l.spikelet_id").alias("spikelet_id"))


@_query("F17_review_filter", "select name_id from fx_names where name_id % 3 = 0 and length_mm is not null and contains(lower(name), 'a')", "fx_names")
def _f17(names):
    d = names.withColumn("status", F.when(F.col("name_id") % 3 == 0, "needs_review").otherwise("automatic"))
    return d.where(documents.review_filter(F.col("status"), F.col("length_mm"), F.col("name"), "review", measured=True, search="A")).select("name_id")


@_query("J28_hydrated_pages", "select page_id, 'img' || page_id as src, case when page_id % 2 = 0 then 'triage' || page_id end as review, case when page_id % 3 = 0 then 'i' || page_id end as inference from fx_source_pages", "fx_source_pages")
def _j28(pages):
    part = lambda where, prefix, name: pages.where(where).select("page_id", F.concat(F.lit(prefix), F.col("page_id").cast("string")).alias(name))
    return documents.hydrate(pages.select("page_id"), [part("true", "img", "src"), part("page_id % 2 = 0", "triage", "review"), part("page_id % 3 = 0", "i", "inference")])


@_query("X3_overlap_of_smaller", "select a.det_id as a, b.det_id as b, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))*greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))/least((a.x2 - a.x1)*(a.y2 - a.y1), (b.x2 - b.x1)*(b.y2 - b.y1)), 6) as share from fx_detections a join fx_detections b on a.page_id = b.page_id and a.class_id = 1 and b.class_id = 1 and a.det_id < b.det_id and a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2", "fx_detections")
def _x3(det):
    from ..functions.boxes import Box, overlap_min
    from ..operators.spatial import box_self_join

    near = box_self_join(det.where("class_id = 1").select("page_id", "det_id", "x1", "y1", "x2", "y2"), 0.0, ["page_id"], "det_id")
    a, b = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")
    return near.select(F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b"), _r(overlap_min(a, b)).alias("share"))


@_query("P23_bidirectional_overlap", "select a.det_id as a, b.det_id as b, round(i/aa, 6) as of_a, round(i/ba, 6) as of_b, round(least(i/aa, i/ba), 6) as least from (select a.*, (a.x2 - a.x1)*(a.y2 - a.y1) as aa from fx_detections a) a join (select b.*, (b.x2 - b.x1)*(b.y2 - b.y1) as ba from fx_detections b) b on a.page_id = b.page_id and a.class_id = b.class_id and a.det_id + 1 = b.det_id cross join lateral (select greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))*greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i) z where a.det_id % 2 = 0", "fx_detections")
def _p23(det):
    from ..functions.boxes import Box, fractions

    d = det.select("page_id", "class_id", "det_id", "x1", "y1", "x2", "y2")
    both = d.where("det_id % 2 = 0").alias("l").join(d.alias("r"), (F.col("l.page_id") == F.col("r.page_id")) & (F.col("l.class_id") == F.col("r.class_id")) & (F.col("l.det_id") + 1 == F.col("r.det_id")))
    a, b = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")
    one, two = fractions(a, b)
    return both.select(F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b"), _r(one).alias("of_a"), _r(two).alias("of_b"), _r(F.least(one, two)).alias("least"))


@_query("X10_layer_faults", "select det_id as key, concat_ws(',', case when det_id % 6 = 0 then 'opacity' end, case when det_id % 5 = 0 then 'visible' end, case when det_id % 4 = 0 then 'layer_id' end) as faults from fx_detections where det_id % 6 = 0 or det_id % 5 = 0 or det_id % 4 = 0", "fx_detections")
def _x10(det):
    k = F.col("det_id")
    d = det.select("det_id", F.when(k % 6 == 0, 1.25).otherwise(0.5).alias("opacity"), F.when(k % 5 != 0, F.lit(True)).alias("visible"), F.when(k % 4 == 0, "").otherwise("awns").alias("layer_id"))
    return checks.rule_faults(d, "det_id", documents.layer_rules()).select("key", F.array_join("faults", ",").alias("faults"))


@_query("X11_config_faults", "select name_id as key, concat_ws(',', case when name_id % 2 = 1 then 'confidence' end, case when name_id % 3 = 1 then 'nms' end) as faults from fx_names where name_id % 2 = 1 or name_id % 3 = 1", "fx_names")
def _x11(names):
    k = F.col("name_id")
    d = names.select("name_id", F.when(k % 2 == 1, 0.3).otherwise(0.25).alias("confidence"), F.when(k % 3 == 1, 0.5).otherwise(0.7).alias("nms"))
    return checks.rule_faults(d, "name_id", documents.frozen_config_rules()).select("key", F.array_join("faults", ",").alias("faults"))


@_query("X13_premerge_rank", "select page_id, det_id, cast(row_number() over (partition by page_id order by class_id, det_id % 4 desc, (x2 - x1)*(y2 - y1) desc, det_id) as int) as place from fx_detections", "fx_detections")
def _x13(det):
    d = det.select("page_id", F.col("det_id"), (F.col("class_id") == 0).alias("stable"), (F.col("det_id") % 4).alias("n_evidence"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    return documents.anchor_ranks(d).select("page_id", "det_id", "place")


@_query("X17_polygon_parts", "select det_id as id, case when det_id % 3 = 0 then 1 else 2 end::int as n_all, case when det_id % 3 = 0 then 0 else 1 end::int as n_floor from fx_detections", "fx_detections")
def _x17(det):
    part = lambda kind, area: F.struct(kind.alias("kind"), area.alias("area"))
    first = part(F.lit("Polygon"), F.when(F.col("det_id") % 3 == 0, F.lit(0.0)).otherwise(F.lit(4.0)))
    parts = F.when(F.col("det_id") % 3 == 0, F.array(first, part(F.lit("LineString"), F.lit(0.0)))).otherwise(F.array(first, part(F.lit("Polygon"), F.lit(1e-10))))
    return det.select(F.col("det_id").alias("id"), F.size(documents.polygon_parts(parts)).alias("n_all"), F.size(documents.polygon_parts(parts, 1e-9)).alias("n_floor"))


@_query("X19_policy_summary", "select 'core' as policy, 1 as n union all select 'studio', 1", "fx_names")
def _x19(names):
    d = documents.policy_summary(names.sparkSession)
    return d.groupBy("policy").agg((F.countDistinct("policy")).cast("int").alias("n"))


@_query("X20_result_predicates", "select result_id, true as is_result, coalesce(case when result_id % 3 = 0 then model_id when result_id % 3 = 1 then 'inf' end, 'controlled-v2-stage1') as model from fx_results", "fx_results")
def _x20(results):
    k = F.col("result_id")
    d = results.select("result_id", F.lit("result").alias("page_kind"), "source_page_id", F.when(k % 3 == 0, F.col("model_id")).alias("model_id"), F.when(k % 3 == 1, "inf").alias("inference_model"))
    return d.select("result_id", documents.is_result_page(F.col("page_kind"), F.col("source_page_id")).alias("is_result"), documents.result_model(F.col("model_id"), F.col("inference_model")).alias("model"))


@_query("X21_lookups", "select page_id, max(confidence) as best, sum(case when class_id = 1 then 1 else 0 end)::bigint as n_auto, min(case when class_id = 1 then det_id end) as first_record from fx_detections group by page_id", "fx_detections")
def _x21(det):
    auto = documents.automatic_lengths(det.where("class_id = 1").select("page_id", F.col("det_id").alias("uid"), F.col("confidence").alias("length_mm")))
    d = det.groupBy("page_id").agg(F.max("confidence").alias("best"))
    return d.join(auto, "page_id", "left").select("page_id", "best", F.size("lengths").cast("long").alias("n_auto"), F.array_min(F.map_keys("lengths")).alias("first_record"))


@_query("X23_migrated_paths", "select det_id, case when det_id % 4 = 0 then 3 when det_id % 4 = 1 then 3 else 2 end::int as points from fx_detections", "fx_detections")
def _x23(det):
    k, p = F.col("det_id"), lambda x, y: polyline.point(F.lit(float(x)), F.lit(float(y)))
    d = det.select("det_id", F.array(p(0, 0), p(1, 0), p(2, 0)).alias("line"), F.when(k % 4 == 0, "manual").otherwise("automatic").alias("origin"), (k % 4 == 1).alias("modified"))
    return documents.migrate_paths(d).select("det_id", F.size("line").alias("points"))


@_query("X24_served_observations", "select det_id, row_number() over (partition by page_id order by det_id) - 1 as place from fx_detections where confidence >= 0.5", "fx_detections")
def _x24(det):
    return documents.served(det.where("confidence >= 0.5"), "det_id").select("det_id", F.col("place").cast("long").alias("place"))


@_query("O10_sorted_output", "select page_id, string_agg(det_id::varchar, ',' order by class_name, confidence desc, det_id) as ids from fx_detections group by page_id", "fx_detections")
def _o10(det):
    row = F.struct("class_name", (-F.col("confidence")).alias("c"), "det_id")
    d = det.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return d.select("page_id", F.array_join(F.transform("rows", lambda r: r["det_id"].cast("string")), ",").alias("ids"))


@_query("P6_axis_angles", "select det_id, round(degrees(acos(least(1, abs((y2 - y1)/sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)))))), 6) as undirected, round(degrees(acos((y1 - y2)/sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)))), 6) as directed from fx_detections", "fx_detections")
def _p6(det):
    from ..functions import angles

    dx, dy, zero = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(0.0)
    dx, dy = dx / F.hypot(dx, dy), dy / F.hypot(dx, dy)
    return det.select("det_id", _r(angles.axis_angle(dx, dy, zero, F.lit(-1.0))).alias("undirected"), _r(angles.axis_angle(dx, dy, zero, F.lit(-1.0), True)).alias("directed"))


@_query("P34_P45_connector_and_suffix", "select det_id, round((x1 + x2)/2, 6) as mid_x, round(y1 + (y2 - y1)*0.75, 6) as late_y, 8 as joined from fx_detections", "fx_detections")
def _p34(det):
    c = F.col
    d = det.select("det_id", polyline.connector(c("x1"), c("y1"), c("x2"), c("y2"), 4).alias("path"))
    joined = polyline.append_suffix(c("path"), c("path"), F.lit(1))
    return d.select("det_id", _r(F.get("path", F.lit(2))["x"]).alias("mid_x"), _r(F.get("path", F.lit(3))["y"]).alias("late_y"), F.size(joined).alias("joined"))


@_query("K7_text_guards", "select name_id, case when regexp_matches(name, '^\\s*[=+@-]') then '''' || name else name end as guarded from fx_names", "fx_names")
def _guards(names):
    return names.select("name_id", text.guard(F.col("name")).alias("guarded"))
