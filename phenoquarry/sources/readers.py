"""Readers and writers of page documents: evidence snapshots, stage results, project files, registries and CSV exports."""

from __future__ import annotations

import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, polyline, text

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
RINGS = "array<array<array<double>>>"
OBSERVATION = f"evidence_id string, class_id int, class_name string, confidence double, provider string, source_tile_id string, source_prediction_index int, source_component_index int, tile {BOX}, box {BOX}, rings {RINGS}"
SNAPSHOT = f"schema string, page_id string, snapshot_id string, source_sha256 string, evidence array<struct<{OBSERVATION.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' struct', ':struct').replace(' array', ':array')}>>"
SNAPSHOT_SCHEMA = "evidence-snapshot-v1"


class FormatError(ValueError):
    pass


def _refuse(found: DataFrame, what: str) -> None:
    """Raise with a few examples if the table of faults isn't empty."""
    rows = found.limit(5).collect()
    if rows:
        raise FormatError(f"{what}: {rows}")


def snapshot_id(evidence: Column) -> Column:
    """Over the sorted evidence ids, so order doesn't matter."""
    ids = F.array_sort(F.transform(evidence, lambda e: e["evidence_id"]))
    return F.concat(F.lit("snap_"), F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, identity.DIGITS))


def write_snapshots(evidence: DataFrame, path: str) -> None:
    """One JSON document for each page (page_id, source_sha256 and the observation columns); refuses an existing path."""
    names = [c.split(" ")[0] for c in OBSERVATION.split(", ")]
    d = evidence.groupBy("page_id", "source_sha256").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("evidence"))
    d = d.select(F.lit(SNAPSHOT_SCHEMA).alias("schema"), "page_id", snapshot_id(F.col("evidence")).alias("snapshot_id"), "source_sha256", "evidence")
    d.write.mode("errorifexists").json(path)


def read_snapshots(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Observations with page_id and snapshot_id; in strict mode schema, snapshot ids and evidence ids are recomputed and compared."""
    d = spark.read.schema(SNAPSHOT).json(path)
    if strict:
        wrong = F.coalesce(F.col("schema") != SNAPSHOT_SCHEMA, F.lit(True)) | F.coalesce(F.col("snapshot_id") != snapshot_id(F.col("evidence")), F.lit(True))
        _refuse(d.where(wrong).select("page_id", "schema", "snapshot_id"), "snapshots that don't match their content")
    out = d.select("page_id", "snapshot_id", "source_sha256", F.explode("evidence").alias("e")).select("page_id", "snapshot_id", "source_sha256", "e.*")
    if strict:
        own = identity.evidence_id(*[F.col(c) for c in ("page_id", "class_name", "provider", "source_tile_id", "source_prediction_index", "source_component_index")])
        _refuse(out.where(own != F.col("evidence_id")).select("page_id", "evidence_id"), "evidence ids that don't match their content")
    return out


def write_stage(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A stage's result, by page; refuses an existing path."""
    df.write.mode("errorifexists").partitionBy("page_id").format(form).save(path)


def read_stage(spark: SparkSession, path: str, schema: str, required: list[str], form: str = "json") -> DataFrame:
    """A stage's result with its schema given, not inferred; rows without a required value are an error."""
    d = spark.read.schema(schema).format(form).load(path)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    _refuse(d.select("*", missing.alias("missing")).where(F.size("missing") > 0), "rows without required values")
    return d


def scan_tiles(predictions: DataFrame, least_confidence: float) -> DataFrame:
    """Predictions of any model over tiles (page_id, tile: struct, confidence, class_id, x1..y2 within the tile) as observations.

    Weak ones and those of unknown classes or empty boxes go; coordinates become the page's; `source_prediction_index` is
    the place of a prediction among its tile's, counted before anything goes.
    """
    c = F.col
    d = predictions.where((c("confidence") >= least_confidence) & c("class_id").isin(0, 1) & (c("x2") > c("x1")) & (c("y2") > c("y1")))
    moved = [(c(k) + c(f"tile.{k[0]}1")).alias(k) for k in ("x1", "y1", "x2", "y2")]
    name = F.when(c("class_id") == 1, "spikelet").otherwise("awn").alias("class_name")
    return d.select("page_id", "tile_id", "source_prediction_index", "class_id", name, "confidence", *moved)


def adapter_boxes(outputs: DataFrame, labels: dict[int, int], least_score: float, mask_threshold: float | None = None) -> DataFrame:
    """Raw outputs (prediction_id, label, score, pixels: array of (x, y, p), and x1..y2 or nulls) as predictions.

    Labels are mapped, unknown ones and scores under the least go. With a mask threshold the mask is the pixels at or over
    it; a prediction without a box gets that of its mask (upper ends one further), and one without either goes.
    """
    pixels = F.col("pixels") if mask_threshold is None else F.filter("pixels", lambda q: q["p"] >= mask_threshold)
    mapped = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    d = outputs.select("*", F.try_element_at(mapped, F.col("label")).alias("class_id"), pixels.alias("held"))
    d = d.where(F.col("class_id").isNotNull() & (F.col("score") >= least_score))
    side = lambda pick, axis, more: pick(F.transform("held", lambda q: q[axis])) + more
    boxes = {"x1": side(F.array_min, "x", 0), "y1": side(F.array_min, "y", 0), "x2": side(F.array_max, "x", 1), "y2": side(F.array_max, "y", 1)}
    d = d.select("prediction_id", "class_id", "score", *[F.coalesce(F.col(k), v).cast("double").alias(k) for k, v in boxes.items()], F.size("held").alias("mask_px"))
    return d.where("x1 is not null")


def rings_of(records: DataFrame) -> DataFrame:
    """Rows (id, rings: array of arrays of points) with the rings that enclose an area: three different points or more, not on a line."""
    twice = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda a, i: a + F.get(r, i)["x"] * F.get(r, (i + 1) % F.size(r))["y"] - F.get(r, (i + 1) % F.size(r))["x"] * F.get(r, i)["y"])
    good = F.filter("rings", lambda r: F.when(F.size(r) >= 3, F.abs(twice(r)) > 1e-9).otherwise(False))
    return records.withColumn("rings", good).where(F.size("rings") > 0)


def verified_files(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """path, sha256, and state of files against pinned digests (path, sha256): verified, changed or unknown."""
    d = files.join(pinned.select("path", F.col("sha256").alias("pin")), "path", "left")
    state = F.when(F.col("pin").isNull(), "unknown").when(F.col("pin") == F.col("sha256"), "verified").otherwise("changed")
    return d.select("path", "sha256", state.alias("state"))


def closeout(representatives: DataFrame, spikelets: DataFrame) -> dict[str, DataFrame]:
    """A run's last documents by page: representatives, diagnostics, summary, and the manifest with their digests.

    representatives: page_id, spikelet_id, length_mm, status. Spikelets (page_id, spikelet_id) without one are diagnosed.
    """
    kept = representatives.select("page_id", "spikelet_id", "length_mm", "status")
    lost = spikelets.join(kept, ["page_id", "spikelet_id"], "left_anti").select("page_id", "spikelet_id", F.lit("no_representative").alias("diagnosis"))
    odd = kept.where("status <> 'ok'").select("page_id", "spikelet_id", F.col("status").alias("diagnosis"))
    diagnostics = lost.unionByName(odd)
    per = spikelets.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_spikelets"))
    mine = kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_representatives"), F.sum("length_mm").alias("length_mm"))
    bad = diagnostics.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_diagnostics"))
    zero = F.lit(0).cast("long")
    summary = per.join(mine, "page_id", "left").join(bad, "page_id", "left").select("page_id", "n_spikelets", F.coalesce("n_representatives", zero).alias("n_representatives"), F.coalesce("n_diagnostics", zero).alias("n_diagnostics"), F.coalesce("length_mm", F.lit(0.0)).alias("length_mm"))
    line = F.concat_ws("|", "spikelet_id", "status")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)
    manifest = kept.groupBy("page_id").agg(digest.alias("representatives_sha256"))
    return {"representatives": kept, "diagnostics": diagnostics, "summary": summary, "manifest": manifest}


def page_payload(config: dict, predictions: DataFrame, merges: DataFrame) -> DataFrame:
    """page_id and payload: a page's predictions, their counts by class, merge records and the run's settings as JSON."""
    p = predictions.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_name") == "awn").alias("n_awn"), F.array_sort(F.collect_list(F.struct("det_id", "class_name", "confidence"))).alias("predictions"))
    m = merges.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("merged"))
    d = p.join(m, "page_id", "left").withColumn("merged", F.coalesce("merged", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    counts = F.struct("n", "n_awn", (F.col("n") - F.col("n_awn")).alias("n_spikelet"), F.size("merged").alias("n_merged"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())])
    return d.select("page_id", F.to_json(F.struct(settings.alias("config"), counts.alias("counts"), "predictions", "merged"), {"ignoreNullFields": "false"}).alias("payload"))


def html_report(rows: DataFrame, title: str) -> DataFrame:
    """page_id and html: a table of rows (page_id, ordinal, cells: array of strings), escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda x: F.concat(F.lit("<td>"), safe(x), F.lit("</td>"))), ""), F.lit("</tr>"))
    d = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return d.select("page_id", F.concat(F.lit(f"<h1>{title}</h1><table>"), body, F.lit("</table>")).alias("html"))


def adapt_predictions(records: DataFrame) -> DataFrame:
    """Rows (page_id, predictions: array of structs with confidence and rings) to observations that keep the record's own index.

    Records without a ring of three points are left out after numbering, so indexes don't move.
    """
    d = records.select("page_id", F.posexplode("predictions").alias("source_prediction_index", "p"))
    return d.where(F.exists("p.rings", lambda r: F.size(r) >= 3)).select("page_id", "source_prediction_index", "p.*")


def rejected_ids(manifest: DataFrame) -> DataFrame:
    """detection_id of the rows decided `reject`; other decisions and repeated ids are errors."""
    _refuse(manifest.where(~F.col("decision").eqNullSafe(F.lit("reject"))), "decisions other than reject")
    _refuse(manifest.groupBy("detection_id").count().where("count > 1"), "repeated detection ids")
    return manifest.select("detection_id")


def forced_attachments(spark: SparkSession, path: str) -> DataFrame:
    """page_id, fragment_id, target_id; a missing file means no rows."""
    schema = "page_id string, fragment_id string, target_id string"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


# Projects ----------------------------------------------------------------------------------------------------------------


def encode_project(pages: DataFrame) -> DataFrame:
    """Pages that have a source give up their own image."""
    return pages.withColumn("src", F.when(F.col("source_page_id").isNull(), F.col("src")))


def decode_project(stored: DataFrame) -> DataFrame:
    """The image of a source back on its results; a missing source, or one of another size, is an error."""
    s = stored.where("source_page_id is null").select(F.col("page_id").alias("source_page_id"), F.col("src").alias("s_src"), F.col("width").alias("s_w"), F.col("height").alias("s_h"), F.lit(True).alias("found"))
    d = stored.join(s, "source_page_id", "left")
    bad = F.col("source_page_id").isNotNull() & (F.col("found").isNull() | (F.col("s_w") != F.col("width")) | (F.col("s_h") != F.col("height")))
    _refuse(d.where(bad).select("page_id", "source_page_id"), "results without a source of their size")
    return d.select(*[F.coalesce("src", "s_src").alias("src") if c == "src" else c for c in stored.columns])


def apply_patches(manifest: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """The last patch of a page (page_id, version, columns) replaces its columns, also by null: presence counts, not value."""
    last = patches.groupBy("page_id").agg(F.max_by(F.struct(*columns), "version").alias("patch"), F.lit(True).alias("patched"))
    d = manifest.join(last, "page_id", "left")
    return d.select(*[F.when(F.col("patched"), F.col(f"patch.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in manifest.columns])


def split_project(pages: DataFrame) -> dict[str, DataFrame]:
    """Vertical parts: the light manifest, and the heavy inference and image columns by page."""
    return {
        "manifest": pages.drop("inference", "src"),
        "inference": pages.where("inference is not null").select("page_id", "inference"),
        "assets": pages.where("src is not null").select(F.sha2("src", 256).alias("asset_id"), "src").dropDuplicates(["asset_id"]),
    }


def unreferenced(stored: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Stored parts that no page refers to any more."""
    return stored.join(pages.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merge_registries(official: DataFrame, custom: DataFrame, adapters: list[str]) -> DataFrame:
    """Models by id: rows without an id or a known adapter are passed over, the official one wins a clash."""
    d = official.withColumn("rank", F.lit(0)).unionByName(custom.withColumn("rank", F.lit(1)))
    d = d.where(F.col("model_id").isNotNull() & F.col("adapter").isin(adapters))
    best = d.groupBy("model_id").agg(F.min_by(F.struct(*official.columns), "rank").alias("m"))
    return best.select("m.*")


def import_images(files: DataFrame) -> DataFrame:
    """Image files (name, mime) in natural order of names, with their position from 1."""
    from pyspark.sql import Window

    d = files.where(F.col("mime").isin("image/png", "image/jpeg", "image/webp"))
    return d.withColumn("position", F.row_number().over(Window.orderBy(identity.natural_key(F.col("name")), "name")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# CSV -----------------------------------------------------------------------------------------------------------------------

SIMPLE_HEADER = "ID,Awn length (mm)"
DETAILED_HEADER = ["Source image", "ID", "Automatic awn length (mm)", "Final awn length (mm)", "Review status", "Review reasons", "Modified", "Confirmed", "Model", "Pipeline"]


def simple_csv(groups: DataFrame) -> DataFrame:
    """page_id and csv from rows (page_id, ordinal, name, length_mm): a byte order mark, CRLF, quoted and guarded ids."""
    line = F.concat(text.quote(F.col("name")), F.lit(","), text.fixed3(F.col("length_mm")))
    d = groups.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n")
    return d.select("page_id", F.concat(F.lit(text.BOM + SIMPLE_HEADER + "\r\n"), body).alias("csv"))


def detailed_lines(groups: DataFrame) -> DataFrame:
    """A CSV line for each row (source_name, name, automatic_mm, final_mm, status, reasons, modified, confirmed, model, pipeline)."""
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")
    c = F.col
    cells = [c("source_name"), c("name"), text.fixed3(c("automatic_mm")), text.fixed3(c("final_mm")), c("status"), F.array_join("reasons", "; "), flag(c("modified")), flag(c("confirmed")), c("model"), c("pipeline")]
    return groups.withColumn("line", F.concat_ws(",", *[text.quote(x) for x in cells]))


def detailed_header() -> str:
    return text.BOM + ",".join(f'"{h}"' for h in DETAILED_HEADER)


def zip_pages(pages: DataFrame, path: str, most: int = 10_000) -> int:
    """An archive of the pages' CSV texts (ordinal, name, csv), one member each: for the pages that a person exports at once.

    It is written where the driver runs, so more pages than `most` are refused.
    """
    if pages.limit(most + 1).count() > most:
        raise ValueError(f"an export holds at most {most} pages")
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for row in pages.orderBy("ordinal").toLocalIterator():
            n += 1
            z.writestr(f"{n}_{row.name}.csv", row.csv)
    return n


def product_groups(representatives: DataFrame, spikelets: DataFrame) -> DataFrame:
    """Spikelets with the line of their last representative (by ordinal); without one the line is empty."""
    last = representatives.groupBy("page_id", "spikelet_id").agg(F.max_by("line", "ordinal").alias("line"))
    none = F.array().cast(f"array<{polyline.POINT}>")
    return spikelets.join(last, ["page_id", "spikelet_id"], "left").withColumn("line", F.coalesce("line", none))


def result_documents(groups: DataFrame) -> DataFrame:
    """page_id and document: the page's measurements as JSON, nulls kept."""
    fields = [c for c in groups.columns if c != "page_id"]
    d = groups.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("measurements"))
    return d.select("page_id", F.to_json(F.struct(F.lit(2).alias("version"), "measurements"), {"ignoreNullFields": "false"}).alias("document"))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """Job rows without what only the server needs; a result only once the job is done."""
    hidden = [c for c in ("preview", "result_file") if c in jobs.columns]
    d = jobs.drop(*hidden)
    return d.withColumn("result", F.when(F.col("state") == "done", F.col("result"))) if "result" in d.columns else d
