"""Rules and projections over documents: entities, provenance, product results, settings, review and storage helpers."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..policy import CORE, STUDIO
from .workflow import DEFAULT_MODEL


def all_hypotheses(spikelets: DataFrame, awns: DataFrame) -> DataFrame:
    """Hypotheses of both classes, all of them."""
    return spikelets.unionByName(awns)


def distinct_union(df: DataFrame, key: str, ids: str) -> DataFrame:
    """key and the sorted distinct elements of its rows' arrays."""
    each = df.select(key, F.explode(ids).alias("one"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("one")).alias(ids))


def merge_members(members: DataFrame) -> DataFrame:
    """Members (page_id, target, evidence_ids, x1..y2) as one row for each target: their number, evidence and bounds."""
    ids = distinct_union(members.select(F.struct("page_id", "target").alias("k"), "evidence_ids"), "k", "evidence_ids")
    box = members.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n_members"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return box.join(ids.select("k.page_id", "k.target", "evidence_ids"), ["page_id", "target"])


def canonical_spikelets(spikelets: DataFrame, mm_per_px: float) -> DataFrame:
    """spikelet_id, page_id, and in mm the height of the box's middle, its lowest edge, and the largest overlap of its rows."""
    mm = F.lit(mm_per_px)
    d = spikelets.groupBy("page_id", F.col("det_id").alias("spikelet_id")).agg(F.first("y1").alias("y1"), F.first("y2").alias("y2"), F.max("overlap").alias("top_overlap"))
    return d.select("page_id", "spikelet_id", ((F.col("y1") + F.col("y2")) / 2 * mm).alias("centroid_y"), (F.col("y2") * mm).alias("top_y"), "top_overlap")


def floor_percentile(c: Column, share: float) -> Column:
    """The value at the floor of share * (n - 1) in ascending order: never between two values."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, F.floor(share * (F.size(values) - 1)).cast("int") + 1)


def override_rules(allowed: list[str]) -> dict[str, Column]:
    """Overrides name an allowed field, carry a value, and identify by an accession or by line and strain, not both."""
    c = F.col
    numbers = c("line_no").isNotNull() & c("strain_no").isNotNull()
    return {"allowed": c("field").isin(allowed), "one_identity": c("accession").isNotNull() != numbers, "not_empty": F.length(F.trim("value")) > 0}


def entity_rules() -> dict[str, Column]:
    """A physical entity is of its detection's class."""
    return {"class": F.col("kind") == F.col("class_name")}


def primitive_rules() -> dict[str, Column]:
    """Inspector primitives: points by kind, two ends of a connection, text of a label."""
    c, n = F.col, F.size("points")
    fits = F.when(c("kind") == "polygon", n >= 3).when(c("kind") == "polyline", n >= 2).when(c("kind") == "point", n == 1)
    fits = fits.when(c("kind") == "connection", (n == 2) & (c("from_id") != c("to_id"))).when(c("kind") == "label", (n == 1) & (F.length(F.trim("label")) > 0))
    return {"shape": fits}


def layer_rules() -> dict[str, Column]:
    c = F.col
    return {"opacity": c("opacity").between(0, 1), "visible": c("visible").isNotNull(), "layer_id": F.length("layer_id") > 0}


def frozen_config_rules() -> dict[str, Column]:
    """The frozen page run takes one confidence and one overlap, and refuses any other."""
    return {"confidence": F.col("confidence") == 0.25, "nms": F.col("nms") == 0.7}


def load_scale(pages: DataFrame) -> DataFrame:
    """page_id, scale and state: ok, missing (null) or not_positive."""
    c = F.col("mm_per_px")
    return pages.select("page_id", F.when(c > 0, c).alias("scale"), F.when(c.isNull(), "missing").when(c > 0, "ok").otherwise("not_positive").alias("state"))


def with_provenance(operations: DataFrame) -> DataFrame:
    """Operations (operation, implementation, inputs, output) with provenance_id, which the order of inputs doesn't change."""
    payload = F.struct("implementation", F.array_sort("inputs").alias("inputs"), "operation", "output")
    return operations.withColumn("provenance_id", F.concat(F.lit("prov_"), identity.digest("operation_provenance", payload)))


def latest_metadata(records: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last record of each key that has a value, with it."""
    best = F.max_by(F.struct(order, value), F.col(order))
    return records.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("r")).select(*keys, f"r.{order}", f"r.{value}")


def json_faults(df: DataFrame, key: str, numbers: list[str]) -> DataFrame:
    """key and fault (nan or infinite) of rows with numbers that JSON doesn't have."""
    nan = reduce(lambda a, b: a | b, (F.isnan(F.col(c)) for c in numbers))
    inf = reduce(lambda a, b: a | b, (F.abs(F.col(c)) == float("inf") for c in numbers))
    fault = F.when(F.coalesce(nan, F.lit(False)), "nan").when(F.coalesce(inf, F.lit(False)), "infinite")
    return df.select(F.col(key).alias("key"), fault.alias("fault")).where("fault is not null")


def reading_boxes(groups: DataFrame, rotation_deg: float) -> DataFrame:
    """uid, middle and height of the bounds of a polygon that is turned by an angle."""
    a = F.radians(F.lit(rotation_deg))
    xs = F.transform("polygon", lambda p: p["x"] * F.cos(a) - p["y"] * F.sin(a))
    ys = F.transform("polygon", lambda p: p["x"] * F.sin(a) + p["y"] * F.cos(a))
    d = groups.select("uid", xs.alias("xs"), ys.alias("ys"))
    middle = lambda c: (F.array_min(c) + F.array_max(c)) / 2
    return d.select("uid", middle("xs").alias("cx"), middle("ys").alias("cy"), (F.array_max("ys") - F.array_min("ys")).alias("height"))


def svg_path(rings: Column) -> Column:
    """Rings (arrays of x, y pairs) as the text of an SVG path."""
    place = lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))
    one = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, place), "L"), F.lit("Z"))
    return F.array_join(F.transform(rings, one), "")


def opacity(confidence: Column) -> Column:
    """From a quarter to whole by confidence, which counts as 0 where it is missing."""
    return 0.25 + 0.75 * F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def normalise_measurements(rows: DataFrame) -> DataFrame:
    """Measurements of any version with today's defaults: label by place on the page, origin model, review as given, else as derived."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("id"))
    review = F.when(F.coalesce("needs_review", "derived_review", F.lit(False)), "needs_review").otherwise("automatic")
    return rows.select("page_id", "id", F.coalesce("label", F.concat(F.lit("Awn "), place.cast("string"))).alias("label"), F.coalesce("origin", F.lit("model")).alias("origin"), review.alias("review"))


def normalise_settings(rows: DataFrame, numbers: dict[str, tuple[float, float, float]], choices: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Numbers (default, least, most) are parsed and clipped, choices (default, known) fall back to their default."""
    out = rows
    for name, (default, least, most) in numbers.items():
        value = F.coalesce(F.col(name).try_cast("double"), F.lit(default))
        out = out.withColumn(name, F.least(F.greatest(value, F.lit(least)), F.lit(most)))
    for name, (fallback, known) in choices.items():
        out = out.withColumn(name, F.when(F.col(name).isin(known), F.col(name)).otherwise(fallback))
    return out


def claims_meet(a: Column, b: Column) -> Column:
    """Claims (lo, hi, partial): whole ones always meet, so do those without an interval; else their open intervals must."""
    whole = ~(a["partial"] | b["partial"])
    open_ = a["lo"].isNull() | a["hi"].isNull() | b["lo"].isNull() | b["hi"].isNull()
    return whole | open_ | (F.least(a["hi"], b["hi"]) > F.greatest(a["lo"], b["lo"]))


def review_filter(status: Column, length: Column, name: Column, show: str, measured: bool = False, search: str = "") -> Column:
    """What a review list shows: all, those to review or those confirmed; measured ones only if asked; names that hold a text."""
    want = {"all": F.lit(True), "review": status == "needs_review", "confirmed": status == "confirmed"}[show]
    want = want & length.isNotNull() if measured else want
    return want & F.contains(F.lower(name), F.lit(search.lower())) if search else want


def hydrate(pages: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Pages with the parts that are stored apart (each by page_id); what a page doesn't have is null."""
    return reduce(lambda d, part: d.join(part, "page_id", "left"), parts, pages)


def anchor_ranks(rows: DataFrame) -> DataFrame:
    """place (from 1) on the page: stable ones first, then by evidence, area and id."""
    w = Window.partitionBy("page_id").orderBy(F.desc("stable"), F.desc("n_evidence"), F.desc("area"), "det_id")
    return rows.withColumn("place", F.row_number().over(w))


def polygon_parts(parts: Column, least_area: float | None = None) -> Column:
    """The polygons among a geometry's parts (kind, area); with a floor only those of more area."""
    return F.filter(parts, lambda p: (p["kind"] == "Polygon") & (F.lit(True) if least_area is None else p["area"] > least_area))


def policy_summary(spark: SparkSession) -> DataFrame:
    """policy, name and value (text) of every threshold."""
    rows = [(k, n, str(v)) for k, p in (("core", CORE), ("studio", STUDIO)) for n, v in asdict(p).items()]
    return spark.createDataFrame(rows, "policy string, name string, value string")


def is_result_page(kind: Column, source: Column) -> Column:
    return (kind == "result") & source.isNotNull()


def result_model(model: Column, inference_model: Column) -> Column:
    return F.coalesce(model, inference_model, F.lit(DEFAULT_MODEL))


def automatic_lengths(rows: DataFrame) -> DataFrame:
    """page_id and lengths: map from uid to the automatic length."""
    return rows.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("uid", "length_mm")))).alias("lengths"))


def migrate_paths(rows: DataFrame) -> DataFrame:
    """Automatic lines that nobody changed lose the points on a straight stretch between their neighbours."""
    def turns(i: Column) -> Column:
        a, b, c = (F.get("line", i + k) for k in (-1, 0, 1))
        cross = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
        return F.coalesce(F.abs(cross) > 1e-9, F.lit(True))  # the ends have no neighbour

    kept = F.filter("line", lambda _, i: turns(i))
    return rows.withColumn("line", F.when((F.col("origin") == "automatic") & ~F.col("modified"), kept).otherwise(F.col("line")))


def served(observations: DataFrame, order: str) -> DataFrame:
    """Observations with their place (from 0) on the page, as a provider hands them out again."""
    return observations.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(order)) - 1)
