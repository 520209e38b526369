"""Registered queries whose order-dependent or geometric part runs in Python: grouped maps by page, Arrow kernels by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions.boxes import Box, distance
from ..functions.polyline import point
from ..operators import clusters, growth, measures, pairs, roots, seeds, shapes, spatial, trajectories
from ..policy import STUDIO

MM = 0.085  # mm for a pixel in the derived scenes: a grid of 5 mm spans 58.8 pixels
PERIOD = 5 / MM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(fixtures.load(spark, sf_dir, "fx_detections"))
        if sql:
            ORACLE_SQL[name] = f"{fixtures.ctes('fx_detections')} {sql}"
        return fn

    return add


def _ring():
    b = Box.of()
    return F.array(point(b.x1, b.y1), point(b.x2, b.y1), point(b.x2, b.y2), point(b.x1, b.y2))


def supports_of(det: DataFrame) -> DataFrame:
    """Each awn box as a support: a line of points every 6 pixels from its lower to its upper end, slightly leaning."""
    n = F.greatest(F.lit(2), F.floor((F.col("y2") - F.col("y1")) / 6).cast("int"))
    at = lambda i: F.struct(((F.col("x1") + F.col("x2")) / 2 + (F.col("det_id") % 5 - 2) * i / n).alias("x"), (F.col("y2") - (F.col("y2") - F.col("y1")) * i / n).alias("y"))
    raw = F.transform(F.sequence(F.lit(0), n), at)
    d = det.where("class_id = 0").select("page_id", F.col("det_id").alias("support_id"), raw.alias("raw"), "confidence", F.array(F.concat(F.lit("t"), F.col("tile_id").cast("string"))).alias("prediction_keys"), "x1", "y1", "x2", "y2")
    none = F.array().cast("array<struct<raw_point:struct<x:double,y:double>,off_path_reach_mm:double>>")
    return d.withColumn("path", F.transform("raw", lambda p: F.struct((p["x"] * MM).alias("x"), (p["y"] * MM).alias("y")))).withColumn("junctions", none)


def seeds_of(det: DataFrame) -> DataFrame:
    """Awns whose box comes near a spikelet's, scored; the k best of each spikelet."""
    near = spatial.box_join(det.where("class_id = 1"), det.where("class_id = 0"), 2.8 / MM, ["page_id"])
    a, b = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")
    gap = F.round(distance(a, b) * MM, 9)
    d = near.select(F.col("l.page_id").alias("page_id"), F.col("l.det_id").alias("spikelet_id"), F.col("r.det_id").alias("support_id"), F.when(b.y1 < a.y1, "direct").otherwise("projected").alias("mode"), gap.alias("root_distance_mm"),
                    (gap / 3).alias("projection_distance_mm"), F.col("r.confidence").alias("confidence"), (b.height * MM).alias("length_mm"), F.lit(5.0).alias("axis_deviation_deg"))
    return seeds.top(d.where(seeds.is_basic()))


@_query("A2_A3_A5_hypotheses")
def _hypotheses(det):
    out = clusters.reconcile(det, pairs.classify(pairs.candidate_pairs(det)))
    return out.select("page_id", "class_name", "hypothesis", "status", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), F.round("area", 6).alias("area"), "reasons")


@_query("A2_A3_A5_hypotheses_studio")
def _hypotheses_studio(det):
    out = clusters.reconcile(det, pairs.classify(pairs.candidate_pairs(det, STUDIO), STUDIO))
    return out.groupBy("page_id", "class_name", "status").agg(F.count(F.lit(1)).alias("n"))


@_query("U4_hypotheses_cover_evidence", "select det_id as key, case when det_id % 50 = 0 then 'missing' else 'foreign' end as fault from (select det_id from fx_detections where det_id % 50 = 0 union all select det_id + 1000000000 from fx_detections where det_id % 50 = 1) z")
def _cover(det):
    """The members of all hypotheses cover the evidence; evidence taken away or added shows."""
    from ..operators.checks import partition_faults

    members = clusters.reconcile(det, pairs.classify(pairs.candidate_pairs(det))).select(F.explode("members").alias("det_id"))
    seen = members.where("det_id % 50 <> 0").unionByName(det.where("det_id % 50 = 1").select((F.col("det_id") + 1000000000).alias("det_id")))
    return partition_faults(det, [seen], "det_id")


@_query("A6_compaction")
def _compaction(det):
    out = clusters.compact(det.where("class_id = 0"))
    return out.select("page_id", "anchor", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@_query("X14_compaction_summary")
def _compaction_summary(det):
    d = clusters.compact(det.where("class_id = 0"))
    return d.groupBy("page_id").agg(F.sum(F.size("members")).cast("long").alias("n"), F.count(F.lit(1)).alias("n_left"), F.count_if(F.size("members") > 1).alias("n_groups"), F.max(F.size("members")).alias("largest"))


@_query("A8_best_pair_dedupe")
def _dedupe(det):
    return clusters.dedupe_best_pairs(det)


@_query("O4_reading_order")
def _order(det):
    return shapes.reading_order(det.where("class_id = 1"))


@_query(
    "P18_P28_shape_features",
    """select det_id as id, round((x2 - x1)*(y2 - y1), 4) as area, round(2*(x2 - x1 + y2 - y1), 4) as perimeter, round(greatest(x2 - x1, y2 - y1), 4) as long_side, round(least(x2 - x1, y2 - y1), 4) as short_side,
    round(greatest(x2 - x1, y2 - y1)/least(x2 - x1, y2 - y1), 4) as aspect, 1.0e0 as solidity, 1.0e0 as extent from fx_detections""",
)
def _shapes(det):
    out = shapes.shape_features(det.select(F.col("det_id").alias("id"), _ring().alias("ring")))
    return out.select("id", *[F.round(c, 4).alias(c) for c in ("area", "perimeter", "long_side", "short_side", "aspect", "solidity", "extent")])


@_query("P25_A18_skeleton_supports")
def _skeletons(det):
    out = shapes.skeleton_supports(det.where("class_id = 0").select(F.col("det_id").alias("id"), _ring().alias("ring")))
    return out.select("id", "endpoints", "branches", F.size("raw").alias("n_points"), F.round("length_px", 6).alias("length_px"))


@_query("A22_seed_groups")
def _groups(det):
    s = seeds_of(det).join(supports_of(det).select(F.col("support_id"), "path"), "support_id")
    return clusters.group_seeds(s.select("spikelet_id", "support_id", "mode", "root_distance_mm", "confidence", "path"))


def _grown(det: DataFrame, policy=None) -> DataFrame:
    return growth.grow(supports_of(det), seeds_of(det), policy or growth.CORE)


@_query("A23_A24_representatives")
def _representatives(det):
    d = _grown(det).where("place = 1")
    return d.select("page_id", "spikelet_id", "seed_id", F.round("branch_score", 6).alias("branch_score"), F.round("length_mm_internal", 6).alias("length_mm_internal"), "growth_hops", F.array_join(F.transform("support_ids", lambda m: m.cast("string")), ",").alias("support_ids"))


@_query("A30_growth_summary")
def _growth_summary(det):
    d = _grown(det, STUDIO)
    return d.groupBy("page_id").agg(F.count_if(F.col("place") == 1).alias("n_representatives"), F.count(F.lit(1)).alias("n_branches"), F.sum(F.when(F.col("place") == 1, F.col("growth_hops"))).alias("n_hops"), F.round(F.sum(F.when(F.col("place") == 1, F.col("length_mm_internal"))), 6).alias("length_mm"))


@_query("J20_inspection_records")
def _inspection(det):
    first = F.col("place") == 1
    d = _grown(det).groupBy("spikelet_id").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("seed_id", "branch_score", "growth_hops")], F.count_if(~first).alias("n_alternatives"), F.max(F.when(~first, F.col("branch_score"))).alias("best_alternative")
    )
    spikelets = det.where("class_id = 1").select(F.col("det_id").alias("spikelet_id"), "confidence")
    out = spikelets.join(d, "spikelet_id", "full_outer")
    return out.select("spikelet_id", "confidence", "seed_id", F.round("branch_score", 6).alias("branch_score"), "growth_hops", F.coalesce("n_alternatives", F.lit(0).cast("long")).alias("n_alternatives"), F.round("best_alternative", 6).alias("best_alternative"))


@_query("J17_foreign_body_stops")
def _bodies(det):
    ring = F.transform(_ring(), lambda p: F.struct((p["x"] * MM).alias("x"), (p["y"] * MM).alias("y")))
    bodies = det.where("class_id = 1").select("page_id", F.col("det_id").alias("spikelet_id"), ring.alias("ring"))
    d = growth.grow(supports_of(det), seeds_of(det), bodies=bodies).where("place = 1")
    return d.groupBy("page_id", "stop").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length_mm_internal"), 6).alias("length_mm"))


@_query("A32_root_normalization")
def _roots(det):
    d = _grown(det).where("place = 1").select("page_id", "spikelet_id", "raw_path")
    spikelets = det.where("class_id = 1").select(F.col("det_id").alias("spikelet_id"), _ring().alias("ring"))
    d = d.join(spikelets, "spikelet_id", "left").select("page_id", "spikelet_id", "raw_path", "ring", F.lit(PERIOD).alias("x_period"), F.lit(PERIOD).alias("y_period"))
    return roots.normalize_roots(d).select("page_id", "spikelet_id", "status", F.round("removed_mm", 6).alias("removed_mm"), F.round("length_mm_root_normalized", 6).alias("length_mm"))


@_query("A37_grid_calibration")
def _calibration(det):
    pages = det.select("page_id").distinct()
    strip = pages.select("page_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis")).select("page_id", "axis", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("strip"))
    # Strips are a few bytes each and their profiles 24,000: they are dealt out before profiles are made.
    strip = strip.repartition(int(det.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id", "axis", "strip")
    values = F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.cos(2 * F.pi() * (i + F.col("strip")) / (F.lit(58.0) + F.col("page_id") % 3)))
    out = shapes.calibrate(strip.select("page_id", "axis", "strip", values.alias("values")))
    c = F.col
    qc = measures.grid_qc(c("x_period"), c("y_period"), c("x_strip_range"), c("y_strip_range"), c("x_peaks"), c("y_peaks"))
    return out.select("page_id", F.round("x_period", 3).alias("x_period"), F.round("y_period", 3).alias("y_period"), F.array_join(qc, ",").alias("qc_reasons"))


@_query(
    "P9_P16_P29_path_features",
    "select det_id as id, round(sqrt(power(y2 - y1, 2) + power(det_id % 5 - 2, 2)), 4) as length, 2 as n_simplified, round((x1 + x2)/2 + (det_id % 5 - 2)/2, 4) as midpoint_x, round((y1 + y2)/2, 4) as midpoint_y, 0.0e0 as max_turn_deg from fx_detections where class_id = 0",
)
def _path_features(det):
    out = trajectories.path_features(supports_of(det).select(F.col("support_id").alias("id"), F.col("raw").alias("path")))
    return out.select("id", F.round("length", 4).alias("length"), "n_simplified", F.round("midpoint_x", 4).alias("midpoint_x"), F.round("midpoint_y", 4).alias("midpoint_y"), F.round("max_turn_deg", 3).alias("max_turn_deg"))


@_query("P42_P43_J15_resolved_supports")
def _resolved(det):
    from ..functions.boxes import distance as gap

    near = spatial.box_self_join(supports_of(det).select("page_id", "support_id", "path", "x1", "y1", "x2", "y2"), 2.8 / MM, ["page_id"], "support_id")
    a, b = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")
    d = near.where(gap(a, b) > 0).select(F.struct(F.col("l.support_id").alias("a"), F.col("r.support_id").alias("b")).alias("id"), F.col("l.path").alias("current"), F.col("r.path").alias("support"))
    out = trajectories.resolve_pairs(d)
    return out.select("id.a", "id.b", "entry", "reversed", *[F.round(c, 6).alias(c) for c in ("distance", "angle", "extension", "internal_turn", "join_local_turn_deg", "join_excess_turn_deg", "multiscale_angle_deg")])
