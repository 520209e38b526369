"""Duplicate candidates and their classification into strong, ambiguous and distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, axis_deg, intersection, iou, overlap_min
from ..policy import CORE, PairThresholds, Policy
from .spatial import box_self_join


def _box(side: str, tile: bool = False) -> Box:
    if tile:
        x, y = F.col(f"{side}.tx1"), F.col(f"{side}.ty1")
        return Box(x, y, x + 640.0, y + 640.0)
    return Box(*(F.col(f"{side}.{c}") for c in ("x1", "y1", "x2", "y2")))


def candidate_pairs(detections: DataFrame, policy: Policy = CORE) -> DataFrame:
    """Pairs of one page and class whose boxes come within twice the class's buffer (structs l and r, l of smaller det_id)."""
    out = None
    for name, t in (("awn", policy.awn), ("spikelet", policy.spikelet)):
        own = box_self_join(detections.where(F.col("class_name") == name), 2 * t.buffer_px, ["page_id", "class_name"], "det_id")
        out = own if out is None else out.unionByName(own)
    return out


def _features(t: PairThresholds) -> dict[str, Column]:
    l, r = _box("l"), _box("r")  # noqa: E741
    gl, gr = l.grow(t.buffer_px), r.grow(t.buffer_px)
    window = _box("l", tile=True).clip(_box("r", tile=True))
    ls, rs = l.clip(window), r.clip(window)
    meets = (window.width > 0) & (window.height > 0)
    shared = l.clip(r)
    touch = meets & (shared.width > 0) & (shared.height > 0)
    size = lambda b: F.greatest(F.lit(0.0), b.width) * F.greatest(F.lit(0.0), b.height)
    seen = size(ls) + size(rs) - F.when((ls.width > 0) & (ls.height > 0) & (rs.width > 0) & (rs.height > 0), size(ls.clip(rs))).otherwise(0.0)
    return {
        "same_tile": F.col("l.tile_id") == F.col("r.tile_id"),
        "windows_overlap": meets,
        "inter_area": intersection(l, r),
        "overlap_min": overlap_min(l, r),
        "buffered_iou": iou(gl, gr),
        "buffered_overlap": overlap_min(gl, gr),
        "shared_iou": F.when(touch, size(shared) / F.greatest(seen, F.lit(1e-9))).otherwise(0.0),
        "extent": F.when(touch, F.greatest(shared.width, shared.height)).otherwise(0.0),
        "angle": F.abs(axis_deg(l) - axis_deg(r)),
    }


def classify(pairs: DataFrame, policy: Policy = CORE) -> DataFrame:
    """page_id, class_name, a, b (det_ids), status, reason, strength and the features, for pairs of candidate_pairs()."""
    out = None
    for name, t in (("awn", policy.awn), ("spikelet", policy.spikelet)):
        f = _features(t)
        d = pairs.where(F.col("l.class_name") == name)
        d = d.select(F.col("l.page_id").alias("page_id"), F.lit(name).alias("class_name"), F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b"), *[c.alias(k) for k, c in f.items()])
        c = F.col
        k = policy.ambiguous_factor

        def crossing(scale: float) -> Column:
            near = (c("overlap_min") >= policy.cross_overlap * scale) & (c("shared_iou") >= policy.cross_iou * scale)
            return ~c("same_tile") & c("windows_overlap") & (c("inter_area") >= policy.cross_area_px2 * scale) & near & (c("extent") >= policy.cross_extent_px * scale)

        cross = crossing(1.0)
        if name == "awn" and policy.cross_angle_deg is not None:
            cross = cross & (c("angle") <= policy.cross_angle_deg)
        dup = (c("buffered_iou") >= t.iou) | (c("buffered_overlap") >= t.overlap)
        near_dup = (c("buffered_iou") >= t.iou * k) | (c("buffered_overlap") >= t.overlap * k)
        near_same = F.lit(False)
        if t.same_tile_overlap is not None:
            dup = dup & (~c("same_tile") | ((c("angle") <= t.same_tile_angle_deg) & (c("buffered_overlap") >= t.same_tile_overlap)))
            near_same = c("same_tile") & (c("buffered_overlap") >= policy.same_tile_near_overlap) & (c("angle") <= policy.same_tile_near_angle_deg)
        near = near_dup | crossing(k) | near_same
        status = F.when(cross | dup, "strong").when(near, "ambiguous").otherwise("distinct")
        reason = (
            F.when(cross, "cross_tile_overlap").when(dup, "buffered_duplicate").when(near & near_same, "same_tile_near_duplicate").when(near, "near_duplicate")
            .when(c("same_tile"), "same_tile_coexistence").otherwise("geometry_incompatible")
        )
        strength = F.greatest(c("buffered_iou") / t.iou, c("buffered_overlap") / t.overlap, c("overlap_min") / policy.cross_overlap, c("shared_iou") / policy.cross_iou)
        d = d.withColumn("status", status).withColumn("reason", reason).withColumn("strength", strength)
        out = d if out is None else out.unionByName(d)
    return out
