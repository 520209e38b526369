"""Spikelet cleanup: neighbourhood context, border artifacts, premerge rejects, fragment attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box, axis_deg, distance, fractions, overlap_min
from ..policy import CORE, Policy
from .spatial import box_join, nearest


def neighbour_context(spikelets: DataFrame, policy: Policy = CORE) -> DataFrame:
    """det_id with n_neighbours, median_area, ratio, nearest and status keep, rejected or insufficient_context.

    Neighbours are the trusted ones of the page, nearest by centre. A candidate whose area is at most small_ratio of
    their median is rejected; isolated_small is recorded, not acted on.
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    trusted = spikelets.where(F.col("confidence") >= policy.trusted_confidence)
    near = nearest(spikelets, trusted, policy.neighbours, ["page_id"], "det_id", "det_id")
    areas = trusted.select("page_id", F.col("det_id").alias("r_id"), area.alias("r_area"))
    ctx = near.join(areas, ["page_id", "r_id"]).groupBy("page_id", "l_id").agg(F.count(F.lit(1)).alias("n_neighbours"), F.median("r_area").alias("median_area"), F.min("d").alias("nearest"))
    d = spikelets.select("page_id", "det_id", "confidence", area.alias("area"))
    d = d.join(ctx.withColumnRenamed("l_id", "det_id"), ["page_id", "det_id"], "left")
    n = F.coalesce("n_neighbours", F.lit(0))
    ratio = F.when(n >= policy.min_neighbours, F.col("area") / F.col("median_area"))
    status = F.when(n < policy.min_neighbours, "insufficient_context").when(ratio <= policy.small_ratio, "rejected").otherwise("keep")
    isolated = F.coalesce((ratio <= policy.isolated_ratio) & (F.col("nearest") / F.sqrt("median_area") >= policy.isolated_distance), F.lit(False))
    return d.select("page_id", "det_id", n.cast("long").alias("n_neighbours"), "median_area", ratio.alias("ratio"), "nearest", isolated.alias("isolated_small"), status.alias("status"))


def border_artifact(boxes: DataFrame, touch_px: float = 2.0, angle_deg: float = 15.0, following: float = 0.60) -> DataFrame:
    """det_id with border_artifact: a box along a page side that it touches, with most of its length inside a narrow band.

    boxes: det_id, x1, y1, x2, y2, page_w, page_h. The band is 0.2 % of the page's short side, 4 px at least.
    """
    b = Box.of()
    band = F.greatest(F.lit(4.0), 0.002 * F.least("page_w", "page_h"))
    upright = axis_deg(b) == 90.0
    sides = F.array(
        *[
            F.struct((gap <= touch_px).alias("touches"), along.alias("along"), F.when(gap < band, 1.0).otherwise(0.0).alias("following"))
            for gap, along in ((b.x1, upright), (F.col("page_w") - b.x2, upright), (b.y1, ~upright), (F.col("page_h") - b.y2, ~upright))
        ]
    )
    hit = F.exists(sides, lambda s: s["touches"] & s["along"] & (s["following"] >= following))
    return boxes.select("det_id", hit.alias("border_artifact"))


def reject_reasons(spikelets: DataFrame, awns: DataFrame, mm_x: float, mm_y: float, policy: Policy = CORE) -> DataFrame:
    """page_id, det_id and reasons (array, all that hold): too_small, oversized, awn_overlap.

    The overlap with awns is the largest with a single one: for boxes that don't pile up it is their union's lower bound.
    """
    b = Box.of()
    over = box_join(spikelets.select("page_id", "det_id", "x1", "y1", "x2", "y2"), awns.select("page_id", "x1", "y1", "x2", "y2"), 0.0, ["page_id"])
    l, r = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")  # noqa: E741
    over = over.groupBy(F.col("l.page_id").alias("page_id"), F.col("l.det_id").alias("det_id")).agg(F.max(fractions(l, r)[0]).alias("share"))
    area, axis = b.area * mm_x * mm_y, F.greatest(b.width * mm_x, b.height * mm_y)
    d = spikelets.select("page_id", "det_id", area.alias("area"), axis.alias("axis")).join(over, ["page_id", "det_id"], "left")
    found = F.array(
        F.when(F.col("area") < policy.premerge_min_area_mm2, "too_small"),
        F.when((F.col("area") > policy.premerge_max_area_mm2) & (F.col("axis") > policy.premerge_max_axis_mm), "oversized"),
        F.when(F.col("share") >= policy.premerge_awn_overlap, "awn_overlap"),
    )
    return d.select("page_id", "det_id", F.array_compact(found).alias("reasons"))


def attach_fragments(spikelets: DataFrame, mm_x: float, mm_y: float, policy: Policy = CORE) -> DataFrame:
    """fragment_id and target_id: small spikelets that belong to a larger neighbour, by (gap, larger area, id); a fragment is no target."""
    gap_px = policy.fragment_gap_mm / ((mm_x + mm_y) / 2)
    own = spikelets.select("page_id", "det_id", "x1", "y1", "x2", "y2")
    l, r = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")  # noqa: E741
    near = box_join(own, own, gap_px, ["page_id"]).where("l.det_id <> r.det_id").where(l.area <= policy.fragment_area_ratio * r.area)
    near = near.where((F.abs(axis_deg(l) - axis_deg(r)) <= policy.fragment_angle_deg) | (overlap_min(l, r) >= policy.fragment_overlap))
    near = near.select(F.col("l.page_id").alias("page_id"), F.col("l.det_id").alias("fragment_id"), F.col("r.det_id").alias("target_id"), F.round(distance(l, r), 9).alias("gap"), r.area.alias("target_area"))
    free = near.join(near.select("page_id", F.col("fragment_id").alias("target_id")).distinct(), ["page_id", "target_id"], "left_anti")
    w = Window.partitionBy("page_id", "fragment_id").orderBy("gap", F.desc("target_area"), "target_id")
    return free.withColumn("k", F.row_number().over(w)).where("k = 1").select("page_id", "fragment_id", "target_id")


def leave_one_out(candidates: DataFrame, group: str = "page_id", policy: Policy = CORE) -> DataFrame:
    """det_id and rejected: weak candidates far smaller than the median of the others in their group."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    d = candidates.select(group, "det_id", "confidence", area.alias("area"))
    others = d.select(group, F.col("det_id").alias("o_id"), F.col("area").alias("o_area"))
    med = d.join(others, group).where("det_id <> o_id").groupBy(group, "det_id").agg(F.median("o_area").alias("m"))
    d = d.join(med, [group, "det_id"], "left")
    return d.select(group, "det_id", F.coalesce((F.col("confidence") < policy.trusted_confidence) & (F.col("area") <= policy.small_ratio * F.col("m")), F.lit(False)).alias("rejected"))
