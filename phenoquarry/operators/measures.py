"""Calibration, resolution and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE_PX = 198.08


def resolution_band(n: Column, ratio: Column, epsilon: float = 0.001) -> Column:
    """What to do with a page whose median spikelet is ratio times the reference size."""
    return (
        F.when((n < 3) | ratio.isNull(), "unassessed").when(ratio > 2.00 + epsilon, "downscale").when(ratio < 0.30 - epsilon, "block")
        .when(ratio < 0.50 - epsilon, "upscale").otherwise("pass")
    )


def resolution_target(band: Column) -> Column:
    return F.when(band == "downscale", 1.30).when(band == "upscale", 1.00)


def plausibility(n: Column, median_px: Column, mm_per_px: Column) -> Column:
    """Whether the median long side in mm is that of a spikelet; null below three detections."""
    mm = median_px * mm_per_px
    return F.when(n >= 3, F.when((mm >= 8) & (mm <= 24), F.when((mm >= 10) & (mm <= 20), "typical").otherwise("unusual")).otherwise("implausible"))


def scale_probe(boxes: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Per page over sure spikelets: count, median long side, median geometric mean, 10th and 90th percentile, ratio to the reference."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = F.greatest(w, h)
    return boxes.where(F.col("confidence") >= confidence).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.median(side).alias("median_px"), F.median(F.sqrt(w * h)).alias("median_geo_px"),
        F.percentile(side, 0.1).alias("p10_px"), F.percentile(side, 0.9).alias("p90_px"), (F.median(side) / REFERENCE_PX).alias("ratio"),
    )


def trim_summary(rows: DataFrame, status: str = "status", removed: str = "removed_mm") -> DataFrame:
    """Totals of root normalisation: rows, trimmed ones, and total, median, 95th percentile and maximum of what was removed (0 if none)."""
    positive = F.when(F.col(removed) > 0, F.col(removed))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(status).agg(
        F.count(F.lit(1)).alias("n"), F.count(positive).alias("n_trimmed"), zero(F.sum(positive)).alias("total_mm"), zero(F.median(positive)).alias("median_mm"),
        zero(F.percentile(positive, 0.95)).alias("p95_mm"), zero(F.max(positive)).alias("max_mm"),
    )


def rerun_advised(old: Column, new: Column) -> Column:
    return F.coalesce(F.abs(old - new) > 1e-8, old.isNull() != new.isNull())


def grid_qc(x_period: Column, y_period: Column, x_range: Column, y_range: Column, x_peaks: Column, y_peaks: Column) -> Column:
    """Reasons (array) for which a grid calibration fails; empty if it is adequate."""
    bad = [
        (~x_period.between(54, 64), "x_period"), (~y_period.between(54, 64), "y_period"),
        (F.abs(x_period - y_period) / F.greatest(x_period, y_period) > 0.05, "anisotropy"),
        (x_range > 3, "x_strips"), (y_range > 3, "y_strips"), (x_peaks < 40, "x_peaks"), (y_peaks < 25, "y_peaks"),
    ]
    return F.array_compact(F.array(*[F.when(c, code) for c, code in bad]))


def robust_period(gaps: Column) -> Column:
    """Grid period from the gaps between line positions: the median of plausible gaps, then of the gaps over the cells they span, twice."""
    med = lambda a: F.when(F.size(a) > 0, (F.element_at(F.array_sort(a), F.floor((F.size(a) + 1) / F.lit(2)).cast("int")) + F.element_at(F.array_sort(a), (F.floor(F.size(a) / F.lit(2)) + 1).cast("int"))) / 2)
    plausible = F.filter(gaps, lambda g: g.between(50, 68))
    p = med(F.when(F.size(plausible) > 0, plausible).otherwise(gaps))
    for floor, share in ((5.0, 0.12), (4.0, 0.10)):
        per = F.transform(gaps, lambda g, p=p: g / F.greatest(F.lit(1.0), F.rint(g / p)))
        kept = F.filter(per, lambda v, p=p, floor=floor, share=share: F.abs(v - p) <= F.greatest(F.lit(floor), p * share))
        p = F.coalesce(med(kept), p)
    return p
