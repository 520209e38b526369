"""Polylines: arrays of points (x, y) folded by higher-order functions, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def segments(path: Column, fn) -> Column:
    """fn(a, b) for each neighbouring pair; an empty array below two points (sequence(1, 0) would count down)."""
    n = F.size(path)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: fn(F.element_at(path, i), F.element_at(path, i + 1)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length(path: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> Column:
    """Length of a polyline with separate scales for x and y; 0 below two points, null for null."""
    sx, sy = F.lit(sx), F.lit(sy)
    steps = segments(path, lambda a, b: F.hypot((b["x"] - a["x"]) * sx, (b["y"] - a["y"]) * sy))
    return F.when(path.isNotNull(), total(steps))


def calibrated_length(path: Column, x_period_px: Column, y_period_px: Column, grid_mm: float = 5.0) -> Column:
    """Length in mm where a grid cell of grid_mm spans the given pixels along x and y."""
    return length(path, F.lit(grid_mm) / x_period_px, F.lit(grid_mm) / y_period_px)


def scalar_length(path: Column, reference: Column, mm: Column) -> Column:
    """Length in mm by one ratio, mm over the reference line's pixels; null without two points or without a calibration."""
    px = length(reference)
    return F.when((F.size(path) >= 2) & (px > 0) & (mm > 0), length(path) * mm / px)


def cumulative(path: Column) -> Column:
    """Arc length from the first point to each point."""
    steps = segments(path, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0.0)).alias("all"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
    return F.when(F.size(path) > 0, F.aggregate(steps, start, step, lambda a: a["all"]))


def to_canonical(path: Column, sx: Column, sy: Column, rotation_deg: Column) -> Column:
    """Raw pixels to the canonical frame in mm: scale, then rotate."""
    c, s = F.cos(F.radians(rotation_deg)), F.sin(F.radians(rotation_deg))
    return F.transform(path, lambda p: F.struct((c * p["x"] * sx - s * p["y"] * sy).alias("x"), (s * p["x"] * sx + c * p["y"] * sy).alias("y")))


def to_raw(path: Column, sx: Column, sy: Column, rotation_deg: Column) -> Column:
    """The inverse of to_canonical()."""
    c, s = F.cos(F.radians(rotation_deg)), F.sin(F.radians(rotation_deg))
    return F.transform(path, lambda p: F.struct(((c * p["x"] + s * p["y"]) / sx).alias("x"), ((c * p["y"] - s * p["x"]) / sy).alias("y")))


def trim(path: Column, limit: Column) -> Column:
    """The path's start up to a length, its last point interpolated; empty if fewer than two points are left.

    A limit of the whole length or more leaves the path as it is.
    """
    n = F.size(path)
    at = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0.0).alias("used"), F.slice(path, 1, 1).alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.element_at(path, i - 1), F.element_at(path, i)
        d = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (limit - acc["used"]) / d))
        cut = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
        return (
            F.when(acc["done"] | (d <= 1e-9), acc)
            .when(acc["used"] + d <= limit, F.struct((acc["used"] + d).alias("used"), F.concat(acc["out"], F.array(b)).alias("out"), F.lit(False).alias("done")))
            .otherwise(F.struct(acc["used"].alias("used"), F.concat(acc["out"], F.array(cut)).alias("out"), F.lit(True).alias("done")))
        )

    cut = F.aggregate(at, start, step, lambda a: a["out"])
    none = F.array().cast(f"array<{POINT}>")
    return F.when((n < 2) | (limit <= 0), none).when(limit >= length(path), path).when(F.size(cut) >= 2, cut).otherwise(none)


def nearest_segment(path: Column, px: Column, py: Column, closed: bool = False) -> Column:
    """Struct (distance, index from 0, point) of the segment nearest to a point; the first one among equals."""
    ring = F.concat(path, F.slice(path, 1, 1)) if closed else path
    n = F.size(ring)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def each(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        den = dx * dx + dy * dy
        t = F.when(den > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / den))).otherwise(0.0)
        q = F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"))
        return F.struct(F.hypot(q["x"] - px, q["y"] - py).alias("distance"), (i - 1).alias("index"), q.alias("point"))

    return F.array_min(F.transform(at, each))


def connector(ax: Column, ay: Column, bx: Column, by: Column, steps: int) -> Column:
    """Evenly spaced points from a to b, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((ax + (bx - ax) * i / steps).alias("x"), (ay + (by - ay) * i / steps).alias("y")))


def append_suffix(path: Column, support: Column, entry: Column) -> Column:
    """The path continued by the support's points after the entry index (from 0)."""
    return F.concat(path, F.slice(support, entry + 2, F.greatest(F.size(support) - entry - 1, F.lit(0))))


def confidence_cut(path: Column, steps: Column, threshold: Column, mm_per_px: Column) -> Column:
    """The path without what growth added from the first step under the threshold on; without such a step, as it is."""
    low = F.transform(steps, lambda s: F.coalesce(s["support_confidence"] < threshold, F.lit(False)))
    first = F.coalesce(F.array_position(low, True), F.lit(0)).cast("int")
    later = F.when(first > 0, F.slice(steps, first, F.greatest(F.size(steps) - first + 1, F.lit(0))))
    removed = F.aggregate(later, F.lit(0.0), lambda a, s: a + F.greatest(F.coalesce(s["extension_mm"], F.lit(0.0)), F.lit(0.0)))
    unchanged = (F.size(path) < 2) | (threshold <= 0) | mm_per_px.isNull() | (mm_per_px <= 0) | (first == 0) | (removed <= 0)
    return F.when(F.coalesce(unchanged, F.lit(True)), path).otherwise(trim(path, length(path) - removed / mm_per_px))
