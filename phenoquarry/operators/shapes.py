"""Polygon and mask features as Arrow kernels: shapes, supports from masks, grid calibration from profiles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import geometry, raster

XY = "array<struct<x:double,y:double>>"
SHAPES = f"id long, area double, perimeter double, long_side double, short_side double, axis_deg double, aspect double, solidity double, extent double, compactness double, simplified {XY}"


def _ring(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def _points(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def _flat_rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All points of a column of rings, and where each ring begins and the last ends; a null ring is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 2)), np.zeros(1, np.int64)
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    return np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1), np.append(0, np.cumsum(sizes))


def _lists(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), xy)


def _upright(q: np.ndarray, tolerance: float) -> np.ndarray:
    """Which of the four-point rings (n, 4, 2) are upright boxes that lose no corner by simplification: they have closed forms."""
    lo, hi = q.min(1, keepdims=True), q.max(1, keepdims=True)
    turns = (q != np.roll(q, -1, 1)).sum(2)
    w, h = (hi - lo)[:, 0].T
    diagonal = np.hypot(w, h)
    return ((q == lo) | (q == hi)).all((1, 2)) & (turns == 1).all(1) & (np.minimum(w, h) > tolerance) & (w * h > tolerance * diagonal)


def _measured(r: np.ndarray, tolerance: float) -> tuple:
    long, short, u = geometry.rotated_rectangle(r)
    m = geometry.shape_metrics(r)
    angle = float(np.degrees(np.arctan2(u[1], u[0])) % 180)
    return geometry.area(r), geometry.perimeter(r), long, short, angle, m["aspect"], m["solidity"], m["extent"], m["compactness"], geometry.simplify(r, tolerance)


def shape_features(polygons: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Rows (id, ring) to SHAPES; rings of fewer than three points are left out. Upright boxes are measured all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, at = _flat_rings(b.column("ring"))
            n = np.diff(at)
            boxes = np.flatnonzero(n == 4)
            q = points[at[boxes][:, None] + np.arange(4)]
            good = _upright(q, tolerance)
            boxes, q = boxes[good], q[good]
            values = np.zeros((b.num_rows, 9))
            w, h = np.ptp(q, axis=1).T
            along = np.where(w >= h, 0.0, 90.0)
            long, short, s, around = np.maximum(w, h), np.minimum(w, h), w * h, 2 * (w + h)
            one = np.ones(len(boxes))
            values[boxes] = np.stack([s, around, long, short, along, long / short, one, one, 4 * np.pi * s / around**2], axis=1) if len(boxes) else values[boxes]
            kept = {int(i): None for i in boxes}
            for i in np.setdiff1d(np.flatnonzero(n >= 3), boxes):
                *values[i], kept[int(i)] = _measured(points[at[i] : at[i + 1]], tolerance)
            rows = np.array(sorted(kept), np.int64)
            rings = [points[at[i] : at[i + 1]] if kept[i] is None else kept[i] for i in rows.tolist()]
            simple = _lists(np.concatenate(rings) if rings else np.zeros((0, 2)), np.array([len(x) for x in rings], np.int64))
            names = [c.split(" ")[0] for c in SHAPES.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), *(pa.array(values[rows, k]) for k in range(9)), simple], names)

    return polygons.select(F.col("id").cast("long").alias("id"), "ring").mapInArrow(run, SHAPES)


SUPPORTS = f"id long, endpoints int, branches int, raw {XY}, length_px double"


#: Skeletons that a task remembers; rings of one shape have one, wherever they lie.
REMEMBERED = 4096


class _Skeleton(NamedTuple):
    """Of a ring whose mask begins at (0, 0)."""

    path: np.ndarray
    endpoints: int
    branches: int
    length: float


def _skeleton(ring: np.ndarray) -> _Skeleton:
    mask, origin = raster.rasterize([ring])
    skeleton = raster.thin(mask)
    path = raster.diameter_path(skeleton) + origin
    if len(path) and path[0][1] < path[-1][1]:
        path = path[::-1]
    return _Skeleton(path, *raster.topology(skeleton), float(np.hypot(*np.diff(path, axis=0).T).sum()) if len(path) > 1 else 0.0)


def skeleton_supports(polygons: DataFrame) -> DataFrame:
    """Rows (id, ring) to the centre line of each mask: the longest shortest path of its skeleton, lower end first.

    A ring is laid at whole pixels' distance from the origin, so rings of one shape have one mask, which is thinned once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, _Skeleton] = {}
        for b in batches:
            points, at = _flat_rings(b.column("ring"))
            n = np.diff(at)
            rows, found, origins = [], [], []
            for k in np.unique(n[n >= 3]).tolist():
                own = np.flatnonzero(n == k)
                q = points[at[own][:, None] + np.arange(k)]
                origin = np.floor(q.min(1)) - 1
                shapes, which = np.unique((q - origin[:, None]).reshape(len(own), -1), axis=0, return_inverse=True)
                each = []
                for shape in shapes:
                    key = shape.tobytes()
                    if key not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[key] = _skeleton(shape.reshape(-1, 2))
                    each.append(known[key])
                rows.append(own)
                found += [each[i] for i in which.ravel().tolist()]
                origins.append(origin)
            if not rows:
                continue
            sizes = np.array([len(x.path) for x in found])
            lines = np.concatenate([x.path for x in found]) + np.repeat(np.concatenate(origins), sizes, axis=0)
            values = [pa.array([x[c] for x in found], t) for c, t in ((1, pa.int32()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.concatenate(rows))), *values, _lists(lines, sizes), pa.array([x.length for x in found])], [c.split(" ")[0] for c in ("id", "endpoints", "branches", "raw", "length_px")])

    return polygons.select(F.col("id").cast("long").alias("id"), "ring").mapInArrow(run, SUPPORTS)


def find_peaks(y: np.ndarray, distance: int = 40, prominence: float = 0.0) -> np.ndarray:
    """Local maxima (plateaus by their middle) at least a distance apart, higher ones first, and prominent enough."""
    n = len(y)
    begin = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if n else np.zeros(0, int)
    end, v = np.append(begin[1:], n) - 1, y[begin]
    top = 1 + np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))
    peaks = (begin[top] + end[top]) // 2
    kept, near = [], np.zeros(n, bool)
    for j in np.lexsort((-peaks, -y[peaks])).tolist():
        k = int(peaks[j])
        if not near[k]:
            kept.append(j)
            near[max(0, k - distance + 1) : k + distance] = True
    if not kept:
        return np.zeros(0, int)

    # Between neighbouring maxima there is one valley; a peak stands out if both ways go down enough before they are higher.
    at = np.concatenate([[0], peaks, [n - 1]])
    height, valley = y[at].tolist(), np.minimum.reduceat(y, at[:-1]).tolist()
    valley[-1] = min(valley[-1], height[-1])

    def falls(j: int, to: int) -> bool:
        least, own = height[j], height[j]
        while own - least < prominence and 0 <= j + to < len(at):
            least = min(least, valley[j if to > 0 else j - 1])
            j += to
            if height[j] > own:
                break
        return own - least >= prominence

    return np.array(sorted(int(peaks[j]) for j in kept if falls(j + 1, 1) and falls(j + 1, -1)), int)


def grid_period(gaps: np.ndarray) -> float:
    """Median of the plausible gaps, then twice the median of the gaps over the cells they span."""
    good = gaps[(gaps >= 50) & (gaps <= 68)]
    p = float(np.median(good if len(good) else gaps))
    for floor, share in ((5.0, 0.12), (4.0, 0.10)):
        per = gaps / np.maximum(1, np.rint(gaps / p))
        kept = per[np.abs(per - p) <= max(floor, share * p)]
        p = float(np.median(kept)) if len(kept) else p
    return p


CALIBRATION = "page_id long, x_period double, y_period double, x_peaks int, y_peaks int, x_strip_range double, y_strip_range double"


def calibrate(profiles: DataFrame) -> DataFrame:
    """Rows (page_id, axis: x or y, strip, values: array of line scores along the axis) to one period for each axis.

    The period is the median over the strips, and its range over them the stability that grid_qc() judges. Profiles are
    read where they are; only a strip's period and number of peaks are brought together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("values")
            at = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64)))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
            counts, periods = [], []
            for y in (flat[a:e] for a, e in zip(at, at[1:])):
                peaks = find_peaks(y, 40, 0.1 * float(np.ptp(y)) if len(y) else 0.0)
                counts.append(len(peaks))
                periods.append(grid_period(np.diff(peaks).astype(float)) if len(peaks) > 1 else None)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("axis"), pa.array(counts, pa.int32()), pa.array(periods, pa.float64())], ["page_id", "axis", "peaks", "period"])

    d = profiles.select(F.col("page_id").cast("long").alias("page_id"), "axis", "values").mapInArrow(run, "page_id long, axis string, peaks int, period double")
    of = lambda axis, c: F.when(F.col("axis") == axis, F.col(c))
    return d.groupBy("page_id").agg(
        *[F.median(of(a, "period")).alias(f"{a}_period") for a in "xy"], *[F.coalesce(F.max(of(a, "peaks")), F.lit(0)).alias(f"{a}_peaks") for a in "xy"],
        *[(F.max(of(a, "period")) - F.min(of(a, "period"))).alias(f"{a}_strip_range") for a in "xy"],
    )


ORDER = "page_id long, det_id long, position int"


def reading_order(groups: DataFrame, rotation_deg: float = 0.0) -> DataFrame:
    """Position (from 1) of boxes row by row: rows end where the next centre is 1.5 upper-median heights below the row's mean."""
    c, s = np.cos(np.radians(rotation_deg)), np.sin(np.radians(rotation_deg))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        corners = np.stack([np.stack([d[a], d[b]], 1) for a in ("x1", "x2") for b in ("y1", "y2")], 1).astype(float)
        turned = corners @ np.array([[c, s], [-s, c]])
        lo, hi = turned.min(1), turned.max(1)
        mid, h = (lo + hi) / 2, np.sort(hi[:, 1] - lo[:, 1])
        gap = (h[len(h) // 2] or 1.0) * 1.5
        rows: list[list[int]] = []
        for i in np.lexsort((d.det_id, mid[:, 1])):
            if not rows or mid[i, 1] - mid[rows[-1], 1].mean() > gap:
                rows.append([])
            rows[-1].append(int(i))
        order = [i for r in rows for i in sorted(r, key=lambda i: (mid[i, 0], d.det_id.iloc[i]))]
        return pd.DataFrame({"page_id": d.page_id.iloc[0], "det_id": d.det_id.to_numpy()[order], "position": np.arange(1, len(order) + 1, dtype="int32")})

    return groups.groupBy("page_id").applyInPandas(run, ORDER)
