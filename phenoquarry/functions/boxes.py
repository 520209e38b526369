"""Axis-aligned boxes as four columns: distances, overlaps and border tests in closed form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def long_side(self) -> Column:
        return F.greatest(self.width, self.height)

    def grow(self, r: Column | float) -> Box:
        return Box(self.x1 - r, self.y1 - r, self.x2 + r, self.y2 + r)

    def clip(self, o: Box) -> Box:
        """The common part; its sides are negative if there is none."""
        return Box(F.greatest(self.x1, o.x1), F.greatest(self.y1, o.y1), F.least(self.x2, o.x2), F.least(self.y2, o.y2))


def distance(a: Box, b: Box) -> Column:
    dx = F.greatest(F.lit(0.0), b.x1 - a.x2, a.x1 - b.x2)
    dy = F.greatest(F.lit(0.0), b.y1 - a.y2, a.y1 - b.y2)
    return F.hypot(dx, dy)


def intersection(a: Box, b: Box) -> Column:
    c = a.clip(b)
    return F.greatest(F.lit(0.0), c.width) * F.greatest(F.lit(0.0), c.height)


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return F.when(a.area + b.area - i > 0, i / (a.area + b.area - i)).otherwise(0.0)


def overlap_min(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    least = F.least(a.area, b.area)
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def fractions(a: Box, b: Box) -> tuple[Column, Column]:
    """Intersection over either area."""
    i = intersection(a, b)
    return F.when(a.area > 0, i / a.area).otherwise(0.0), F.when(b.area > 0, i / b.area).otherwise(0.0)


def axis_deg(a: Box) -> Column:
    """Axis of a box: upright unless it is wider than high."""
    return F.when(a.width > a.height, 0.0).otherwise(90.0)
