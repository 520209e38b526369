"""Angles between vectors and circular statistics of axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def _cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    c = (ax * bx + ay * by) / (F.hypot(ax, ay) * F.hypot(bx, by))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def directed(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """0 to 180 degrees; null if either vector is (nearly) zero."""
    ok = (F.hypot(ax, ay) > TINY) & (F.hypot(bx, by) > TINY)
    return F.when(ok, F.degrees(F.acos(_cosine(ax, ay, bx, by))))


def undirected(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """0 to 90 degrees; 90 if either vector is (nearly) zero."""
    ok = (F.hypot(ax, ay) > TINY) & (F.hypot(bx, by) > TINY)
    return F.when(ok, F.degrees(F.acos(F.abs(_cosine(ax, ay, bx, by))))).otherwise(90.0)


def axis_angle(ax: Column, ay: Column, bx: Column, by: Column, is_directed: bool = False) -> Column:
    """Between unit vectors, as directions or as axes."""
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ax * bx + ay * by))
    return F.degrees(F.acos(dot if is_directed else F.abs(dot)))


def circular_axis(theta: Column) -> tuple[Column, Column]:
    """Aggregates: mean axis in radians by doubled angles, and concentration (0 for a single row)."""
    s, c, n = F.sum(F.sin(2 * theta)), F.sum(F.cos(2 * theta)), F.count(theta)
    return 0.5 * F.atan2(s, c), F.when(n > 1, F.hypot(s, c) / n).otherwise(0.0)


def principal_axis(x: Column, y: Column) -> Column:
    """Aggregate: angle in radians of the first principal component of points."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))
