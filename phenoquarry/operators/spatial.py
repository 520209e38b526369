"""Spatial joins of boxes by grid cells: an equi-join on (page, cell), then the exact predicate.

A theta join on distances plans as a nested loop. Here each box is listed in the cells it touches once grown by the pad,
pairs meet in a cell, and the pair is kept only in the cell of its common corner, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, distance

CELL = 128.0


def _cells(b: Box, cell: float) -> Column:
    rng = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    xs, ys = rng(b.x1, b.x2), rng(b.y1, b.y2)
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _listed(df: DataFrame, side: str, keys: list[str], pad: float, cell: float) -> DataFrame:
    cells = _cells(Box.of().grow(pad), cell)
    d = df.select(*[F.col(k) for k in keys], F.struct(*df.columns).alias(side), F.explode(cells).alias("cell"))
    return d.select(*keys, "cell.cx", "cell.cy", side)


def box_join(left: DataFrame, right: DataFrame, max_distance: float, keys: list[str], cell: float = CELL) -> DataFrame:
    """Pairs (l, r: structs of all columns) with equal keys whose boxes (x1, y1, x2, y2) are within max_distance.

    Rows with a null key or corner pair with nothing; repeated rows pair as often as they stand.
    """
    half = max_distance / 2
    a, b = _listed(left, "l", keys, half, cell), _listed(right, "r", keys, half, cell)
    # Spark's estimate knows neither the cells nor the arrays of a row: it would take a large side for one to broadcast.
    pairs = a.join(b.hint("merge"), [*keys, "cx", "cy"])
    la, rb = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")
    # The cell that owns the pair: that of the lower corner of what the grown boxes share.
    corner = [F.floor((F.greatest(p, q) - half) / cell) for p, q in ((la.x1, rb.x1), (la.y1, rb.y1))]
    owns = (F.col("cx") == corner[0]) & (F.col("cy") == corner[1])
    return pairs.where(owns & (distance(la, rb) <= max_distance)).select("l", "r")


def box_self_join(df: DataFrame, max_distance: float, keys: list[str], order: str, cell: float = CELL) -> DataFrame:
    """Each unordered pair once, the row of smaller `order` on the left."""
    return box_join(df, df, max_distance, keys, cell).where(F.col(f"l.{order}") < F.col(f"r.{order}"))


def nearest(left: DataFrame, right: DataFrame, k: int, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """The k right rows nearest by centre for each left row of the same keys (a page): left_id, right_id, d, rank. Not itself.

    A page is a bounded group; both sides are joined on it.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    a = left.select(*keys, F.col(left_id).alias("l_id"), cx.alias("lx"), cy.alias("ly"))
    b = right.select(*keys, F.col(right_id).alias("r_id"), cx.alias("rx"), cy.alias("ry"))
    d = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "l_id").orderBy("d", "r_id")
    out = a.join(b, keys).where("l_id <> r_id").withColumn("d", F.round(d, 9)).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k).select(*keys, "l_id", "r_id", "d", "rank")
