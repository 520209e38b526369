"""Overlapping tiles of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(length: Column, size: int, stride: int) -> Column:
    """Start positions: steps of stride that leave a whole tile, and the last whole tile; 0 alone for a short side."""
    if not 0 < stride <= size:
        raise ValueError("stride must be positive and not above size")
    last = F.greatest(length - size, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last.cast("int"), F.lit(stride)), F.array(last.cast("int")))))


def tile_windows(pages: DataFrame, size: int = 640, stride: int = 320) -> DataFrame:
    """page_id, tile_index (row by row) and the window x1, y1, x2, y2, cut at the page's edge."""
    ys, xs = starts(F.col("height"), size, stride), starts(F.col("width"), size, stride)
    every = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    d = pages.select("page_id", "width", "height", F.posexplode(every).alias("tile_index", "t"))
    return d.select("page_id", "tile_index", F.col("t.x").alias("x1"), F.col("t.y").alias("y1"), F.least(F.col("t.x") + size, F.col("width")).alias("x2"), F.least(F.col("t.y") + size, F.col("height")).alias("y2"))
