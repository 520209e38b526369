"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the least of u's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    out = both.join(_minima(both), "u").where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not larger than u, and u itself, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _minima(down)
    out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b: two columns of one orderable type) that isn't the least of its component.

    Each round is written to the shared folder, so lineage stays short. Only a count and a checksum reach the driver.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    while True:
        seal = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seal == was or not seal.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was, last = seal, edges
        edges = materialize(_small_star(_large_star(last)), "edges")
        discard(last)
