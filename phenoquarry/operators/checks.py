"""Constraint checks: every function returns the rows that break a rule, so an empty result means it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of child whose non-null key isn't in parent."""
    p = parent.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct()
    return child.where(F.coalesce(*[F.col(a) for a in on]).isNotNull()).join(p, list(on), "left_anti")


def partition_faults(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Keys with a fault: missing (in no part), foreign (not in the whole) or repeated (in parts more than once)."""
    tagged = whole.select(F.col(key).alias("key"), F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts:
        tagged = tagged.unionByName(part.select(F.col(key).alias("key"), F.lit(0).alias("w"), F.lit(1).alias("p")))
    counts = tagged.groupBy("key").agg(F.sum("w").alias("w"), F.sum("p").alias("p"))
    fault = F.when(F.col("w") == 0, "foreign").when(F.col("p") == 0, "missing").when(F.col("p") > F.col("w"), "repeated")
    return counts.withColumn("fault", fault).where("fault is not null").select("key", "fault")


def rule_faults(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and faults (names of the rules that don't hold, null counts as not holding) of rows with any."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]))
    return df.select(F.col(key).alias("key"), found.alias("faults")).where(F.size("faults") > 0)


def unit_confidence(c: Column) -> Column:
    return ~F.isnan(c) & (c >= 0) & (c <= 1)


def box_rules() -> dict[str, Column]:
    c = F.col
    return {"ordered_box": (c("x1") < c("x2")) & (c("y1") < c("y2")), "confidence": unit_confidence(c("confidence")), "class": ((c("class_id") == 0) & (c("class_name") == "awn")) | ((c("class_id") == 1) & (c("class_name") == "spikelet"))}


def page_rules() -> dict[str, Column]:
    c = F.col
    return {"size": (c("width") > 0) & (c("height") > 0), "calibration": c("mm_per_px").isNull() | ((c("mm_per_px") > 0) & (c("mm_per_px") < 10))}


def group_rules(width: Column, height: Column) -> dict[str, Column]:
    """For editable groups: name, polygon and line (arrays of x, y)."""
    inside = lambda a: F.forall(a, lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    return {
        "name": F.length(F.trim("name")).between(1, 80), "polygon": (F.size("polygon") >= 3) & inside(F.col("polygon")), "line": (F.size("line") != 1) & inside(F.col("line")),
    }


def observation_limits(megabytes: Column, width: Column, height: Column) -> Column:
    return (megabytes <= 40) & (width * height <= 25_000_000)
