"""Project pages: pending sources, latest results, exports, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MODEL = "controlled-v2-stage1"


def pending(sources: DataFrame, results: DataFrame, model_id: str | None = None, calibrated: bool = True) -> DataFrame:
    """Sources (page_id, mm_per_px, demo) that aren't demos, are (or aren't) calibrated and have no result, of one model if given."""
    own = results if model_id is None else results.where(F.coalesce("model_id", F.lit(DEFAULT_MODEL)) == model_id)
    has = F.col("mm_per_px").isNotNull() if calibrated else F.col("mm_per_px").isNull()
    return sources.where(~F.coalesce("demo", F.lit(False)) & has).join(own.select(F.col("source_page_id").alias("page_id")).distinct(), "page_id", "left_anti")


def latest(results: DataFrame) -> DataFrame:
    """The last result of each source, by (ordinal, result_id)."""
    best = F.max_by(F.struct("result_id", "model_id", "ordinal"), F.struct("ordinal", "result_id"))
    return results.groupBy("source_page_id").agg(best.alias("r")).select("source_page_id", "r.result_id", "r.model_id", "r.ordinal")


def run_numbers(results: DataFrame) -> DataFrame:
    """run: 1, 2, ... for the results of a source and model, in their order."""
    w = Window.partitionBy("source_page_id", "model_id").orderBy("ordinal", "result_id")
    return results.withColumn("run", F.row_number().over(w))


def exportable(sources: DataFrame, results: DataFrame) -> DataFrame:
    """page_id and exported: the latest result of a source, else the source itself if it has manual groups (n_groups)."""
    d = sources.join(latest(results).select(F.col("source_page_id").alias("page_id"), "result_id"), "page_id", "left")
    return d.where(F.col("result_id").isNotNull() | (F.col("n_groups") > 0)).select("page_id", F.coalesce("result_id", "page_id").alias("exported"))


def status(sources: DataFrame, results: DataFrame) -> DataFrame:
    """page_id and status: measured, ready or needs_calibration."""
    d = sources.join(results.select(F.col("source_page_id").alias("page_id"), F.lit(True).alias("has")).distinct(), "page_id", "left")
    s = F.when(F.col("has"), "measured").when(F.col("mm_per_px").isNotNull(), "ready").otherwise("needs_calibration")
    return d.select("page_id", s.alias("status"))


def same_size_uncalibrated(sources: DataFrame, reference: DataFrame) -> DataFrame:
    """reference_id and page_id: uncalibrated sources, no demos, of the same width and height as a reference page.

    Pairs grow with the square of a size class; the caller gives few references.
    """
    free = sources.where(~F.coalesce("demo", F.lit(False)) & F.col("mm_per_px").isNull()).select("page_id", "width", "height")
    return reference.select(F.col("page_id").alias("reference_id"), "width", "height").join(free, ["width", "height"]).where("reference_id <> page_id").select("reference_id", "page_id")


def cascade(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """page_id of the chosen pages and of pages whose source is chosen, each once."""
    return chosen.select("page_id").unionByName(pages.join(chosen.select(F.col("page_id").alias("source_page_id")), "source_page_id", "left_semi").select("page_id")).distinct()
