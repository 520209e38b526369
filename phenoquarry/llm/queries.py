"""The registered training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, licences, linededup, media, packing, simhash, substring, urltrust, warc
from .oracle import ORACLE_SQL as ORACLE_SQL


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_t(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_t(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_t(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_t(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(_t(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge(_t(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def host_trust_derived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's propagation over a link table derived from pages, which themselves hold no links between hosts."""
    return urltrust.judge_derived(_t(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_media": op4_media,
    "op5_language": op5_language,
    "op6_substrings": op6_substrings,
    "op7_packing": op7_packing,
    "op8_licences": op8_licences,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_trust": op10_url_trust,
    "host_trust_derived_links": host_trust_derived_links,
}
