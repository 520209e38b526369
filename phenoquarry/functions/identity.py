"""Content-derived identities: canonical JSON, its digest and readable prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 20


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def digest(namespace: str, payload: Column) -> Column:
    """First digits of the SHA-256 of {"namespace", "payload"} in canonical JSON.

    payload: a struct of strings, integers and arrays of them whose fields are in alphabetical order, nested ones too.
    Doubles don't belong here: Spark writes small ones with another exponent than Python does.
    """
    whole = F.struct(F.lit(namespace).alias("namespace"), payload.alias("payload"))
    return F.substring(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256), 1, DIGITS)


def content_id(prefix: str, page_id: Column, namespace: str, payload: Column, class_name: Column | None = None) -> Column:
    parts = [F.lit(prefix), *([class_name] if class_name is not None else []), slug(page_id), digest(namespace, payload)]
    return F.concat_ws("_", *parts)


def evidence_payload(page_id: Column, provider: Column, tile: Column, prediction: Column, component: Column) -> Column:
    """The component takes part only where it isn't 0: a struct with it, or one without, as JSON differs."""
    return F.struct(component.alias("component_index"), page_id.alias("page_id"), prediction.alias("prediction_index"), provider.alias("provider"), tile.alias("tile_id"))


def evidence_id(page_id: Column, class_name: Column, provider: Column, tile: Column, prediction: Column, component: Column) -> Column:
    short = F.struct(page_id.alias("page_id"), prediction.alias("prediction_index"), provider.alias("provider"), tile.alias("tile_id"))
    full = evidence_payload(page_id, provider, tile, prediction, component)
    # JSON strings, not structs: the two shapes have no common type.
    body = F.when(component == 0, F.to_json(short)).otherwise(F.to_json(full))
    text = F.concat(F.lit('{"namespace":"detection_evidence","payload":'), body, F.lit("}"))
    return F.concat_ws("_", F.lit("ev"), class_name, slug(page_id), F.substring(F.sha2(text, 256), 1, DIGITS))


def hypothesis_id(page_id: Column, class_name: Column, evidence_ids: Column) -> Column:
    """By membership alone: geometry and order don't matter."""
    payload = F.struct(class_name.alias("class_name"), F.array_sort(evidence_ids).alias("evidence_ids"), page_id.alias("page_id"))
    return content_id("hyp", page_id, "instance_hypothesis", payload, class_name)


def pair_id(page_id: Column, a: Column, b: Column) -> Column:
    payload = F.struct(F.array_sort(F.array(a, b)).alias("evidence_ids"), page_id.alias("page_id"))
    return content_id("pair", page_id, "evidence_pair", payload)


def natural_key(name: Column) -> Column:
    """Sort key under which numbers inside names order by value: every run of digits padded to 12."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 12, "0")).otherwise(r)), "")
