"""Review triage: reasons from growth diagnostics, effective status, severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason codes, in report order, with their labels.
REASON_LABELS = {
    "degraded_orientation": "Direction was defaulted from limited orientation evidence",
    "low_support_confidence": "Low-confidence evidence contributes to the final awn",
    "ownership_competition": "Awn evidence was contested between competing branches",
    "large_fragment_gap": "The final awn crosses an unusually large reconstructed gap",
    "sharp_join": "A reconstructed join is close to the geometric acceptance limit",
    "long_reconstruction_chain": "The final awn required several fragment-growth hops",
    "branch_disagreement": "Competing branches have similar scores but materially different lengths",
    "crossing_continuation_unresolved": "The awn continuation at a crossing requires review",
    "foreign_spikelet_body": "Growth stopped before entering another spikelet",
    "ambiguous_junction": "Growth stopped at an ambiguous branch",
}
# Severity weights; other reasons weigh 1.
REASON_WEIGHTS = {"branch_disagreement": 4.0, "large_fragment_gap": 3.0, "sharp_join": 3.0, "low_support_confidence": 2.5, "ownership_competition": 2.5, "long_reconstruction_chain": 1.5, "degraded_orientation": 1.0}
STATUS_LABELS = {"automatic": "High confidence", "needs_review": "Review suggested", "missing": "Missing", "modified": "Edited", "confirmed": "Verified"}


def relative_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def may_share(a: Column, b: Column, margin: float = 0.05) -> Column:
    """Scores near enough for two branches to share a support."""
    return relative_gap(a, b) <= margin


def best_alternative(alternatives: Column) -> Column:
    """The alternative of highest branch_score, the first among equals; a null score is below all."""
    scores = F.transform(alternatives, lambda a: F.coalesce(a["branch_score"], F.lit(float("-inf"))))
    return F.when(F.size(alternatives) > 0, F.element_at(alternatives, F.array_position(scores, F.array_max(scores)).cast("int")))


def reasons(degraded: Column, stop_reason: Column, seed_confidence: Column, steps: Column, events: Column, hops: Column, score: Column, length_mm: Column, alternatives: Column) -> Column:
    """Reason codes in report order, each once.

    steps: array of structs with support_confidence, distance_mm, join_local_turn_deg, join_excess_turn_deg; events: array
    of structs with result; alternatives: array of structs with branch_score, final_length_mm. Null values count as absent.
    """
    worst = lambda name: F.coalesce(F.array_max(F.transform(steps, lambda s: s[name])), F.lit(0.0))
    low = F.least(seed_confidence, F.array_min(F.transform(steps, lambda s: s["support_confidence"])))
    contested = F.exists(events, lambda e: (e["result"] == "shared") | e["result"].startswith("denied"))
    other = best_alternative(alternatives)
    disagree = (relative_gap(score, other["branch_score"]) <= 0.05) & (relative_gap(length_mm, other["final_length_mm"]) >= 0.15) & (F.abs(length_mm - other["final_length_mm"]) >= 2.0)
    found = [
        (degraded, F.lit("degraded_orientation")),
        (stop_reason.isin(*REASON_LABELS), stop_reason),
        (low < 0.35, F.lit("low_support_confidence")),
        (contested, F.lit("ownership_competition")),
        (worst("distance_mm") >= 1.0, F.lit("large_fragment_gap")),
        ((worst("join_local_turn_deg") >= 18) | (worst("join_excess_turn_deg") >= 6), F.lit("sharp_join")),
        (F.coalesce(hops, F.size(steps)) >= 3, F.lit("long_reconstruction_chain")),
        (disagree, F.lit("branch_disagreement")),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, code) for c, code in found])))


def effective_status(points: Column, modified: Column, origin: Column, confirmed: Column, auto_status: Column) -> Column:
    """missing, modified, confirmed, needs_review, automatic: the first that holds. points: how many the line has."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.coalesce(points, F.lit(0)) < 2, "missing")
        .when(yes(modified) | yes(origin == "manual"), "modified")
        .when(yes(confirmed), "confirmed")
        .when(yes(auto_status == "needs_review"), "needs_review")
        .otherwise("automatic")
    )


def legacy_status(points: Column, modified: Column, origin: Column, confirmed: Column) -> Column:
    """The older order: missing, confirmed, modified, automatic."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(points, F.lit(0)) < 2, "missing").when(yes(confirmed), "confirmed").when(yes(modified) | yes(origin == "manual"), "modified").otherwise("automatic")


def severity(codes: Column, min_confidence: Column, max_gap: Column, max_turn: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in REASON_WEIGHTS.items() for x in kv])
    base = F.aggregate(codes, F.lit(0.0), lambda a, r: a + F.coalesce(F.try_element_at(weights, r), F.lit(1.0)))
    more = F.when(F.size(codes) > 1, (F.size(codes) - 1) * 0.75).otherwise(0.0)
    bump = lambda c: F.when(c, 1.0).otherwise(0.0)
    return base + more + bump(min_confidence < 0.2) + bump(max_gap >= 2) + bump(max_turn >= 25)


def severity_level(score: Column) -> Column:
    return F.when(score >= 7, 3).when(score >= 4, 2).otherwise(1)


def labels(codes: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in REASON_LABELS.items() for x in kv])
    return F.transform(codes, lambda r: F.coalesce(F.try_element_at(names, r), r))
