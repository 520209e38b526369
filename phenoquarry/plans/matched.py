"""Registered queries of operators/matching.py and of the cleanup decision, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import identity
from ..operators import cleanup, matching
from .relational import _KNN, QUERIES, _query, _r

_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "({p}.x2 - {p}.x1)*({p}.y2 - {p}.y1)"
_A, _B = _AREA.format(p="a"), _AREA.format(p="b")
_TOUCH = "a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2"


@_query(
    "J18_identity_bridge",
    f"""with n as (select page_id, case when det_id % 10 < 5 then det_id else det_id + 1000000000 end as name_id, x1, y1, x2 + 1.0 as x2, y2, det_id from fx_detections where class_id = 1),
    al as (select det_id as alias_id, det_id + 8 as to_id from fx_detections where class_id = 1 and det_id % 16 = 0),
    p as (select a.name_id, b.det_id, round({_IOU}/({_A} + {_B} - {_IOU}), 9) as iou from n a join fx_detections b on b.class_id = 1 and a.page_id = b.page_id and {_TOUCH}),
    k as (select *, row_number() over w as k, coalesce(lead(iou) over w, 0) as next from p window w as (partition by name_id order by iou desc, det_id)),
    g as (select name_id, det_id from k where k = 1 and iou >= 0.9 and iou - next >= 0.1)
    select n.name_id, coalesce(al.to_id, s.det_id, g.det_id) as spikelet_id, case when al.to_id is not null then 'provenance_alias' when s.det_id is not null then 'exact' when g.det_id is not null then 'geometry_crosswalk' else 'unresolved' end as how
    from n left join al on al.alias_id = n.name_id left join fx_detections s on s.class_id = 1 and s.det_id = n.name_id left join g on g.name_id = n.name_id""",
    "fx_detections",
)
def _j18(det):
    s = det.where("class_id = 1")
    names = s.select("page_id", F.when(F.col("det_id") % 10 < 5, F.col("det_id")).otherwise(F.col("det_id") + 1000000000).alias("name_id"), "x1", "y1", (F.col("x2") + 1.0).alias("x2"), "y2")
    aliases = s.where("det_id % 16 = 0").select(F.col("det_id").alias("alias_id"), (F.col("det_id") + 8).alias("spikelet_id"))
    return matching.identity_bridge(names, s, aliases)


@_query(
    "J9_J10_mutual_best",
    f"""with p as (select a.det_id as a, b.det_id as b, {_IOU} as i, {_A} as aa, {_B} as ba from fx_detections a join fx_detections b on a.class_id = 0 and b.class_id = 0 and a.page_id = b.page_id and a.det_id < b.det_id and {_TOUCH}),
    s as (select a, b, round(i/(aa + ba - i) + 0.1*i/least(aa, ba), 9) as s from p where i/(aa + ba - i) >= 0.45 and i/least(aa, ba) >= 0.6),
    t as (select a, b, s from s union all select b, a, s from s), m as (select a, b from t qualify row_number() over (partition by a order by s desc, b) = 1)
    select x.a, x.b from m x join m y on x.a = y.b and x.b = y.a where x.a < x.b""",
    "fx_detections",
)
def _j10(det):
    return matching.mutual_best(det.where("class_id = 0"))


@_query(
    "J2_tile_merge_edges",
    f"""with p as (select a.page_id, a.class_name, a.det_id as a, b.det_id as b, {_IOU} as i, {_A} as aa, {_B} as ba, least(a.x2, b.x2) - greatest(a.x1, b.x1) as w, least(a.y2, b.y2) - greatest(a.y1, b.y1) as h,
      greatest(a.tx1, b.tx1) as sx1, least(a.tx1, b.tx1) + 640 as sx2, greatest(a.ty1, b.ty1) as sy1, least(a.ty1, b.ty1) + 640 as sy2, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2
      from fx_detections a join fx_detections b on a.page_id = b.page_id and a.class_id = b.class_id and a.det_id < b.det_id and a.tile_id <> b.tile_id and {_TOUCH}),
    q as (select *, (least(ax2, sx2) - greatest(ax1, sx1))*(least(ay2, sy2) - greatest(ay1, sy1)) as la, (least(bx2, sx2) - greatest(bx1, sx1))*(least(by2, sy2) - greatest(by1, sy1)) as lb,
      greatest(0, least(ax2, bx2, sx2) - greatest(ax1, bx1, sx1))*greatest(0, least(ay2, by2, sy2) - greatest(ay1, by1, sy1)) as li from p where sx2 > sx1 and sy2 > sy1)
    select page_id, class_name, a, b, round(li/(la + lb - li), 6) as iou, round(i/least(aa, ba), 6) as overlap from q where i >= 8 and i/least(aa, ba) >= 0.45 and la + lb - li > 0 and li/(la + lb - li) >= 0.35 and greatest(w, h) >= 24""",
    "fx_detections",
)
def _j2(det):
    d = matching.tile_merge_edges(det)
    return d.select("page_id", "class_name", "a", "b", _r("iou").alias("iou"), _r("overlap").alias("overlap"))


def _a7(det):
    d = matching.merge_across_tiles(det)
    return d.select("page_id", "class_name", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "confidence")


QUERIES["A7_tile_merge_groups"] = lambda spark, sf_dir: _a7(fixtures.load(spark, sf_dir, "fx_detections"))  # order-dependent: tested against plain Python


@_query(
    "J7_awn_coverage_bounds",
    f"""with p as (select b.page_id, b.det_id, max({_IOU}/({_B})) as lo, least(1, sum({_IOU}/({_B}))) as hi from fx_detections a join fx_detections b on a.class_id = 0 and b.class_id = 1 and a.page_id = b.page_id and {_TOUCH} group by b.page_id, b.det_id)
    select page_id, det_id, true as within from p""",
    "fx_detections",
)
def _j7(det):
    from ..functions.boxes import Box, fractions
    from ..operators.spatial import box_join

    s, a = det.where("class_id = 1"), det.where("class_id = 0")
    near = box_join(s.select("page_id", "det_id", "x1", "y1", "x2", "y2"), a.select("page_id", "x1", "y1", "x2", "y2"), 0.0, ["page_id"])
    one, two = (Box(*(F.col(f"{k}.{c}") for c in ("x1", "y1", "x2", "y2"))) for k in "lr")
    part = fractions(one, two)[0]
    b = near.groupBy(F.col("l.page_id").alias("page_id"), F.col("l.det_id").alias("det_id")).agg(F.max(part).alias("lo"), F.least(F.lit(1.0), F.sum(part)).alias("hi"))
    d = matching.awn_coverage(s, a).join(b, ["page_id", "det_id"])
    return d.select("page_id", "det_id", F.col("share").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9).alias("within"))


_NEAR = "sqrt(power(greatest(0, b.x1 - a.x2, a.x1 - b.x2), 2) + power(greatest(0, b.y1 - a.y2, a.y1 - b.y2), 2))"


@_query("J5_J13_nearest_anchor", f"select a.det_id as awn_id, arg_min(b.det_id, (round({_NEAR}, 9), b.det_id)) as spikelet_id, round(min({_NEAR}), 6) as gap from fx_detections a join fx_detections b on a.class_id = 0 and b.class_id = 1 and a.page_id = b.page_id and {_NEAR} <= 55 group by a.det_id", "fx_detections")
def _j5(det):
    return matching.nearest_anchor(det.where("class_id = 0"), det.where("class_id = 1"), 55.0).select("awn_id", "spikelet_id", _r("gap").alias("gap"))


@_query("J19_hypothesis_confidence", "select page_id*2 + class_id as hypothesis_id, max(confidence) as confidence, string_agg(distinct 't' || tile_id, ',' order by 't' || tile_id) as keys, 1::bigint as missing from fx_detections group by page_id, class_id", "fx_detections")
def _j19(det):
    h = det.groupBy((F.col("page_id") * 2 + F.col("class_id")).alias("hypothesis_id")).agg(F.concat(F.collect_list("det_id"), F.array(F.lit(-1).cast("long"))).alias("members"))
    e = det.withColumn("key", F.concat(F.lit("t"), F.col("tile_id").cast("string")))
    return matching.hypothesis_confidence(h, e).select("hypothesis_id", "confidence", F.array_join("keys", ",").alias("keys"), "missing")


@_query("J21_J23_adapted_records", "select det_id as spikelet_id, case when det_id % 16 = 0 then det_id + 8 else det_id end as product_id from fx_detections where class_id = 1 and (case when det_id % 16 = 0 then det_id + 8 else det_id end) in (select det_id from fx_detections where class_id = 1 and confidence >= 0.5)", "fx_detections")
def _j21(det):
    s = det.where("class_id = 1")
    aliases = s.where("det_id % 16 = 0").select(F.col("det_id").alias("alias_id"), (F.col("det_id") + 8).alias("spikelet_id"))
    return matching.adapt_inspection(s.select(F.col("det_id").alias("spikelet_id")), aliases, s.where("confidence >= 0.5")).select("spikelet_id", "product_id")


@_query("J27_export_rows", "select name_id as uid, case when name_id % 3 = 0 then length_mm end as automatic_mm, case when name_id % 5 = 0 then 'needs_review' else 'automatic' end as status from fx_names", "fx_names")
def _j27(names):
    i = F.col("name_id")
    groups = names.select(i.alias("uid"), F.lit("automatic").alias("status"))
    auto = names.where(i % 3 == 0).select(i.alias("uid"), F.col("length_mm").alias("automatic_mm"))
    return matching.export_rows(groups, auto, names.where(i % 5 == 0).select(i.alias("uid"), F.lit("needs_review").alias("status"))).select("uid", "automatic_mm", "status")


@_query(
    "A12_U5_cleanup_decision",
    f"""{_KNN}, m as (select page_id, det_id, count(*) as n, median(o_area) as med from k group by page_id, det_id),
    d as (select s.page_id, s.det_id, coalesce(n >= 2 and area/med <= 0.2, false) or (x1 <= 2 and y2 - y1 >= x2 - x1) or (960 - x2 <= 2 and y2 - y1 >= x2 - x1) or (y1 <= 2 and x2 - x1 > y2 - y1) or (960 - y2 <= 2 and x2 - x1 > y2 - y1) as bad from s left join m on s.page_id = m.page_id and s.det_id = m.det_id)
    select page_id, case when bad then 'rejected' else 'active' end as decision, count(*) as n from d group by all""",
    "fx_detections",
)
def _a12(det):
    s = det.where("class_id = 1")
    ctx = cleanup.neighbour_context(s).select("page_id", "det_id", "status")
    border = cleanup.border_artifact(s.select("det_id", "x1", "y1", "x2", "y2", F.lit(960.0).alias("page_w"), F.lit(960.0).alias("page_h")))
    d = ctx.join(border, "det_id").select("page_id", F.when((F.col("status") == "rejected") | F.col("border_artifact"), "rejected").otherwise("active").alias("decision"))
    return d.groupBy("page_id", "decision").agg(F.count(F.lit(1)).alias("n"))


@_query("A13_physical_seeds", "select det_id, case when det_id % 7 = 0 then 'unresolved' else 'seeded' end as outcome from fx_detections", "fx_detections")
def _a13(det):
    h = det.select("det_id", F.when(F.col("det_id") % 7 == 0, "ambiguous").otherwise("fused").alias("status"))
    return matching.physical_seeds(h).select("det_id", "outcome")


@_query("A38_mean_period", "select page_id, round(5.0/((width/60.0 + height/41.0)/2), 6) as mm_per_px from fx_source_pages", "fx_source_pages")
def _a38(pages):
    return pages.select("page_id", _r(matching.mean_period_mm(F.col("width") / 60.0, F.col("height") / 41.0)).alias("mm_per_px"))


@_query("X4_pair_ids", "select det_id, 'pair_p_' || substr(sha256('{\"namespace\":\"evidence_pair\",\"payload\":{\"evidence_ids\":[\"e' || least(det_id, 999999) || '\",\"f' || det_id || '\"],\"page_id\":\"p\"}}'), 1, 20) as pair_id from fx_detections where det_id < 999999", "fx_detections")
def _x4(det):
    e, f = (F.concat(F.lit(k), F.col("det_id").cast("string")) for k in "ef")
    return det.where("det_id < 999999").select("det_id", identity.pair_id(F.lit("p"), f, e).alias("pair_id"))


@_query(
    "J3_dedupe_candidates",
    f"""with p as (select a.det_id as a, b.det_id as b, a.tile_id <> b.tile_id as apart, {_IOU} as i, {_A} as aa, {_B} as ba, (a.x2 - a.x1 >= a.y2 - a.y1) = (b.x2 - b.x1 >= b.y2 - b.y1) as along from fx_detections a join fx_detections b on a.page_id = b.page_id and a.class_id = b.class_id and a.det_id < b.det_id and {_TOUCH})
    select a, b, round(i/(aa + ba - i), 6) as iou, round(i/least(aa, ba), 6) as overlap from p where (i/(aa + ba - i) >= 0.45 or i/least(aa, ba) >= 0.62) and (apart or (along and i/least(aa, ba) >= 0.85))""",
    "fx_detections",
)
def _j3(det):
    d = matching.dedupe_candidates(det)
    return d.select("a", "b", _r("iou").alias("iou"), _r("overlap").alias("overlap"))


@_query(
    "J6_compaction_candidates",
    f"""with p as (select a.det_id as a, b.det_id as b, a.confidence as ac, b.confidence as bc, {_IOU} as i, {_A} as aa, {_B} as ba from fx_detections a join fx_detections b on a.page_id = b.page_id and a.class_id = 0 and b.class_id = 0 and a.det_id < b.det_id and {_TOUCH})
    select case when (ac, aa, -a) > (bc, ba, -b) then a else b end as anchor, case when (ac, aa, -a) > (bc, ba, -b) then b else a end as other from p where least(aa, ba) >= 0.92*greatest(aa, ba) and i >= 0.92*greatest(aa, ba)""",
    "fx_detections",
)
def _j6(det):
    return matching.compaction_candidates(det.where("class_id = 0"))


@_query(
    "J14_X5_seed_discovery",
    f"""with g as (select a.page_id, a.det_id as spikelet_id, b.det_id as support_id, case when b.y1 < a.y1 then 'direct' else 'projected' end as mode, round({_NEAR}*0.085, 9) as root, b.confidence, (b.y2 - b.y1)*0.085 as len
      from fx_detections a join fx_detections b on a.class_id = 1 and b.class_id = 0 and a.page_id = b.page_id and {_NEAR} <= 2.8/0.085),
    s as (select *, round(case when mode = 'direct' then 0 else 4 end + least(4, root) + 1.5*root/3 - 1.5*confidence - 0.1*least(30, len), 9) as score from g where len >= 0.35 and case when mode = 'direct' then root <= 2.8 else root/3 <= 1.2 end)
    select page_id, spikelet_id, support_id, mode, round(score, 6) as seed_score from s qualify row_number() over (partition by spikelet_id order by score, len desc, confidence desc, support_id) <= 4""",
    "fx_detections",
)
def _j14(det):
    from .grouped import seeds_of

    return seeds_of(det).select("page_id", "spikelet_id", "support_id", "mode", _r("seed_score").alias("seed_score"))
