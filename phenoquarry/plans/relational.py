"""The registered relational queries over the derived relations, each with its DuckDB text.

Doubles are rounded to six places on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import angles, identity, polyline, review, text
from ..functions.boxes import Box
from ..operators import checks, cleanup, measures, pairs, seeds, spatial, workflow
from ..policy import STUDIO
from ..sources import tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str, *needs: str):
    """Register fn(*relations) under a name, with SQL that may use the same relations."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fixtures.load(spark, sf_dir, n) for n in needs))
        opening = fixtures.ctes(*needs)
        ORACLE_SQL[name] = f"{opening}, {sql[5:]}" if sql.startswith("with ") else f"{opening} {sql}"
        return fn

    return add


def _r(c, places: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places)


# Tiles and polylines ---------------------------------------------------------------------------------------------------

_STARTS = "list_sort(list_distinct(list_concat(range(0, greatest(1, {c} - 640 + 1), 320), [greatest(0, {c} - 640)])))"


@_query(
    "S1_S2_tile_windows",
    f"""with g as (select page_id, width, height, unnest({_STARTS.format(c='height')}) as y1 from fx_source_pages),
    t as (select page_id, width, height, y1, unnest({_STARTS.format(c='width')}) as x1 from g)
    select page_id, cast(row_number() over (partition by page_id order by y1, x1) - 1 as int) as tile_index, cast(x1 as int) as x1, cast(y1 as int) as y1,
           cast(least(x1 + 640, width) as int) as x2, cast(least(y1 + 640, height) as int) as y2 from t""",
    "fx_source_pages",
)
def _tiles(pages):
    return tiles.tile_windows(pages).select("page_id", *[F.col(c).cast("int").alias(c) for c in ("tile_index", "x1", "y1", "x2", "y2")])


def _path(paths: DataFrame) -> DataFrame:
    """One row for each path, its points in order."""
    return paths.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select("path_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("path"))


_STEP = "with s as (select path_id, seq, x, y, x - lag(x) over w as dx, y - lag(y) over w as dy from fx_paths window w as (partition by path_id order by seq))"


@_query("P1_path_length", f"{_STEP} select path_id, round(coalesce(sum(sqrt(dx*dx + dy*dy)), 0), 6) as length_px from s group by path_id", "fx_paths")
def _p1(paths):
    return _path(paths).select("path_id", _r(polyline.length(F.col("path"))).alias("length_px"))


@_query("P2_calibrated_length", f"{_STEP} select path_id, round(coalesce(sum(sqrt(dx*dx*25.0/(59.0*59.0) + dy*dy*25.0/(61.0*61.0))), 0), 6) as length_mm from s group by path_id", "fx_paths")
def _p2(paths):
    return _path(paths).select("path_id", _r(polyline.calibrated_length(F.col("path"), F.lit(59.0), F.lit(61.0))).alias("length_mm"))


@_query(
    "P3_scalar_length",
    f"{_STEP} select path_id, case when count(*) >= 2 then round(coalesce(sum(sqrt(dx*dx + dy*dy)), 0) * 5.0 / 10.0, 6) end as length_mm from s group by path_id", "fx_paths",
)
def _p3(paths):
    ref = F.array(polyline.point(0, 0), polyline.point(6, 8))
    return _path(paths).select("path_id", _r(polyline.scalar_length(F.col("path"), ref, F.lit(5.0))).alias("length_mm"))


@_query(
    "P4_P5_turn_angles",
    f"""{_STEP}, t as (select path_id, seq, dx, dy, lead(dx) over w as ex, lead(dy) over w as ey from s window w as (partition by path_id order by seq)),
    u as (select path_id, seq, (dx*ex + dy*ey)/(sqrt(dx*dx + dy*dy)*sqrt(ex*ex + ey*ey)) as c from t where dx is not null and ex is not null)
    select path_id, seq, round(degrees(acos(greatest(-1, least(1, c)))), 4) as turn_deg, round(degrees(acos(abs(greatest(-1, least(1, c))))), 4) as axis_deg from u""",
    "fx_paths",
)
def _p4(paths):
    from pyspark.sql import Window

    w = Window.partitionBy("path_id").orderBy("seq")
    d = paths.select("path_id", "seq", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    d = d.select("path_id", "seq", "dx", "dy", F.lead("dx").over(w).alias("ex"), F.lead("dy").over(w).alias("ey")).where("dx is not null and ex is not null")
    v = [F.col(c) for c in ("dx", "dy", "ex", "ey")]
    return d.select("path_id", "seq", _r(angles.directed(*v), 4).alias("turn_deg"), _r(angles.undirected(*v), 4).alias("axis_deg"))


@_query(
    "P7_canonical_points",
    "select path_id, seq, round(0.8*x*0.1 - 0.6*y*0.2, 6) as cx, round(0.6*x*0.1 + 0.8*y*0.2, 6) as cy from fx_paths", "fx_paths",
)
def _p7(paths):
    pts = polyline.to_canonical(F.col("path"), F.lit(0.1), F.lit(0.2), F.degrees(F.acos(F.lit(0.8))))
    d = _path(paths).select("path_id", F.posexplode(pts).alias("i", "p"))
    return d.select("path_id", (F.col("i") + 1).alias("seq"), _r(F.col("p.x")).alias("cx"), _r(F.col("p.y")).alias("cy"))


@_query(
    "P13_principal_axis",
    "select path_id, round(0.5*atan2(2*covar_pop(x, y), var_pop(x) - var_pop(y)), 6) as theta from fx_paths group by path_id having count(*) >= 3", "fx_paths",
)
def _p13(paths):
    return paths.groupBy("path_id").agg(_r(angles.principal_axis(F.col("x"), F.col("y"))).alias("theta"), F.count(F.lit(1)).alias("n")).where("n >= 3").select("path_id", "theta")


@_query(
    "P30_trimmed_length",
    f"{_STEP}, t as (select path_id, count(*) as n, coalesce(sum(sqrt(dx*dx + dy*dy)), 0) as total from s group by path_id) select path_id, round(case when n < 2 then 0 else least(total, 40.5) end, 6) as length_px from t", "fx_paths",
)
def _p30(paths):
    return _path(paths).select("path_id", _r(polyline.length(polyline.trim(F.col("path"), F.lit(40.5)))).alias("length_px"))


@_query(
    "P33_nearest_segment",
    """with s as (select path_id, seq, x as ax, y as ay, lead(x) over w as bx, lead(y) over w as bv from fx_paths window w as (partition by path_id order by seq)),
    t as (select *, greatest(0, least(1, ((3.0 - ax)*(bx - ax) + (50.0 - ay)*(bv - ay)) / ((bx - ax)*(bx - ax) + (bv - ay)*(bv - ay)))) as t from s where bx is not null)
    select path_id, round(min(sqrt((ax + t*(bx - ax) - 3.0)*(ax + t*(bx - ax) - 3.0) + (ay + t*(bv - ay) - 50.0)*(ay + t*(bv - ay) - 50.0))), 6) as distance from t group by path_id""",
    "fx_paths",
)
def _p33(paths):
    d = _path(paths).where(F.size("path") >= 2)
    return d.select("path_id", _r(polyline.nearest_segment(F.col("path"), F.lit(3.0), F.lit(50.0))["distance"]).alias("distance"))


@_query(
    "X7_cumulative_length",
    f"{_STEP} select path_id, seq, round(coalesce(sum(sqrt(dx*dx + dy*dy)) over (partition by path_id order by seq rows unbounded preceding), 0), 6) as at_px from s", "fx_paths",
)
def _x7(paths):
    d = _path(paths).select("path_id", F.posexplode(polyline.cumulative(F.col("path"))).alias("i", "at"))
    return d.select("path_id", (F.col("i") + 1).alias("seq"), _r("at").alias("at_px"))


# Boxes and pairs -------------------------------------------------------------------------------------------------------

_BUFFER = "case when l.class_name = 'awn' then 6.0 else 4.0 end"
_GAP = "sqrt(power(greatest(0, r.x1 - l.x2, l.x1 - r.x2), 2) + power(greatest(0, r.y1 - l.y2, l.y1 - r.y2), 2))"
_CANDIDATES = f"c as (select l.*, r.det_id as b, r.tile_id as rt, r.tx1 as rtx, r.ty1 as rty, r.x1 as rx1, r.y1 as ry1, r.x2 as rx2, r.y2 as ry2 from fx_detections l join fx_detections r on l.page_id = r.page_id and l.class_name = r.class_name and l.det_id < r.det_id where {_GAP} <= {_BUFFER})"


@_query("J1_candidate_pairs", f"with {_CANDIDATES} select page_id, class_name, det_id as a, b from c", "fx_detections")
def _j1(det):
    return pairs.candidate_pairs(det).select("l.page_id", "l.class_name", F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b"))


def _clip(p: str, a: str, lo: str, hi: str) -> str:
    """Overlap of [a1, a2] with [lo, hi] in SQL."""
    return f"greatest(0, least({p}{a}2, {hi}) - greatest({p}{a}1, {lo}))"


_W = {"x": ("greatest(tx1, rtx)", "least(tx1, rtx) + 640"), "y": ("greatest(ty1, rty)", "least(ty1, rty) + 640")}
_FEATURES = f"""f as (select page_id, class_name, det_id as a, b, tile_id = rt as same_tile, case when class_name = 'awn' then 0.28 else 0.30 end as t_iou, case when class_name = 'awn' then 0.62 else 0.65 end as t_over,
    greatest(0, least(x2, rx2) - greatest(x1, rx1)) as iw, greatest(0, least(y2, ry2) - greatest(y1, ry1)) as ih, (x2 - x1)*(y2 - y1) as la, (rx2 - rx1)*(ry2 - ry1) as ra,
    case when class_name = 'awn' then 3.0 else 2.0 end as g, x1, y1, x2, y2, rx1, ry1, rx2, ry2,
    {_W['x'][1]} - {_W['x'][0]} > 0 and {_W['y'][1]} - {_W['y'][0]} > 0 as win,
    {_clip('', 'x', *_W['x'])} * {_clip('', 'y', *_W['y'])} as lw, {_clip('r', 'x', *_W['x'])} * {_clip('r', 'y', *_W['y'])} as rw,
    greatest(0, least(x2, rx2, {_W['x'][1]}) - greatest(x1, rx1, {_W['x'][0]})) * greatest(0, least(y2, ry2, {_W['y'][1]}) - greatest(y1, ry1, {_W['y'][0]})) as lrw,
    abs(case when x2 - x1 > y2 - y1 then 0 else 90 end - case when rx2 - rx1 > ry2 - ry1 then 0 else 90 end) as angle from c),
    h as (select *, iw*ih as inter, greatest(0, least(x2, rx2) - greatest(x1, rx1) + 2*g) * greatest(0, least(y2, ry2) - greatest(y1, ry1) + 2*g) as gi, (x2 - x1 + 2*g)*(y2 - y1 + 2*g) as gl, (rx2 - rx1 + 2*g)*(ry2 - ry1 + 2*g) as gr from f),
    k as (select *, inter/least(la, ra) as om, gi/(gl + gr - gi) as bi, gi/least(gl, gr) as bo, case when win and iw > 0 and ih > 0 then inter/greatest(lw + rw - lrw, 1e-9) else 0 end as si, case when win and iw > 0 and ih > 0 then greatest(iw, ih) else 0 end as ex from h)"""


def _classified(gate: str) -> str:
    cross = lambda s: f"(not same_tile and win and inter >= 8*{s} and om >= 0.45*{s} and si >= 0.35*{s} and ex >= 24*{s})"
    same = "(same_tile and class_name = 'awn' and bo >= 0.75 and angle <= 8)"
    dup = "((bi >= t_iou or bo >= t_over) and (not (same_tile and class_name = 'awn') or (angle <= 1.5 and bo >= 0.94)))"
    near = f"(bi >= t_iou*0.75 or bo >= t_over*0.75 or {cross('0.75')} or {same})"
    return f"""with {_CANDIDATES}, {_FEATURES}, m as (select *, {cross('1')}{gate} as cr, {dup} as du, {near} as ne, {same} as sa from k)
    select page_id, class_name, a, b, case when cr or du then 'strong' when ne then 'ambiguous' else 'distinct' end as status,
    case when cr then 'cross_tile_overlap' when du then 'buffered_duplicate' when ne and sa then 'same_tile_near_duplicate' when ne then 'near_duplicate' when same_tile then 'same_tile_coexistence' else 'geometry_incompatible' end as reason,
    round(greatest(bi/t_iou, bo/t_over, om/0.45, si/0.35), 6) as strength from m"""


@_query("A1_pair_status", _classified(""), "fx_detections")
def _a1(det):
    return pairs.classify(pairs.candidate_pairs(det)).select("page_id", "class_name", "a", "b", "status", "reason", _r("strength").alias("strength"))


@_query("A1_pair_status_studio", _classified(" and (class_name <> 'awn' or angle <= 12)"), "fx_detections")
def _a1s(det):
    return pairs.classify(pairs.candidate_pairs(det, STUDIO), STUDIO).select("page_id", "class_name", "a", "b", "status", "reason", _r("strength").alias("strength"))


@_query("flagship_pair_summary", f"select class_name, status, count(*) as n, round(max(strength), 6) as max_strength from ({_classified('').replace('from fx_detections l', 'from p l').replace('join fx_detections r', 'join p r').replace('with c as', 'with p as (select * from fx_detections where confidence >= 0.25), c as')}) z group by class_name, status", "fx_detections")
def flagship(det):
    """Primary detections, duplicate candidates by grid join, classification, counts."""
    d = pairs.classify(pairs.candidate_pairs(det.where(F.col("confidence") >= 0.25)))
    return d.groupBy("class_name", "status").agg(F.count(F.lit(1)).alias("n"), _r(F.max("strength")).alias("max_strength"))


@_query("F1_confidence_split", "select page_id, class_name, count(*) as n_observed, sum(case when confidence >= 0.25 then 1 else 0 end)::bigint as n_primary from fx_detections where confidence >= 0.05 group by page_id, class_name", "fx_detections")
def _f1(det):
    d = det.where(F.col("confidence") >= 0.05)
    return d.groupBy("page_id", "class_name").agg(F.count(F.lit(1)).alias("n_observed"), F.count_if(F.col("confidence") >= 0.25).alias("n_primary"))


_SPK = "s as (select *, (x2 - x1)*(y2 - y1) as area, (x1 + x2)/2 as cx, (y1 + y2)/2 as cy from fx_detections where class_id = 1)"
_KNN = f"with {_SPK}, n as (select a.page_id, a.det_id, b.det_id as o, b.area as o_area, round(sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.cy - b.cy)*(a.cy - b.cy)), 9) as d from s a join s b on a.page_id = b.page_id and a.det_id <> b.det_id and b.confidence >= 0.5), k as (select *, row_number() over (partition by page_id, det_id order by d, o) as rank from n qualify rank <= 3)"


@_query("J11_nearest_trusted", f"{_KNN} select page_id, det_id as l_id, o as r_id, round(d, 6) as d, cast(rank as int) as rank from k", "fx_detections")
def _j11(det):
    s = det.where("class_id = 1")
    return spatial.nearest(s, s.where("confidence >= 0.5"), 3, ["page_id"], "det_id", "det_id").withColumn("d", _r("d"))


@_query(
    "A11_neighbour_context",
    f"""{_KNN}, m as (select page_id, det_id, count(*) as n, median(o_area) as med, min(d) as near from k group by page_id, det_id)
    select s.page_id, s.det_id, coalesce(n, 0)::bigint as n_neighbours, round(med, 6) as median_area, round(case when n >= 2 then area/med end, 6) as ratio,
    coalesce(n >= 2 and area/med <= 0.3 and near/sqrt(med) >= 3, false) as isolated_small,
    case when coalesce(n, 0) < 2 then 'insufficient_context' when area/med <= 0.2 then 'rejected' else 'keep' end as status from s left join m on s.page_id = m.page_id and s.det_id = m.det_id""",
    "fx_detections",
)
def _a11(det):
    return cleanup.neighbour_context(det.where("class_id = 1")).select("page_id", "det_id", "n_neighbours", _r("median_area").alias("median_area"), _r("ratio").alias("ratio"), "isolated_small", "status")


@_query(
    "F3_border_artifact",
    """select det_id, (x1 <= 2 and y2 - y1 >= x2 - x1) or (960 - x2 <= 2 and y2 - y1 >= x2 - x1) or (y1 <= 2 and x2 - x1 > y2 - y1) or (960 - y2 <= 2 and x2 - x1 > y2 - y1) as border_artifact
    from fx_detections where class_id = 1""",
    "fx_detections",
)
def _f3(det):
    d = det.where("class_id = 1").select("det_id", "x1", "y1", "x2", "y2", F.lit(960.0).alias("page_w"), F.lit(960.0).alias("page_h"))
    return cleanup.border_artifact(d)


_SMALL = """p as (select *, (x2 - x1)*(y2 - y1) as area from fx_detections where class_id = 1),
    g as (select l.page_id, l.det_id as fragment_id, r.det_id as target_id, r.area as ta, round(sqrt(power(greatest(0, r.x1 - l.x2, l.x1 - r.x2), 2) + power(greatest(0, r.y1 - l.y2, l.y1 - r.y2), 2)), 9) as gap
      from p l join p r on l.page_id = r.page_id and l.det_id <> r.det_id where l.area <= 0.6*r.area and sqrt(power(greatest(0, r.x1 - l.x2, l.x1 - r.x2), 2) + power(greatest(0, r.y1 - l.y2, l.y1 - r.y2), 2)) <= 20.0),
    h as (select * from g where target_id not in (select fragment_id from g)), k as (select *, row_number() over (partition by page_id, fragment_id order by gap, ta desc, target_id) as k from h)"""


@_query("J8_fragment_attachment", f"with {_SMALL} select page_id, fragment_id, target_id from k where k = 1", "fx_detections")
def _j8(det):
    from dataclasses import replace

    from ..policy import CORE

    return cleanup.attach_fragments(det.where("class_id = 1"), 0.1, 0.1, replace(CORE, fragment_area_ratio=0.6))


@_query(
    "F2_reject_reasons",
    """with s as (select * from fx_detections where class_id = 1), o as (select s.page_id, s.det_id, max(greatest(0, least(s.x2, a.x2) - greatest(s.x1, a.x1)) * greatest(0, least(s.y2, a.y2) - greatest(s.y1, a.y1)) / ((s.x2 - s.x1)*(s.y2 - s.y1))) as share
      from s join fx_detections a on a.class_id = 0 and a.page_id = s.page_id where a.x1 <= s.x2 and s.x1 <= a.x2 and a.y1 <= s.y2 and s.y1 <= a.y2 group by s.page_id, s.det_id)
    select s.page_id, s.det_id, concat_ws(',', case when (x2 - x1)*(y2 - y1)*0.0025 < 10 then 'too_small' end, case when share >= 0.25 then 'awn_overlap' end) as reasons from s left join o on s.page_id = o.page_id and s.det_id = o.det_id""",
    "fx_detections",
)
def _f2(det):
    from dataclasses import replace

    from ..policy import CORE

    d = cleanup.reject_reasons(det.where("class_id = 1"), det.where("class_id = 0"), 0.05, 0.05, replace(CORE, premerge_awn_overlap=0.25))
    return d.select("page_id", "det_id", F.array_join("reasons", ",").alias("reasons"))


@_query(
    "A14_leave_one_out",
    """with d as (select page_id, det_id, confidence, (x2 - x1)*(y2 - y1) as area from fx_detections where class_id = 0),
    m as (select a.page_id, a.det_id, median(b.area) as m from d a join d b on a.page_id = b.page_id and a.det_id <> b.det_id group by a.page_id, a.det_id)
    select d.page_id, d.det_id, coalesce(confidence < 0.5 and area <= 0.2*m, false) as rejected from d left join m on d.page_id = m.page_id and d.det_id = m.det_id""",
    "fx_detections",
)
def _a14(det):
    return cleanup.leave_one_out(det.where("class_id = 0"))


@_query(
    "A39_scale_probe",
    """select page_id, count(*) as n, round(median(greatest(x2 - x1, y2 - y1)), 6) as median_px, round(median(sqrt((x2 - x1)*(y2 - y1))), 6) as median_geo_px, round(quantile_cont(greatest(x2 - x1, y2 - y1), 0.1), 6) as p10_px,
    round(quantile_cont(greatest(x2 - x1, y2 - y1), 0.9), 6) as p90_px, round(median(greatest(x2 - x1, y2 - y1))/198.08, 6) as ratio from fx_detections where class_id = 1 and confidence >= 0.5 group by page_id""",
    "fx_detections",
)
def _a39(det):
    d = measures.scale_probe(det.where("class_id = 1"))
    return d.select("page_id", "n", *[_r(c).alias(c) for c in ("median_px", "median_geo_px", "p10_px", "p90_px", "ratio")])


@_query(
    "F11_F12_resolution_and_plausibility",
    """with p as (select page_id, count(*) as n, median(greatest(x2 - x1, y2 - y1)) as m from fx_detections where class_id = 1 and confidence >= 0.5 group by page_id)
    select page_id, case when n < 3 then 'unassessed' when m/60 > 2.001 then 'downscale' when m/60 < 0.299 then 'block' when m/60 < 0.499 then 'upscale' else 'pass' end as band,
    case when n >= 3 then case when m*0.15 between 8 and 24 then case when m*0.15 between 10 and 20 then 'typical' else 'unusual' end else 'implausible' end end as plausible from p""",
    "fx_detections",
)
def _f11(det):
    d = measures.scale_probe(det.where("class_id = 1"))
    return d.select("page_id", measures.resolution_band(F.col("n"), F.col("median_px") / 60).alias("band"), measures.plausibility(F.col("n"), F.col("median_px"), F.lit(0.15)).alias("plausible"))


@_query(
    "A15_axis_frame",
    "select page_id, round(0.5*atan2(sum(sin(2*t)), sum(cos(2*t))), 6) as axis, round(case when count(*) > 1 then sqrt(power(sum(sin(2*t)), 2) + power(sum(cos(2*t)), 2))/count(*) else 0 end, 6) as concentration from (select page_id, atan2(y2 - y1, x2 - x1) as t from fx_detections where class_id = 1) z group by page_id",
    "fx_detections",
)
def _a15(det):
    axis, conc = angles.circular_axis(F.col("t"))
    d = det.where("class_id = 1").select("page_id", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("t"))
    return d.groupBy("page_id").agg(_r(axis).alias("axis"), _r(conc).alias("concentration"))


_VOTES = "with v as (select s.page_id, s.det_id, case when (a.y1 + a.y2)/2 < (s.y1 + s.y2)/2 then 1 else -1 end as vote, row_number() over (partition by s.page_id, s.det_id order by round(sqrt(power(greatest(0, a.x1 - s.x2, s.x1 - a.x2), 2) + power(greatest(0, a.y1 - s.y2, s.y1 - a.y2), 2)), 9), a.confidence desc, a.det_id) as k from fx_detections s join fx_detections a on s.class_id = 1 and a.class_id = 0 and s.page_id = a.page_id where sqrt(power(greatest(0, a.x1 - s.x2, s.x1 - a.x2), 2) + power(greatest(0, a.y1 - s.y2, s.y1 - a.y2), 2)) <= 50.0 qualify k = 1)"


@_query("J12_A16_polarity_votes", f"{_VOTES} select page_id, count(*) as n_votes, median(vote) > 0 as flip, round(abs(sum(vote))/count(*), 6) as agreement from v group by page_id", "fx_detections")
def _a16(det):
    from ..functions.boxes import distance

    near = spatial.box_join(det.where("class_id = 1"), det.where("class_id = 0"), 50.0, ["page_id"])
    l, r = (Box(*(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))) for s in "lr")  # noqa: E741
    vote = F.when((r.y1 + r.y2) / 2 < (l.y1 + l.y2) / 2, 1).otherwise(-1)
    key = F.struct(F.round(distance(l, r), 9), -F.col("r.confidence"), F.col("r.det_id"))
    v = near.groupBy(F.col("l.page_id").alias("page_id"), F.col("l.det_id").alias("det_id")).agg(F.min_by(vote, key).alias("vote"))
    return v.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_votes"), (F.median("vote") > 0).alias("flip"), _r(F.abs(F.sum("vote")) / F.count(F.lit(1))).alias("agreement"))


# Seeds, growth scores, review --------------------------------------------------------------------------------------------

_SCORE = "case when mode = 'direct' then 0 else 4 end + least(4, root_distance_mm) + 1.5*projection_distance_mm - 1.5*confidence - 0.1*least(30, length_mm)"
_RANKED = f"with r as (select *, round({_SCORE}, 9) as seed_score, row_number() over (partition by spikelet_id order by round({_SCORE}, 9), length_mm desc, confidence desc, support_id) as rank from fx_seeds)"


@_query("A21_O1_top_seeds", f"{_RANKED} select spikelet_id, support_id, mode, round(seed_score, 6) as seed_score, cast(rank as int) as rank from r where rank <= 4", "fx_seeds")
def _o1(s):
    return seeds.top(s).select("spikelet_id", "support_id", "mode", _r("seed_score").alias("seed_score"), "rank")


@_query(
    "F6_F7_seed_gates",
    """select spikelet_id, support_id, length_mm >= 0.35 and axis_deviation_deg <= 45 and case when mode = 'direct' then root_distance_mm <= 2.8 else projection_distance_mm <= 1.2 end as basic,
    mode = 'direct' and (root_distance_mm <= 1.2 or (root_distance_mm <= 2.8 and confidence >= 0.5)) as anchor from fx_seeds""",
    "fx_seeds",
)
def _f6(s):
    return s.select("spikelet_id", "support_id", seeds.is_basic().alias("basic"), seeds.is_strong_anchor().alias("anchor"))


@_query(
    "O2_group_diverse_seeds",
    f"""{_RANKED}, g as (select *, support_id % 3 as group_id from r), p as (select *, row_number() over (partition by spikelet_id, group_id order by rank) as place from g),
    a as (select spikelet_id, group_id, row_number() over (partition by spikelet_id order by rank) as n from p where place = 1), t as (select p.* from p join a on p.spikelet_id = a.spikelet_id and p.group_id = a.group_id and a.n <= 2),
    s as (select *, row_number() over (partition by spikelet_id order by case when place = 1 then 0 else 1 end, rank) as slot from t) select spikelet_id, group_id, support_id, cast(slot as int) as slot from s where slot <= 2""",
    "fx_seeds",
)
def _o2(s):
    d = seeds.ranked(s).select("spikelet_id", (F.col("support_id") % 3).alias("group_id"), "support_id", "rank")
    return seeds.group_diverse(d, 2).select("spikelet_id", "group_id", "support_id", "slot")


@_query("A20_reserved_owners", "select support_id, min(spikelet_id) as first_owner, count(distinct spikelet_id) as n_owners from fx_seeds group by support_id", "fx_seeds")
def _a20(s):
    return s.groupBy("support_id").agg(F.min("spikelet_id").alias("first_owner"), F.countDistinct("spikelet_id").alias("n_owners"))


@_query(
    "A26_O3_branch_winner",
    """with b as (select spikelet_id, hop % 2 as seed_id, round(sum(extension_mm) + 0.75*count(*) - 0.025*sum(join_angle_deg) - 0.25*sum(distance_mm) - 0.35*min(support_confidence), 6) as branch_score, round(sum(extension_mm), 6) as final_length_mm, round(min(support_confidence), 6) as seed_score from fx_steps group by spikelet_id, hop % 2)
    select spikelet_id, seed_id, branch_score, cast(row_number() over (partition by spikelet_id order by branch_score desc, final_length_mm desc, seed_score, seed_id) as int) as place from b""",
    "fx_steps",
)
def _a26(steps):
    s = [F.sum(c) for c in ("extension_mm", "join_angle_deg", "distance_mm")]
    b = steps.groupBy("spikelet_id", (F.col("hop") % 2).alias("seed_id")).agg(
        _r(seeds.branch_score(s[0], F.count(F.lit(1)), s[1], s[2], F.min("support_confidence"))).alias("branch_score"), _r(s[0]).alias("final_length_mm"), _r(F.min("support_confidence")).alias("seed_score")
    )
    return seeds.winners(b).select("spikelet_id", "seed_id", "branch_score", "place")


@_query(
    "F9_ownership_share",
    "with p as (select *, lead(support_confidence*20) over (partition by spikelet_id order by hop) as other from fx_steps) select spikelet_id, hop, round(abs(support_confidence*20 - other)/greatest(1, abs(support_confidence*20), abs(other)), 6) as gap_rel, round(abs(support_confidence*20 - other)/greatest(1, abs(support_confidence*20), abs(other)), 6) <= 0.05 as may_share from p where other is not null",
    "fx_steps",
)
def _f9(steps):
    from pyspark.sql import Window

    a = F.col("support_confidence") * 20
    d = steps.withColumn("other", F.lead(a).over(Window.partitionBy("spikelet_id").orderBy("hop"))).where("other is not null")
    gap = _r(review.relative_gap(a, F.col("other")))
    return d.select("spikelet_id", "hop", gap.alias("gap_rel"), (gap <= 0.05).alias("may_share"))


@_query(
    "F5_cross_prediction",
    """select spikelet_id, hop, (case when support_confidence < 0.35 then 1 else 0 end + case when distance_mm >= 1.0 then 1 else 0 end + case when join_local_turn_deg >= 18 or join_excess_turn_deg >= 6 then 1 else 0 end >= 2) and hop % 3 <> 0 as rejected from fx_steps""",
    "fx_steps",
)
def _f5(steps):
    d = steps.withColumn("branch_keys", F.array(F.lit("a"), F.lit("b"))).withColumn("support_keys", F.when(F.col("hop") % 3 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("c"))))
    return d.select("spikelet_id", "hop", seeds.cross_prediction().alias("rejected"))


@_query(
    "O11_next_support",
    """with s as (select *, round(join_angle_deg + 0.45*join_local_turn_deg + 0.35*join_excess_turn_deg + 7.5*distance_mm + 0.18*join_local_turn_deg - 2.2*least(extension_mm, 8) - 2*support_confidence, 6) as score from fx_steps where distance_mm <= 2.8),
    k as (select *, row_number() over (partition by spikelet_id order by score, distance_mm, join_angle_deg, extension_mm desc, hop) as k from s) select spikelet_id, hop, score from k where k = 1""",
    "fx_steps",
)
def _o11(steps):
    c = F.col
    score = _r(seeds.support_score(c("distance_mm"), c("join_angle_deg"), c("join_local_turn_deg"), c("join_excess_turn_deg"), c("join_local_turn_deg"), c("extension_mm"), c("support_confidence")))
    d = steps.where("distance_mm <= 2.8").withColumn("score", score)
    best = d.groupBy("spikelet_id").agg(F.min(F.struct("score", "distance_mm", "join_angle_deg", (-c("extension_mm")).alias("e"), "hop")).alias("b"))
    return best.select("spikelet_id", "b.hop", "b.score")


def _records(steps: DataFrame) -> DataFrame:
    """Inspection records from steps: one for each spikelet."""
    fields = ("hop", "support_confidence", "distance_mm", "join_local_turn_deg", "join_excess_turn_deg", "extension_mm")
    return steps.groupBy("spikelet_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))


@_query(
    "F13_review_reasons",
    """select spikelet_id, concat_ws(',', case when spikelet_id % 13 = 0 then 'degraded_orientation' end, case when spikelet_id % 7 = 0 then 'ambiguous_junction' end, case when min(support_confidence) < 0.35 then 'low_support_confidence' end, case when spikelet_id % 5 = 0 then 'ownership_competition' end,
    case when max(distance_mm) >= 1.0 then 'large_fragment_gap' end, case when max(join_local_turn_deg) >= 18 or max(join_excess_turn_deg) >= 6 then 'sharp_join' end, case when count(*) >= 3 then 'long_reconstruction_chain' end,
    case when spikelet_id % 4 = 0 then 'branch_disagreement' end) as reasons from fx_steps group by spikelet_id""",
    "fx_steps",
)
def _f13(steps):
    d, i = _records(steps), F.col("spikelet_id")
    events = F.array(F.struct(F.when(i % 5 == 0, "denied_existing_owner").otherwise("exclusive").alias("result")))
    other = F.array(F.struct(F.lit(9.7).alias("branch_score"), F.when(i % 4 == 0, 6.0).otherwise(10.0).alias("final_length_mm")))
    found = review.reasons(i % 13 == 0, F.when(i % 7 == 0, "ambiguous_junction"), F.lit(None).cast("double"), F.col("steps"), events, F.size("steps"), F.lit(10.0), F.lit(10.0), other)
    return d.select("spikelet_id", F.array_join(found, ",").alias("reasons"))


@_query(
    "F14_X22_review_status",
    """select name_id, case when name_id % 6 < 2 then 'missing' when name_id % 5 = 0 or name_id % 7 = 0 then 'modified' when name_id % 3 = 0 then 'confirmed' when name_id % 2 = 0 then 'needs_review' else 'automatic' end as status,
    case when name_id % 6 < 2 then 'missing' when name_id % 3 = 0 then 'confirmed' when name_id % 5 = 0 or name_id % 7 = 0 then 'modified' else 'automatic' end as legacy from fx_names""",
    "fx_names",
)
def _f14(names):
    i = F.col("name_id")
    args = (i % 6, i % 5 == 0, F.when(i % 7 == 0, "manual"), i % 3 == 0)
    return names.select("name_id", review.effective_status(*args, F.when(i % 2 == 0, "needs_review")).alias("status"), review.legacy_status(*args).alias("legacy"))


@_query(
    "F16_review_severity",
    """with r as (select spikelet_id, min(support_confidence) as c, max(distance_mm) as g, greatest(max(join_local_turn_deg), max(join_excess_turn_deg)) as t, count(*) as n from fx_steps group by spikelet_id),
    w as (select *, case when c < 0.35 then 1 else 0 end as a, case when g >= 1 then 1 else 0 end as b, case when n >= 3 then 1 else 0 end as d from r),
    s as (select spikelet_id, 2.5*a + 3*b + 1.5*d + 0.75*greatest(0, a + b + d - 1) + case when c < 0.2 then 1 else 0 end + case when g >= 2 then 1 else 0 end + case when t >= 25 then 1 else 0 end as score from w)
    select spikelet_id, cast(round(score, 6) as double) as score, case when score >= 7 then 3 when score >= 4 then 2 else 1 end as level from s""",
    "fx_steps",
)
def _f16(steps):
    d = steps.groupBy("spikelet_id").agg(F.min("support_confidence").alias("c"), F.max("distance_mm").alias("g"), F.greatest(F.max("join_local_turn_deg"), F.max("join_excess_turn_deg")).alias("t"), F.count(F.lit(1)).alias("n"))
    codes = F.array_compact(F.array(F.when(F.col("c") < 0.35, "low_support_confidence"), F.when(F.col("g") >= 1, "large_fragment_gap"), F.when(F.col("n") >= 3, "long_reconstruction_chain")))
    score = review.severity(codes, F.col("c"), F.col("g"), F.col("t"))
    return d.select("spikelet_id", _r(score).cast("double").alias("score"), review.severity_level(score).alias("level"))


@_query(
    "F18_O8_confidence_cut",
    """with f as (select spikelet_id, min(case when support_confidence < 0.3 then hop end) as first from fx_steps group by spikelet_id),
    r as (select s.spikelet_id, coalesce(first, 0) as first_rejected, coalesce(sum(case when s.hop >= first then greatest(0, extension_mm) end), 0) as removed from fx_steps s join f on s.spikelet_id = f.spikelet_id group by s.spikelet_id, first)
    select spikelet_id, cast(first_rejected as int) as first_rejected, round(case when removed <= 0 then 100 when 100 - removed/0.1 <= 0 then 0 else 100 - removed/0.1 end, 6) as kept_px from r""",
    "fx_steps",
)
def _f18(steps):
    line = F.array(polyline.point(0, 0), polyline.point(30, 40), polyline.point(60, 80))
    low = F.transform("steps", lambda s: s["support_confidence"] < 0.3)
    d = _records(steps)
    return d.select("spikelet_id", F.array_position(low, True).cast("int").alias("first_rejected"), _r(polyline.length(polyline.confidence_cut(line, F.col("steps"), F.lit(0.3), F.lit(0.1)))).alias("kept_px"))


@_query("O9_best_alternative", "select spikelet_id, max(support_confidence) as best_score, cast(arg_max(hop, support_confidence*1000 - hop/1000.0) as int) as best_hop from fx_steps group by spikelet_id", "fx_steps")
def _o9(steps):
    alt = F.transform("steps", lambda s: F.struct(s["support_confidence"].alias("branch_score"), s["hop"].alias("hop")))
    return _records(steps).select("spikelet_id", review.best_alternative(alt).alias("b")).select("spikelet_id", F.col("b.branch_score").alias("best_score"), F.col("b.hop").alias("best_hop"))


# Project pages -----------------------------------------------------------------------------------------------------------


@_query("J24_pending_sources", "select page_id from fx_source_pages p where not demo and mm_per_px is not null and not exists (select 1 from fx_results r where r.source_page_id = p.page_id and model_id = 'm0')", "fx_source_pages", "fx_results")
def _j24(pages, results):
    return workflow.pending(pages, results, "m0").select("page_id")


@_query("J24_uncalibrated_sources", "select page_id from fx_source_pages p where not demo and mm_per_px is null and not exists (select 1 from fx_results r where r.source_page_id = p.page_id)", "fx_source_pages", "fx_results")
def _j24u(pages, results):
    return workflow.pending(pages, results, calibrated=False).select("page_id")


@_query("J25_same_size_sources", "select r.page_id as reference_id, p.page_id from fx_source_pages r join fx_source_pages p on r.width = p.width and r.height = p.height and r.page_id <> p.page_id where r.page_id in (8, 9) and not p.demo and p.mm_per_px is null", "fx_source_pages")
def _j25(pages):
    return workflow.same_size_uncalibrated(pages, pages.where("page_id in (8, 9)"))


@_query("J26_cascade", "select page_id from fx_source_pages where page_id % 10 = 1 union select result_id from fx_results where source_page_id % 10 = 1 and source_page_id in (select page_id from fx_source_pages)", "fx_source_pages", "fx_results")
def _j26(pages, results):
    chosen = pages.where("page_id % 10 = 1")
    return workflow.cascade(results.select(F.col("result_id").alias("page_id"), "source_page_id"), chosen)


@_query("O5_latest_result", "select source_page_id, result_id, model_id, ordinal from fx_results qualify row_number() over (partition by source_page_id order by ordinal desc, result_id desc) = 1", "fx_results")
def _o5(results):
    return workflow.latest(results)


@_query("O7_run_numbers", "select result_id, source_page_id, model_id, cast(row_number() over (partition by source_page_id, model_id order by ordinal, result_id) as int) as run from fx_results", "fx_results")
def _o7(results):
    return workflow.run_numbers(results).select("result_id", "source_page_id", "model_id", "run")


@_query(
    "O6_exportable_pages",
    "with l as (select source_page_id, result_id from fx_results qualify row_number() over (partition by source_page_id order by ordinal desc, result_id desc) = 1) select page_id, coalesce(result_id, page_id) as exported from fx_source_pages p left join l on l.source_page_id = p.page_id where result_id is not null or page_id % 3 = 1",
    "fx_source_pages", "fx_results",
)
def _o6(pages, results):
    return workflow.exportable(pages.withColumn("n_groups", F.when(F.col("page_id") % 3 == 1, 2).otherwise(0)), results)


@_query("workflow_status", "select page_id, case when page_id in (select source_page_id from fx_results) then 'measured' when mm_per_px is not null then 'ready' else 'needs_calibration' end as status from fx_source_pages", "fx_source_pages", "fx_results")
def _status(pages, results):
    return workflow.status(pages, results)


@_query("F19_rerun_advised", "select page_id, coalesce(abs(mm_per_px - 0.08) > 1e-8, true) as advised from fx_source_pages", "fx_source_pages")
def _f19(pages):
    return pages.select("page_id", measures.rerun_advised(F.col("mm_per_px"), F.lit(0.08)).alias("advised"))


@_query("A42_result_summary", "select model_id, count(*) as n_results, count(distinct source_page_id) as n_sources, max(ordinal) as max_ordinal from fx_results group by model_id", "fx_results")
def _a42(results):
    return results.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_results"), F.countDistinct("source_page_id").alias("n_sources"), F.max("ordinal").alias("max_ordinal"))


@_query(
    "A33_trim_summary",
    "with r as (select case when hop % 3 = 0 then 'too_short' else 'trimmed' end as status, case when hop % 3 = 0 then 0 else extension_mm end as x from fx_steps) select status, count(*) as n, count(case when x > 0 then 1 end) as n_trimmed, round(coalesce(sum(case when x > 0 then x end), 0), 6) as total_mm, round(coalesce(median(case when x > 0 then x end), 0), 6) as median_mm, round(coalesce(quantile_cont(case when x > 0 then x end, 0.95), 0), 6) as p95_mm, round(coalesce(max(case when x > 0 then x end), 0), 6) as max_mm from r group by status",
    "fx_steps",
)
def _a33(steps):
    d = steps.select(F.when(F.col("hop") % 3 == 0, "too_short").otherwise("trimmed").alias("status"), F.when(F.col("hop") % 3 == 0, 0.0).otherwise(F.col("extension_mm")).alias("removed_mm"))
    return measures.trim_summary(d).select("status", "n", "n_trimmed", *[_r(c).alias(c) for c in ("total_mm", "median_mm", "p95_mm", "max_mm")])


# Names, CSV, identities, checks --------------------------------------------------------------------------------------------

_GUARD = """case when regexp_matches(name, '^\\s*[=+@-]') then '''' || name else name end"""


@_query("K7_csv_cells", f"""select name_id, '"' || replace({_GUARD}, '"', '""') || '"' as id_cell, coalesce(printf('%.3f', length_mm), '') as length_cell from fx_names""", "fx_names")
def _k7(names):
    return names.select("name_id", text.quote(F.col("name")).alias("id_cell"), text.fixed3(F.col("length_mm")).alias("length_cell"))


@_query("F20_name_validity", "select name_id, length(trim(name)) between 1 and 80 and count(*) over (partition by name) = 1 as valid from fx_names", "fx_names")
def _f20(names):
    from pyspark.sql import Window

    return names.select("name_id", (F.length(F.trim("name")).between(1, 80) & (F.count(F.lit(1)).over(Window.partitionBy("name")) == 1)).alias("valid"))


@_query("F20_next_name", "with s as (select distinct det_id % 1000 + case when det_id % 1000 >= 500 then 2 else 1 end as n, page_id from fx_detections) select page_id, min(case when n + 1 not in (select n from s t where t.page_id = s.page_id) then n + 1 end) as next_name from (select page_id, n from s union select distinct page_id, 0 from s) s group by page_id", "fx_detections")
def _f20n(det):
    k = F.col("det_id") % 1000
    used = det.select("page_id", (k + F.when(k >= 500, 2).otherwise(1)).alias("n")).distinct()
    base = used.unionByName(used.select("page_id", F.lit(0).cast("long").alias("n")).distinct())
    free = base.select("page_id", (F.col("n") + 1).alias("n")).join(used, ["page_id", "n"], "left_anti")
    return free.groupBy("page_id").agg(F.min("n").alias("next_name"))


@_query("P35_slug", "select name_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from fx_names", "fx_names")
def _p35(names):
    return names.select("name_id", identity.slug(F.col("name")).alias("slug"))


@_query(
    "P35_X4_hypothesis_ids",
    """select page_id, class_name, 'hyp_' || class_name || '_page-' || page_id || '_' || substr(sha256('{"namespace":"instance_hypothesis","payload":{"class_name":"' || class_name || '","evidence_ids":["' || string_agg('e' || det_id, '","' order by 'e' || det_id) || '"],"page_id":"page ' || page_id || '"}}'), 1, 20) as hypothesis_id from fx_detections group by page_id, class_name""",
    "fx_detections",
)
def _hyp(det):
    ids = F.collect_list(F.concat(F.lit("e"), F.col("det_id").cast("string")))
    d = det.groupBy("page_id", "class_name").agg(ids.alias("ids"))
    return d.select("page_id", "class_name", identity.hypothesis_id(F.concat(F.lit("page "), F.col("page_id").cast("string")), F.col("class_name"), F.col("ids")).alias("hypothesis_id"))


@_query(
    "A40_evidence_ids",
    """select det_id, 'ev_' || class_name || '_p' || page_id || '_' || substr(sha256('{"namespace":"detection_evidence","payload":{' || case when det_id % 3 = 0 then '' else '"component_index":' || det_id % 3 || ',' end || '"page_id":"p' || page_id || '","prediction_index":' || det_id || ',"provider":"primary","tile_id":"tile_' || lpad(tile_id::varchar, 4, '0') || '"}}'), 1, 20) as evidence_id from fx_detections""",
    "fx_detections",
)
def _a40(det):
    page, tile = F.concat(F.lit("p"), F.col("page_id").cast("string")), F.concat(F.lit("tile_"), F.lpad(F.col("tile_id").cast("string"), 4, "0"))
    return det.select("det_id", identity.evidence_id(page, F.col("class_name"), F.lit("primary"), tile, F.col("det_id"), F.col("det_id") % 3).alias("evidence_id"))


@_query("U3_partition_faults", "select det_id as key, 'missing' as fault from fx_detections where det_id % 17 = 0 and det_id % 3 <> 0 union all select det_id, 'repeated' from fx_detections where det_id % 3 = 0 and det_id % 5 = 0", "fx_detections")
def _u3(det):
    whole = det.select("det_id")
    return checks.partition_faults(whole, [whole.where("det_id % 3 = 0"), whole.where("(det_id % 3 <> 0 and det_id % 17 <> 0) or (det_id % 3 = 0 and det_id % 5 = 0)")], "det_id")


@_query("C1_J29_orphan_results", "select result_id from fx_results where source_page_id not in (select page_id from fx_source_pages where not demo)", "fx_source_pages", "fx_results")
def _c1(pages, results):
    return checks.orphans(results.select("result_id", "source_page_id"), pages.where("not demo"), {"source_page_id": "page_id"}).select("result_id")


@_query("A41_class_counts", "select page_id, count(*) as n, sum(case when class_id = 0 then 1 else 0 end)::bigint as n_awn, sum(case when class_id = 1 then 1 else 0 end)::bigint as n_spikelet, round(avg(confidence), 6) as mean_confidence from fx_detections group by page_id", "fx_detections")
def _a41(det):
    return det.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_id") == 0).alias("n_awn"), F.count_if(F.col("class_id") == 1).alias("n_spikelet"), _r(F.avg("confidence")).alias("mean_confidence"))


@_query("F4_usable_spikelets", "select page_id, det_id from fx_detections where class_id = 1 and confidence >= 0.5", "fx_detections")
def _f4(det):
    return det.where((F.col("class_id") == 1) & (F.col("confidence") >= 0.5)).select("page_id", "det_id")


@_query("F21_final_predictions", "select det_id, class_name from fx_detections where class_id = 1 or confidence >= 0.5", "fx_detections")
def _f21(det):
    awns, spikelets = det.where("class_id = 0 and confidence >= 0.5"), det.where("class_id = 1")
    return awns.unionByName(spikelets).select("det_id", "class_name")


@_query("U6_key_differences", "select page_id, 'left' as side from fx_source_pages where page_id not in (select source_page_id from fx_results) union all select distinct source_page_id, 'right' from fx_results where source_page_id not in (select page_id from fx_source_pages)", "fx_source_pages", "fx_results")
def _u6(pages, results):
    a, b = pages.select("page_id"), results.select(F.col("source_page_id").alias("page_id"))
    return a.exceptAll(b.distinct()).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
