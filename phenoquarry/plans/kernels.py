"""Registered queries of the geometry kernels on shapes with closed forms: rotated, bent, crossed and branched, not only upright boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polyline import point
from ..kernels import crossing, geometry, parts, raster
from ..kernels import trajectory as tr
from ..operators import clusters, growth, shapes, trajectories
from ..operators.parts import batch_kernel, guarded, row_kernel
from .relational import _query, _r



def _turned(x: Column, y: Column, degrees: Column) -> Column:
    a = F.radians(degrees)
    return point(x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a))


def _rectangle(det: DataFrame) -> DataFrame:
    """id, and a ring of 100 or more by 10 turned by a multiple of 15 degrees."""
    w, h, t = 100.0 + F.col("det_id") % 9, F.lit(10.0), F.col("det_id") % 12 * 15
    zero = F.lit(0.0)
    return det.select(F.col("det_id").alias("id"), F.array(*[_turned(x, y, t) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))]).alias("ring"))


_W, _T = "(100.0 + det_id % 9)", "radians((det_id % 12)*15)"


@_query(
    "P18_P28_rotated_shapes",
    f"select det_id as id, round({_W}*10, 4) as area, round(2*({_W} + 10), 4) as perimeter, round({_W}, 4) as long_side, 10.0 as short_side, round({_W}/10, 4) as aspect, 1.0 as solidity, round({_W}*10/((abs({_W}*cos({_T})) + abs(10*sin({_T})))*(abs({_W}*sin({_T})) + abs(10*cos({_T})))), 4) as extent, ((det_id % 12)*15)::double as axis_deg from fx_detections",
    "fx_detections",
)
def _p18(det):
    d = shapes.shape_features(_rectangle(det))
    return d.select("id", *[_r(c, 4).alias(c) for c in ("area", "perimeter", "long_side", "short_side", "aspect", "solidity", "extent")], (_r("axis_deg", 3) % 180).alias("axis_deg"))


@_query("P18_P28_notched_shapes", "select det_id as id, round(0.75*(20 + det_id % 7)*(30 + det_id % 5), 4) as area, round(0.75/0.875, 4) as solidity, 0.75 as extent, round(2*(50 + det_id % 7 + det_id % 5), 4) as perimeter from fx_detections", "fx_detections")
def _notched(det):
    w, h = 20.0 + F.col("det_id") % 7, 30.0 + F.col("det_id") % 5
    zero = F.lit(0.0)
    ring = F.array(*[point(x, y) for x, y in ((zero, zero), (w, zero), (w, h / 2), (w / 2, h / 2), (w / 2, h), (zero, h))])
    d = shapes.shape_features(det.select(F.col("det_id").alias("id"), ring.alias("ring")))
    return d.select("id", *[_r(c, 4).alias(c) for c in ("area", "solidity", "extent", "perimeter")])


def _bent(det: DataFrame) -> DataFrame:
    """id, and a path that runs 20 or more up, then turns by a multiple of 10 degrees for as long."""
    n, a = (20 + F.col("det_id") % 7 * 2).cast("int"), F.radians(F.col("det_id") % 10 * 10)
    up = F.transform(F.sequence(F.lit(0), n), lambda i: point(F.lit(0.0), -i.cast("double")))
    on = F.transform(F.sequence(F.lit(1), n), lambda i: point(i * F.sin(a), -n - i * F.cos(a)))
    return det.select(F.col("det_id").alias("id"), F.concat(up, on).alias("path"))


@_query("P9_P10_P16_P29_bent_paths", "select det_id as id, 2.0*(20 + det_id % 7*2) as length, case when det_id % 10 = 0 then 2 else 3 end as n_simplified, 0.0 as midpoint_x, -(20.0 + det_id % 7*2) as midpoint_y, (det_id % 10*10)::double as max_turn_deg from fx_detections", "fx_detections")
def _p9(det):
    d = trajectories.path_features(_bent(det))
    return d.select("id", _r("length", 4).alias("length"), "n_simplified", (_r("midpoint_x", 4) + 0.0).alias("midpoint_x"), _r("midpoint_y", 4).alias("midpoint_y"), _r("max_turn_deg", 3).alias("max_turn_deg"))


@_query("P17_covariance_axes", "select det_id as id, ((det_id % 12)*15)::double as axis_deg from fx_detections", "fx_detections")
def _p17(det):
    def axis(i, ring):
        u = geometry.principal_axis(ring)
        return i, float(round(np.degrees(np.arctan2(u[1], u[0])) % 180, 3) % 180)

    return row_kernel(_square_based(det), axis, "id long, axis_deg double", ("ring",))


def _square_based(det: DataFrame) -> DataFrame:
    """id, and the vertices of a lens: its ends lie on an axis turned by a multiple of 15 degrees."""
    zero, t = F.lit(0.0), F.col("det_id") % 12 * 15
    return det.select(F.col("det_id").alias("id"), F.array(*[_turned(F.lit(x), F.lit(y), t) for x, y in ((-50.0, 0.0), (0.0, 5.0), (50.0, 0.0), (0.0, -5.0))]).alias("ring"), zero.alias("z")).drop("z")


@_query("P19_endpoint_distances", "select det_id as id, (1 + det_id % 13)::double as gap from fx_detections", "fx_detections")
def _p19(det):
    line = lambda start: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: point(start + i, F.lit(0.0)))
    d = det.select(F.col("det_id").alias("id"), line(F.lit(0.0)).alias("a"), line(11.0 + F.col("det_id") % 13).alias("b"))
    return row_kernel(d, lambda i, a, b: (i, round(parts.endpoint_distance(a, b), 6)), "id long, gap double", ("a", "b"))


@_query("P24_widths_and_parts", "select det_id as id, (1 + det_id % 5)::int as n_parts, round(20.0*(1 + det_id % 5)/(20*(det_id % 5) + 10), 6) as width from fx_detections", "fx_detections")
def _p24(det):
    def measure(i, n):
        boxes = [clusters.UprightBox(20.0 * k, 0.0, 20.0 * k + 10, 2.0) for k in range(n)]
        rings = [clusters._ring(b) for b in boxes]
        return i, clusters._parts(boxes), round(clusters._width(rings, geometry.area_of(rings, None, "or")), 6)

    return row_kernel(det.select(F.col("det_id").alias("id"), (1 + F.col("det_id") % 5).cast("int").alias("n")), measure, "id long, n_parts int, width double")


@_query("A4_fusion_faults", "select det_id as id, concat_ws(',', case when det_id % 6 >= 3 then 'too_many_components' end, case when det_id % 6 >= 2 then 'area_inflation' end) as spikelet, case when det_id % 6 >= 3 then 'too_many_components' else '' end as awn from fx_detections", "fx_detections")
def _a4(det):
    def faults(i, n):
        """Groups of as many boxes as n says, judged at once for each number."""
        spikelet, awn = np.empty(len(i), object), np.empty(len(i), object)
        for k in np.unique(n).tolist():
            at = np.flatnonzero(n == k)
            apart = np.broadcast_to([(20.0 * j, 0.0, 20.0 * j + 10, 2.0) for j in range(k)], (len(at), k, 4))
            for out, name in ((spikelet, "spikelet"), (awn, "awn")):
                out[at] = [",".join(x) for x in clusters.fusion_faults_of(apart, name)]
        return i, spikelet, awn

    return batch_kernel(det.select(F.col("det_id").alias("id"), (1 + F.col("det_id") % 6).cast("int").alias("n")), faults, "id long, spikelet string, awn string")


def _bar(det: DataFrame) -> DataFrame:
    """id, and the ring of a bar one pixel high."""
    w, zero = 5.0 + F.col("det_id") % 20, F.lit(0.0)
    return det.select(F.col("det_id").alias("id"), F.array(point(zero, zero), point(w, zero), point(w, F.lit(1.0)), point(zero, F.lit(1.0))).alias("ring"))


@_query("P26_P27_skeleton_of_bars", "select det_id as id, 2 as endpoints, 0 as branches, (5 + det_id % 20)::int as n_points, (4.0 + det_id % 20) as length_px from fx_detections", "fx_detections")
def _p26(det):
    return shapes.skeleton_supports(_bar(det)).select("id", "endpoints", "branches", F.size("raw").alias("n_points"), "length_px")


@_query("A19_side_arms", "select det_id as id, (10 + det_id % 5)::double as x, 0.0 as y, round((4 + det_id % 6)*0.5, 6) as reach_mm from fx_detections", "fx_detections")
def _a19(det):
    def arms(i, at, reach):
        mask = np.zeros((reach + 3, 32), bool)
        mask[1, 1:31] = True  # the path
        mask[2 : 2 + reach, 1 + at] = True  # its side arm
        path = np.stack([np.arange(30.0), np.zeros(30)], axis=1)
        (where, mm), = parts.side_arms(mask, path, np.array([0.5, 0.5]), np.array([-1, -1]))
        return i, float(where[0]), float(where[1]), round(mm, 6)

    d = det.select(F.col("det_id").alias("id"), (10 + F.col("det_id") % 5).cast("int").alias("at"), (4 + F.col("det_id") % 6).cast("int").alias("reach"))
    return row_kernel(d, arms, "id long, x double, y double, reach_mm double")


@_query("S5_mask_components", "select det_id as id, 3 as n, ((5 + det_id % 4)*6)::int as largest, (3*4)::int as second, 1 as island, (8.0 + det_id % 4) as x2 from fx_detections", "fx_detections")
def _s5(det):
    def found(i, w):
        mask = np.zeros((20, 30))
        mask[2:8, 3 : 3 + w] = 0.9
        mask[12:15, 4:8] = 0.7
        mask[18, 29] = 0.6
        mask[0, 0] = 0.5  # at the threshold: not in
        c = raster.mask_components(mask)
        return i, len(c), len(c[0][1]), len(c[1][1]), len(c[2][1]), c[0][2][2]

    return row_kernel(det.select(F.col("det_id").alias("id"), (5 + F.col("det_id") % 4).cast("int").alias("w")), found, "id long, n int, largest int, second int, island int, x2 double")


@_query("P31_points_at_mm", "select det_id as id, 0.0 as past, round(det_id % 40/2.0, 6) as up from fx_detections where det_id % 10 = 0", "fx_detections")
def _p31(det):
    def place(i, path, d):
        x, y = tr.at_arc(path, tr.arcs(path), d)
        return i, round(float(x), 6) + 0.0, round(float(-y), 6)

    d = _bent(det.where("det_id % 10 = 0")).select("id", "path", (F.col("id") % 40 / 2).alias("d"))
    return row_kernel(d, place, "id long, past double, up double", ("path",))


@_query("P32_distances_in_mm", "select det_id as id, round(0.1*(1 + det_id % 30), 6) as right_mm, round(0.2*(1 + det_id % 30), 6) as below_mm, 0.0 as on_edge from fx_detections", "fx_detections")
def _p32(det):
    def gaps(i, x1, y1, x2, y2):
        scale, ring = np.array([0.1, 0.2]), np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])
        k = 1 + i % 30
        at = np.array([(x2 + k, (y1 + y2) / 2), ((x1 + x2) / 2, y2 + k), (x2, y2)])
        return i, *(round(float(v), 6) for v in geometry.to_segments(at * scale, ring * scale, closed=True))

    return row_kernel(det.select(F.col("det_id").alias("id"), "x1", "y1", "x2", "y2"), gaps, "id long, right_mm double, below_mm double, on_edge double")


@_query("X1_axis_deviation", "select det_id as id, (det_id % 36*5)::double as deviation_deg from fx_detections", "fx_detections")
def _x1(det):
    ring = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 12.0), (0.0, 12.0))])
    a = F.radians(F.col("det_id") % 36 * 5)
    path = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: point(2.0 + i * F.sin(a), -(i * F.cos(a))))
    return row_kernel(det.select(F.col("det_id").alias("id"), path.alias("path"), ring.alias("ring")), lambda i, p, r: (i, round(parts.axis_deviation(p, r), 4)), "id long, deviation_deg double", ("path", "ring"))


@_query("X2_major_axes_mm", "select det_id as id, round(greatest((x2 - x1)*0.1, (y2 - y1)*0.03), 6) as major_mm from fx_detections", "fx_detections")
def _x2(det):
    ring = F.array(*[point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    return row_kernel(det.select(F.col("det_id").alias("id"), ring.alias("ring")), lambda i, r: (i, round(geometry.rotated_rectangle(r * (0.1, 0.03))[0], 6)), "id long, major_mm double", ("ring",))


@_query("X12_local_tangents", "select det_id as id, (det_id % 10*10)::double as turn_deg from fx_detections", "fx_detections")
def _x12(det):
    def turn(i, path):
        far = np.concatenate([path[: len(path) // 2] * 4, path[len(path) // 2] * 4 + (path[len(path) // 2 :] - path[len(path) // 2]) * 4])
        a, b = parts.tangent_near(far, far[0]), parts.tangent_near(far, far[-1])
        return i, round(tr.angle(a, b), 4)

    return row_kernel(_bent(det), turn, "id long, turn_deg double", ("path",))


@_query("A28_arm_pairing", "select det_id as id, case when det_id % 4 = 3 then 'not_four_substantial_arms' when det_id % 40 <= 20 then 'paired' else 'ambiguous_arm_pairing' end as diagnostic from fx_detections", "fx_detections")
def _a28(det):
    def pair(i):
        turns = [0.0, 180.0 + i % 40, 90.0, 270.0][: 3 if i % 4 == 3 else 4]
        arms = [crossing.arm_directions(np.arange(12.0)[:, None] / 2 * [np.cos(np.radians(t)), np.sin(np.radians(t))]) for t in turns]
        return i, crossing.pair_arms(arms)[1]

    return row_kernel(det.select(F.col("det_id").alias("id")), pair, "id long, diagnostic string")


@_query("J16_A28_crossing_routes", "select det_id as id, case when det_id % 5 = 4 then 'reject_ambiguous_crossing' when det_id % 90 between 21 and 69 then 'reject_ambiguous_entry' when det_id % 90 >= 70 then 'reject_wrong_exit' when det_id % 3 = 0 then 'accept_paired_exit' else 'reject_wrong_exit' end as verdict from fx_detections", "fx_detections")
def _j16(det):
    def verdict(i):
        way = lambda t: [np.array([np.cos(np.radians(t)), np.sin(np.radians(t))])] * 3
        arms = [way(0), way(180), way(90), way(270)]
        pairing = {} if i % 5 == 4 else {0: 1, 1: 0, 2: 3, 3: 2}
        # The way comes in along the first arm, off by some degrees, and leaves by the second or the third.
        return i, parts.route([{"arms": arms, "pairing": pairing}], way(180 + i % 90), way(180 if i % 3 == 0 else 90), 20.0, 3.0)

    return row_kernel(det.select(F.col("det_id").alias("id")), verdict, "id long, verdict string")


@_query("A29_junction_clips", "select det_id as id, case when det_id % 10*10 > 55 then 'ambiguous_junction' end as stop, case when det_id % 10*10 > 55 then 21 + det_id % 7*2 else 2*(20 + det_id % 7*2) + 1 end::int as n from fx_detections", "fx_detections")
def _a29(det):
    def clip(i, path):
        n = 20 + i % 7 * 2
        current = np.stack([np.zeros(8), np.arange(8.0, 0.0, -1)], axis=1)
        way = tr.Resolved(path, path, 0, 1.0, 0.0, float(n), 0.0)
        marks = [{"raw_point": tuple(path[n]), "off_path_reach_mm": 2.0}, {"raw_point": tuple(path[3]), "off_path_reach_mm": 0.5}]
        out = tr.clip_at_junction(current, marks, way)
        return i, out.stop, len(out.path)

    return row_kernel(_bent(det), clip, "id long, stop string, n int", ("path",))


@_query("A34_hug_trims", "select det_id as id, (det_id % 60)::double as run_px, det_id % 60 >= 30 as applied, case when det_id % 60 >= 30 then 10 else det_id % 60 + 10 end::int as n from fx_detections", "fx_detections")
def _a34(det):
    def trim(i):
        k = i % 60
        edge = np.stack([np.zeros(k + 1), np.arange(k + 1.0)], axis=1)
        away = np.stack([np.arange(1, 10) * 5.0, np.full(9, float(k))], axis=1)
        ring = np.array([(0.0, -100.0), (-50.0, -100.0), (-50.0, 200.0), (0.0, 200.0)])
        path, run, applied = parts.hug_trim(np.concatenate([edge, away]), ring, 30.0)
        return i, run, applied, len(path)

    return row_kernel(det.select(F.col("det_id").alias("id")), trim, "id long, run_px double, applied boolean, n int")


_LIMITS = (40.0, 30.0, 30.0, 2.0)


@_query("J4_join_scores", "select det_id as id, round(0.42*(1 - (det_id % 50)/40.0) + 0.24 + 0.24 + 0.10*(1 - (det_id % 4)/4.0) + case when det_id % 3 = 0 then 0.08 else 0 end, 6) as score from fx_detections where det_id % 50 between 1 and 40", "fx_detections")
def _j4(det):
    def score(i):
        a = parts.described(np.stack([np.arange(20.0), np.zeros(20)], axis=1), 4.0, 0 if i % 3 == 0 else None)
        b = parts.described(np.stack([19.0 + i % 50 + np.arange(20.0), np.zeros(20)], axis=1), 4.0 * (1 + i % 4 / 4))
        s = parts.best_join(a, b, _LIMITS)
        return i, None if s is None else round(s, 6)

    return row_kernel(det.where("det_id % 50 > 0").select(F.col("det_id").alias("id")), score, "id long, score double").where("score is not null")


@_query("A9_stitched_fragments", "select det_id as id, case when det_id % 60 <= 34 then 1 else 4 end::int as n, case when det_id % 60 <= 34 then 4 else 1 end::int as most from fx_detections where det_id % 60 > 0", "fx_detections")
def _a9(det):
    def groups(i):
        gap = i % 60
        lines = [np.stack([k * (20.0 + gap) + np.arange(21.0), np.zeros(21)], axis=1) for k in range(4)]
        out = parts.stitch([parts.described(p, 4.0) for p in lines], _LIMITS, 0.64)
        return i, len(out), max(map(len, out))

    return row_kernel(det.where("det_id % 60 > 0").select(F.col("det_id").alias("id")), groups, "id long, n int, most int")


@_query("A27_X6_single_branch", "select det_id as id, (1 + det_id % 5)::int as hops, (6.0*(2 + det_id % 5) + 0.5*(1 + det_id % 5)) as length_mm from fx_detections where class_id = 1", "fx_detections")
def _a27(det):
    def grow(i, n):
        pool = []
        for k in range(n):  # supports of 6 mm one above the other, 0.5 mm apart
            p = np.stack([np.zeros(7), -k * 6.5 - np.arange(7.0)], axis=1)
            pool.append(growth.Support(k, p * 10, p, 0.9, frozenset({"t"}), []))
        seed = {"spikelet_id": 0, "support_id": 0, "seed_score": 0.0, "length_mm": 6.0}
        (b,) = growth.compete([seed], pool, {0: 0})
        return i, len(b.steps), round(tr.length(b.path), 6)

    return row_kernel(det.where("class_id = 1").select(F.col("det_id").alias("id"), (2 + F.col("det_id") % 5).cast("int").alias("n")), grow, "id long, hops int, length_mm double")


@_query("F8_bridge_gate", "select det_id as id, det_id % 18*10 <= 60 or (1 + det_id % 4)/5.0 <= 0.35 as passes from fx_detections", "fx_detections")
def _f8(det):
    d = det.select(F.col("det_id").alias("id"), ((1 + F.col("det_id") % 4) / 5).alias("gap"), (F.col("det_id") % 18 * 10).alias("bend"))

    def gate(i, gap, bend):
        path = np.stack([np.zeros(11), -np.arange(11.0)], axis=1)
        link = gap * np.array([np.sin(np.radians(bend)), -np.cos(np.radians(bend))])
        return i, growth.bridge_passes(path, path[-1] + link, gap)

    return row_kernel(d, gate, "id long, passes boolean")


@_query("X8_X9_branch_traces", "select spikelet_id, count(*) as n_hops, sum(case when support_confidence < 0.35 then 1 else 0 end)::bigint as n_weak, round(max(join_local_turn_deg), 6) as worst_turn from fx_steps group by spikelet_id", "fx_steps")
def _x8(steps):
    """Traces as JSON, one for each spikelet, read back."""
    view = F.struct("hop", _r("support_confidence").alias("confidence"), _r("distance_mm").alias("distance_mm"), _r("join_local_turn_deg").alias("turn_deg"))
    d = steps.groupBy("spikelet_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(view)).alias("steps"))).alias("trace"))
    t = F.from_json("trace", "steps array<struct<hop:int,confidence:double,distance_mm:double,turn_deg:double>>")["steps"]
    return d.select("spikelet_id", F.size(t).cast("long").alias("n_hops"), F.size(F.filter(t, lambda s: s["confidence"] < 0.35)).cast("long").alias("n_weak"), F.array_max(F.transform(t, lambda s: s["turn_deg"])).alias("worst_turn"))


@_query("P44_support_options", "select det_id as id, case when det_id % 4 <= 1 and det_id % 20 < 10 then 'source' else 'fused' end as origin, case when det_id % 4 <= 1 and det_id % 20 < 10 then det_id % 20 else 10 end::double as angle from fx_detections", "fx_detections")
def _p44(det):
    def choose(i):
        way = lambda end, turn: tr.Resolved(*[np.array([(0.0, 0.0), (0.0, end)])] * 2, 0, 1.0, float(turn), -end, 0.0)
        origin, best = tr.choose(way(-6.0, 10), [("e1", way(-6.0 + i % 4, i % 20))])
        return i, origin, best.angle

    return row_kernel(det.select(F.col("det_id").alias("id")), choose, "id long, origin string, angle double")


@_query("X25_guarded_pages", "select det_id as id, case when det_id % 7 <> 0 then 1.0/(det_id % 7) end as value, det_id % 7 <> 0 as ok, case when det_id % 7 = 0 then 'ZeroDivisionError' end as error from fx_detections", "fx_detections")
def _x25(det):
    out = row_kernel(det.select(F.col("det_id").alias("id")), guarded(lambda i: (i, 1.0 / (i % 7)), 2), "id long, value double, ok boolean, error string")
    return out.withColumn("error", F.regexp_extract("error", "^([A-Za-z]+)", 1)).withColumn("error", F.when(~F.col("ok"), F.col("error")))


# Scenes with known outcomes: each spikelet stands 100 mm from the next one on its page ---------------------------------


_XY = "array<struct<x:double,y:double>>"
_NO_JUNCTIONS = "array<struct<raw_point:struct<x:double,y:double>,off_path_reach_mm:double>>"


def _spikelets(det: DataFrame) -> DataFrame:
    return det.where("class_id = 1").select("page_id", F.col("det_id").alias("spikelet_id"), (F.col("det_id") % 200 * 100.0).alias("at"), F.col("det_id").alias("k"))


def _chains(det: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supports of 6 mm one above the other, 0.5 mm apart, two to four for a spikelet; the lowest is its seed."""
    s = _spikelets(det)
    each = s.select("*", F.explode(F.sequence(F.lit(0), (1 + F.col("k") % 3).cast("int"))).alias("n"))
    path = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: point(F.col("at"), -(F.col("n") * 6.5) - i))
    supports = each.select("page_id", (F.col("k") * 10 + F.col("n")).alias("support_id"), path.alias("path"), F.lit(0.9).alias("confidence"), F.array(F.lit("t")).alias("prediction_keys"), F.array().cast(_NO_JUNCTIONS).alias("junctions"))
    supports = supports.withColumn("raw", F.transform("path", lambda p: point(p["x"] * 10, p["y"] * 10)))
    return supports, s.select("page_id", "spikelet_id", (F.col("k") * 10).alias("support_id"), F.lit(0.0).alias("seed_score"), F.lit(6.0).alias("length_mm"))


_HOPS = "(1 + det_id % 3)"


@_query("A23_A24_A25_chains", f"select det_id as spikelet_id, {_HOPS}::int as growth_hops, round(6.0*({_HOPS} + 1) + 0.5*{_HOPS}, 6) as length_mm, round(6.0*({_HOPS} + 1) + 0.5*{_HOPS} + 0.625*{_HOPS}, 6) as branch_score, {_HOPS}::int + 1 as n_supports from fx_detections where class_id = 1", "fx_detections")
def _chained(det):
    d = growth.grow(*_chains(det)).where("place = 1")
    return d.select("spikelet_id", "growth_hops", _r("length_mm_internal").alias("length_mm"), _r("branch_score").alias("branch_score"), F.size("support_ids").alias("n_supports"))


@_query("A30_chain_summary", f"select page_id, count(*) as n, sum({_HOPS})::bigint as hops, round(sum(6.0*({_HOPS} + 1) + 0.5*{_HOPS}), 4) as length_mm from fx_detections where class_id = 1 group by page_id", "fx_detections")
def _chain_summary(det):
    d = growth.grow(*_chains(det)).where("place = 1")
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("growth_hops").alias("hops"), _r(F.sum("length_mm_internal"), 4).alias("length_mm"))


@_query("J17_bodies_in_the_way", f"select det_id as spikelet_id, case when det_id % 2 = 0 then 1 else {_HOPS} end::int as growth_hops, case when det_id % 2 = 0 then 7.5 else round(6.0*({_HOPS} + 1) + 0.5*{_HOPS}, 6) end as length_mm, case when det_id % 2 = 0 then 'foreign_spikelet_body' end as stop from fx_detections where class_id = 1", "fx_detections")
def _in_the_way(det):
    at = F.col("at")
    ring = F.array(*[point(at + x, F.lit(y)) for x, y in ((-1.0, -9.0), (1.0, -9.0), (1.0, -8.0), (-1.0, -8.0))])
    bodies = _spikelets(det).where("k % 2 = 0").select("page_id", (F.col("k") + 1000000000).alias("spikelet_id"), ring.alias("ring"))
    d = growth.grow(*_chains(det), bodies=bodies).where("place = 1")
    return d.select("spikelet_id", "growth_hops", _r("length_mm_internal").alias("length_mm"), "stop")


@_query("A22_F6_grouped_starts", "select det_id as spikelet_id, 3 + det_id % 2 as n, 2::bigint as n_groups, 2 + det_id % 2*2 as n_selectable from fx_detections where class_id = 1", "fx_detections")
def _starts(det):
    s = _spikelets(det).select("*", F.explode(F.sequence(F.lit(0), (2 + F.col("k") % 2).cast("int"))).alias("n"))
    far = F.col("n") >= 2
    x = F.col("at") + F.when(far, 5.0).otherwise(0.0) + F.col("n") % 2 * 0.1
    path = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: point(x, -i.cast("double")))
    d = s.select("spikelet_id", (F.col("k") * 10 + F.col("n")).alias("support_id"), F.when(far, "projected").otherwise("direct").alias("mode"), F.when(far, 3.0).otherwise(1.0).alias("root_distance_mm"), F.lit(0.4).alias("confidence"), path.alias("path"))
    return clusters.group_seeds(d).groupBy("spikelet_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("n_groups"), F.count_if("selectable").alias("n_selectable"))


@_query("A2_A3_A5_twins", "select page_id, count(*) as n_fused, count(*) as n_single, round(sum(1100.0), 4) as fused_area from fx_detections where class_id = 1 group by page_id", "fx_detections")
def _twins(det):
    """For each spikelet an awn that two tiles saw one pixel apart, and one that stands alone."""
    from ..operators import pairs

    s = _spikelets(det).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    x = F.col("at") + F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(40.0)), F.col("n") + 1)
    d = s.select("page_id", F.lit(0).alias("class_id"), F.lit("awn").alias("class_name"), (F.col("k") * 10 + F.col("n")).alias("det_id"), F.col("n").alias("tile_id"), F.lit(0.8).alias("confidence"),
                 (F.col("at") - 100).alias("tx1"), F.lit(-100.0).alias("ty1"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 10).alias("x2"), F.lit(100.0).alias("y2"))
    out = clusters.reconcile(d, pairs.classify(pairs.candidate_pairs(d)))
    fused = F.col("status") == "fused"
    return out.groupBy("page_id").agg(F.count_if(fused & (F.size("members") == 2)).alias("n_fused"), F.count_if(F.col("status") == "singleton").alias("n_single"), _r(F.sum(F.when(fused, F.col("area"))), 4).alias("fused_area"))


@_query("P42_P43_J15_straight_continuations", "select det_id as id, 0 as entry, det_id % 2 = 1 as reversed, (1 + det_id % 5)/4.0 as distance, 0.0 as angle, 7 + (1 + det_id % 5)/4.0 as extension, 0.0 as internal_turn from fx_detections", "fx_detections")
def _straight(det):
    k = F.col("det_id")
    line = lambda lo, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(F.lit(0.0), lo - i))
    on = line(-10.0 - (1 + k % 5) / 4, 7)
    d = trajectories.resolve_pairs(det.select(k.alias("id"), line(F.lit(0.0), 10).alias("current"), F.when(k % 2 == 1, F.reverse(on)).otherwise(on).alias("support")))
    return d.select("id", "entry", "reversed", *[(_r(c, 4) + 0.0).alias(c) for c in ("distance", "angle", "extension", "internal_turn")])


@_query("A32_straight_roots", "select det_id as spikelet_id, 'trimmed_to_stable_spikelet_exit' as status, round((10 + det_id % 7 + 1)*0.1, 4) as removed_mm, round(20 - (10 + det_id % 7 + 1)*0.1, 4) as length_mm from fx_detections where class_id = 1", "fx_detections")
def _straight_roots(det):
    """Paths of 20 mm that start inside a spikelet, 10 pixels or more below its top (a pixel is 0.1 mm, the tolerance one pixel)."""
    from ..operators import roots

    s, at = _spikelets(det), F.col("at")
    ring = F.array(*[point(at + x, F.lit(0.0) + y) for x, y in ((-20.0, -10.0 - F.col("k") % 7), (20.0, -10.0 - F.col("k") % 7), (20.0, F.lit(40.0)), (-20.0, F.lit(40.0)))])
    path = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: point(at, -10.0 * i))
    d = roots.normalize_roots(s.select("page_id", "spikelet_id", path.alias("raw_path"), ring.alias("ring"), F.lit(50.0).alias("x_period"), F.lit(50.0).alias("y_period")))
    return d.select("spikelet_id", "status", _r("removed_mm", 4).alias("removed_mm"), _r("length_mm_root_normalized", 4).alias("length_mm"))


@_query("O4_grid_order", "select page_id, det_id, cast(row_number() over (partition by page_id order by floor((det_id % 200)/40), (det_id % 40)*7 % 40, det_id) as int) as position from fx_detections", "fx_detections")
def _grid_order(det):
    """Boxes of one size on a grid, row by row; within a row their places are shuffled."""
    k = F.col("det_id")
    x, y = (k % 40 * 7 % 40) * 50.0, F.floor(k % 200 / 40) * 100.0 + k % 3
    return shapes.reading_order(det.select("page_id", "det_id", x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 30).alias("y2")))
