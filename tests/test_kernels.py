"""Geometry, rasters, trajectories and clustering on small literal cases and random ones."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phenoquarry.functions import polyline
from phenoquarry.kernels import crossing, geometry, raster
from phenoquarry.kernels import trajectory as tr
from phenoquarry.operators import clusters, growth, pairs, roots, shapes, spatial
from phenoquarry.policy import STUDIO

BOX = lambda x1, y1, x2, y2: np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], float)


def line(*p):
    return np.array(p, float)


def test_known_path_length(spark):
    path = F.array(polyline.point(0, 0), polyline.point(3, 4), polyline.point(6, 4))
    ref = F.array(polyline.point(0, 0), polyline.point(0, 10))
    r = spark.range(1).select(polyline.length(path).alias("px"), polyline.scalar_length(path, ref, F.lit(5.0)).alias("mm"), polyline.length(F.slice(path, 1, 1)).alias("one")).first()
    assert (r.px, r.mm, r.one) == (8.0, 4.0, 0.0)


def test_trim_and_cut(spark):
    path = F.array(polyline.point(0, 0), polyline.point(3, 4), polyline.point(6, 4))
    r = spark.range(1).select(polyline.trim(path, F.lit(6.0)).alias("a"), polyline.trim(path, F.lit(99.0)).alias("b"), polyline.trim(path, F.lit(0.0)).alias("c")).first()
    assert [(p.x, p.y) for p in r.a] == [(0, 0), (3, 4), (4, 4)]
    assert len(r.b) == 3 and r.c == []


def test_share_margin():
    assert growth.share_gap(7.996, 8.684) > 0.05 >= growth.share_gap(8.0, 8.3)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 12), st.integers(1, 12)), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_area_of_boxes(boxes):
    grid = np.zeros((50, 50), bool)
    for x, y, w, h in boxes:
        grid[y : y + h, x : x + w] = True
    rings = [BOX(x, y, x + w, y + h) for x, y, w, h in boxes]
    assert geometry.area_of(rings, None, "or") == pytest.approx(grid.sum())
    first = np.zeros((50, 50), bool)
    x, y, w, h = boxes[0]
    first[y : y + h, x : x + w] = True
    rest = np.zeros((50, 50), bool)
    for x, y, w, h in boxes[1:]:
        rest[y : y + h, x : x + w] = True
    assert geometry.area_of(rings[:1], rings[1:]) == pytest.approx((first & rest).sum())


def test_crossing_triangles():
    a, b = line((0, 0), (4, 0), (2, 4)), line((0, 3), (4, 3), (2, -1))
    both, either = geometry.area_of([a], [b]), geometry.area_of([a], [b], "or")
    assert both + either == pytest.approx(geometry.area(a) + geometry.area(b))


def test_rotated_rectangle_and_simplify():
    t = np.radians(30)
    r = BOX(0, 0, 10, 2) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
    long, short, u = geometry.rotated_rectangle(r)
    assert (long, short) == (pytest.approx(10), pytest.approx(2)) and abs(u @ [np.cos(t), np.sin(t)]) == pytest.approx(1)
    p = line((0, 0), (5, 0.5), (10, 0), (10, 10))
    s = geometry.simplify(p, 1.0)
    assert len(s) == 3 and np.array_equal(geometry.simplify(s, 1.0), s)


def test_skeleton_of_a_bar_and_a_cross():
    bar = raster.thin(raster.rasterize([BOX(0, 0, 7, 40)])[0])
    assert raster.topology(bar) == (2, 0)
    assert len(raster.diameter_path(bar)) > 30
    cross = raster.thin(np.pad(np.array([[abs(x - 20) < 2 or abs(y - 20) < 2 for x in range(41)] for y in range(41)]), 1))
    assert raster.topology(cross)[0] == 4 and raster.topology(cross)[1] >= 1


def test_turns():
    assert tr.max_turn(line(*[(0, -i) for i in range(12)])) == 0
    bent = line(*[(0, -i) for i in range(7)], *[(i, -6) for i in range(1, 7)])
    assert tr.max_turn(bent) == pytest.approx(90)
    kink = tr.join_turns(line(*[(0, -i / 2) for i in range(12)]), line(*[(i / 2, -5.5) for i in range(1, 12)]))
    smooth = tr.join_turns(line(*[(0, -i / 2) for i in range(12)]), line(*[(0, -6 - i / 2) for i in range(12)]))
    assert kink["join_excess_turn_deg"] > 60 and smooth["join_local_turn_deg"] == pytest.approx(0)


def _support(i, pts, **k):
    p = line(*pts)
    return growth.Support(i, p, p.copy(), k.get("confidence", 0.9), frozenset(k.get("keys", ())), k.get("junctions", []))


def test_growth_joins_aligned_fragments_and_leaves_transverse_ones():
    pool = [_support(1, [(0, -i / 2) for i in range(13)]), _support(2, [(0.1, -6.5 - i / 2) for i in range(13)]), _support(3, [(-3 + i / 2, -7) for i in range(13)])]
    seeds = pd.DataFrame([{"spikelet_id": 9, "support_id": 1, "seed_score": 1.0, "length_mm": 6.0}])
    (row,) = growth.grow_page(pool, seeds, growth.CORE)
    assert row[7] == [1, 2] and row[5] == 1 and row[4] > 12


def test_winner_keeps_its_support_from_later_spikelets():
    pool = [_support(1, [(0, -i / 2) for i in range(13)]), _support(2, [(0.4, -i / 2) for i in range(13)]), _support(3, [(0.2, -6.5 - i / 2) for i in range(13)])]
    seeds = pd.DataFrame([{"spikelet_id": 1, "support_id": 1, "seed_score": 1.0, "length_mm": 6.0}, {"spikelet_id": 2, "support_id": 2, "seed_score": 2.0, "length_mm": 6.0}])
    rows = {r[0]: r for r in growth.grow_page(pool, seeds, growth.CORE)}
    assert rows[1][7] == [1, 3] and rows[2][7] == [2]


def test_sharp_junction_is_clipped():
    up = [(0.0, -i / 2) for i in range(11)]
    turn = [(i / 2, -5.0 - i * 0.2) for i in range(1, 9)]
    s = _support(2, up[6:] + turn, junctions=[{"raw_point": (0.0, -5.0), "off_path_reach_mm": 2.0}])
    current = line(*up[:7])
    r = tr.resolve(current, s.raw, s.path)
    cut = tr.clip_at_junction(current, s.junctions, r)
    assert cut.clipped and cut.stop == "ambiguous_junction" and tuple(cut.raw[-1]) == (0.0, -5.0)
    assert tr.clip_at_junction(current, [], r) is r


def _arms(degrees):
    return [[np.array([np.cos(np.radians(d)), np.sin(np.radians(d))])] * 3 for d in degrees]


@pytest.mark.parametrize(("degrees", "paired"), [((-65, -115, 65, 115), True), ((-87, -93, 87, 93), True), ((-89.5, -90.5, 89.5, 90.5), False)])
def test_crossing_arms(degrees, paired):
    got, reason = crossing.pair_arms(_arms(degrees))
    assert got == ({0: 3, 3: 0, 1: 2, 2: 1} if paired else {}) and reason == ("paired" if paired else "ambiguous_arm_pairing")
    assert crossing.pair_arms(_arms(degrees)[:3])[1] == "not_four_substantial_arms"


@pytest.mark.parametrize(("x", "stops"), [(0.0, True), (8.0, False)])
def test_foreign_body_stops_growth(x, stops):
    pool = [_support(1, [(0, -i / 2) for i in range(9)]), _support(2, [(0, -4.2 - i / 2) for i in range(15)])]
    seeds = pd.DataFrame([{"spikelet_id": 9, "support_id": 1, "seed_score": 1.0, "length_mm": 4.0}])
    bodies = {9: BOX(-1, -2, 1, 2), 5: BOX(x - 0.3, -9, x + 0.3, -8)}
    (row,) = growth.grow_page(pool, seeds, growth.CORE, bodies)
    assert row[6] == ("foreign_spikelet_body" if stops else None)
    assert (min(p["y"] for p in row[9]) > -8) == stops


def test_claims():
    whole, part = ((0, 9), False), ((0, 4), True)
    assert growth.claims_meet(whole, ((20, 30), False)) and not growth.claims_meet(part, ((4, 9), False)) and growth.claims_meet(part, ((3, 9), False))


def test_roots():
    ring = BOX(-20, -40, 20, 40)
    path = line(*[(0, 20 - 4 * i) for i in range(60)])
    status, removed, left = roots.normalize(path, ring, 60, 60)
    assert status == "trimmed_to_stable_spikelet_exit" and removed == pytest.approx((20 + 41) * 5 / 60, abs=0.02)
    assert roots.normalize(path[:2], ring, 60, 60)[0] == "short_path_guard"
    assert roots.normalize(path[:1], ring, 60, 60)[0] == "too_short"
    assert roots.normalize(path + [100, 0], ring, 60, 60)[0] == "root_already_outside"
    assert roots.normalize(line(*[(0, 20 - i) for i in range(61)]), BOX(-20, -200, 20, 200), 10, 10)[0] == "no_stable_exit"


def test_peaks_and_period():
    y = np.cos(2 * np.pi * np.arange(1000) / 59)
    p = shapes.find_peaks(y, 40, 0.5)
    assert np.all(np.diff(p) == 59) and shapes.grid_period(np.array([59.0, 118.0, 59.0, 60.0])) == pytest.approx(59)


def _detections(spark, rows):
    return spark.createDataFrame(rows, "det_id long, page_id long, class_id int, class_name string, tile_id int, confidence double, tx1 double, ty1 double, x1 double, y1 double, x2 double, y2 double")


def test_strong_pair_fuses_and_same_tile_veto(spark):
    a = (1, 0, 1, "spikelet", 0, 0.9, 0.0, 0.0, 0.0, 0.0, 50.0, 100.0)
    b = (2, 0, 1, "spikelet", 1, 0.8, 320.0, 0.0, 2.0, 0.0, 52.0, 100.0)
    c = (3, 0, 1, "spikelet", 0, 0.8, 0.0, 0.0, 40.0, 0.0, 90.0, 100.0)
    det = _detections(spark, [a, b, c])
    out = clusters.reconcile(det, pairs.classify(pairs.candidate_pairs(det))).collect()
    assert {tuple(r.members): r.status for r in out}[(1, 2)] == "fused"
    assert clusters.reconcile(det.limit(0), pairs.classify(pairs.candidate_pairs(det.limit(0)))).count() == 0


@pytest.mark.parametrize("cell", [32.0, 128.0, 1000.0])
def test_grid_join_equals_theta_join(spark, cell):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        x, y = rng.uniform(-300, 300, 2)
        rows.append((i, int(i % 2), 0, "awn", 0, 0.5, 0.0, 0.0, float(x), float(y), float(x + rng.uniform(0, 90)), float(y + rng.uniform(0, 90))))
    det = _detections(spark, rows)
    got = {(r.a, r.b) for r in spatial.box_self_join(det, 6.0, ["page_id"], "det_id", cell).select(F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b")).collect()}
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and np.hypot(max(0, q[8] - p[10], p[8] - q[10]), max(0, q[9] - p[11], p[9] - q[11])) <= 6.0}
    assert got == want and want


def test_partitions_do_not_matter(spark):
    from phenoquarry import fixtures

    det = fixtures.load(spark, "/root/testdata/sf0.001", "fx_detections").where("page_id < 2")
    run = lambda d: sorted((r.class_name, tuple(r.members), r.status) for r in clusters.reconcile(d, pairs.classify(pairs.candidate_pairs(d, STUDIO), STUDIO)).collect())
    assert run(det.repartition(1)) == run(det.repartition(7))


def test_fusion_faults_of_many_groups_at_once():
    """Many groups are judged together as each by itself, and by the geometry of their rings."""
    rng = np.random.default_rng(5)
    at, size = rng.integers(0, 60, (500, 4, 2)), rng.choice([3.0, 10.0, 40.0, 90.0], (500, 4, 2))
    boxes = np.concatenate([at, at + size], -1).astype(float)
    for name in ("awn", "spikelet"):
        got = clusters.fusion_faults_of(boxes, name)
        assert got == [clusters.fusion_faults([clusters.UprightBox(*b) for b in g], name) for g in boxes]
        for g, faults in zip(boxes, got):
            members = [clusters.UprightBox(*b) for b in g]
            rings = [clusters._ring(b) for b in members]
            union = geometry.area_of(rings, None, "or")
            assert ("too_many_components" in faults) == (clusters._parts(members) > 3)
            if name == "awn":
                assert ("width_inflation" in faults) == (clusters._width(rings, union) > 2.8 * max(clusters._width([r], geometry.area(r)) for r in rings))
            else:
                assert ("area_inflation" in faults) == (union > 2.8 * max(map(geometry.area, rings)))
    assert len({tuple(x) for x in clusters.fusion_faults_of(boxes, "awn")}) > 3


def test_rings_of_one_shape_are_thinned_once(monkeypatch):
    """The kernel over a batch, run here: each shape's mask is thinned once, every ring has its own centre line."""
    import pyarrow as pa

    class Table:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    thinned, thin = [], raster.thin
    monkeypatch.setattr(raster, "thin", lambda m: thinned.append(m.shape) or thin(m))
    monkeypatch.setattr(shapes.F, "col", lambda name: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())
    run = shapes.skeleton_supports(Table())
    rings = [BOX(x, y, x + w, y + 30.0) for x, y in ((0, 0), (7, 9), (-40, 3), (1e5, 2e5)) for w in (4.0, 9.0)] + [line((0.5, 0.25), (30.5, 2.25), (9.5, 20.25)), line((0, 0), (1, 1)), None]
    at = [None if r is None else [{"x": x, "y": y} for x, y in r] for r in rings]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    (out,) = run([pa.RecordBatch.from_arrays([pa.array(range(len(rings)), pa.int64()), pa.array(at, kind)], ["id", "ring"])])
    assert len(thinned) == 3
    got = {r["id"]: r for r in out.to_pylist()}
    assert sorted(got) == list(range(9))
    for i, r in got.items():
        mask, origin = raster.rasterize([rings[i]])
        path = raster.diameter_path(thin(mask)) + origin
        path = path[::-1] if path[0][1] < path[-1][1] else path
        assert [(p["x"], p["y"]) for p in r["raw"]] == [tuple(p) for p in path]
        assert (r["endpoints"], r["branches"]) == raster.topology(thin(mask))


def test_thinning_by_table_is_two_pass_thinning():
    def slow(mask):
        m, changed = np.pad(mask, 1), True
        while changed:
            changed = False
            for first in (True, False):
                gone = []
                for y, x in np.argwhere(m):
                    n = [bool(m[y + dy, x + dx]) for dy, dx in raster._AROUND]
                    up, right, down, left = n[::2]
                    kept = (up and right and down) or (right and down and left) if first else (up and right and left) or (up and down and left)
                    if 2 <= sum(n) <= 6 and sum(not n[i] and n[(i + 1) % 8] for i in range(8)) == 1 and not kept:
                        gone.append((y, x))
                for y, x in gone:
                    m[y, x], changed = False, True
        return m[1:-1, 1:-1]

    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = rng.random((9, 14)) < 0.75
        assert (raster.thin(mask) == slow(mask)).all()


def test_peaks_by_brute_force():
    def slow(y, distance, prominence):
        peaks, i = [], 1
        while i < len(y) - 1:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if y[i] > y[i - 1] and j < len(y) - 1 and y[j + 1] < y[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        kept = []
        for k in sorted(peaks, key=lambda k: (-y[k], -k)):
            if all(abs(k - q) >= distance for q in kept):
                kept.append(k)
        left = lambda k: min(y[max((q for q in range(k) if y[q] > y[k]), default=0) : k + 1])
        right = lambda k: min(y[k : min((q for q in range(k, len(y)) if y[q] > y[k]), default=len(y) - 1) + 1])
        return sorted(k for k in kept if y[k] - max(left(k), right(k)) >= prominence)

    rng = np.random.default_rng(6)
    for n in range(200):
        y = rng.integers(0, 5, n).astype(float)
        for distance, prominence in ((1, 0.0), (4, 2.0), (9, 3.0)):
            assert shapes.find_peaks(y, distance, prominence).tolist() == slow(y.tolist(), distance, prominence)


def test_profiles_are_not_shuffled(spark):
    """Calibration brings periods together, not the profiles; an axis without strips or peaks has no period."""
    wave = lambda p: [float(np.cos(2 * np.pi * i / p)) for i in range(600)]
    rows = [(1, "x", k, wave(59 + k % 2)) for k in range(4)] + [(1, "y", 0, wave(61)), (2, "x", 0, [1.0] * 50), (2, "x", 1, None)]
    d = shapes.calibrate(spark.createDataFrame(rows, "page_id long, axis string, strip int, values array<double>"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    got = {r.page_id: tuple(r)[1:] for r in d.collect()}
    assert got == {1: (59.5, 61.0, 10, 9, 1.0, 0.0), 2: (None, None, 0, 0, None, None)}


def test_bodies_far_from_a_path_are_not_asked():
    rng = np.random.default_rng(8)
    rings = {k: BOX(x, y, x + 4, y + 6) for k, (x, y) in enumerate(rng.integers(0, 80, (60, 2)).astype(float))}
    bodies, fewer = growth.Bodies(rings), 0
    for _ in range(200):
        path = np.cumsum(np.vstack([rng.integers(0, 80, 2), rng.normal(0, 1, (12, 2))]), axis=0)
        near = bodies.near(path, 3)
        hits = lambda some: sorted(h for r in some if (h := crossing.entry_arc(path, r)) is not None)
        assert hits(near) == hits([r for k, r in rings.items() if k != 3])
        fewer += len(near) < 20
    assert fewer > 150
    assert growth.Bodies({}).near(path, 3) == []


def test_a_finished_branch_does_not_propose_again(monkeypatch):
    """While a sibling grows, proposals of a branch whose path is the same are kept."""
    asked, propose = [], growth.propose
    monkeypatch.setattr(growth, "propose", lambda b, s, *a: asked.append((b.number, len(b.path), s.id)) or propose(b, s, *a))
    column = lambda x, n: [growth.Support(10 * x + k, p * 10, p, 0.9, frozenset({"t"}), []) for k in range(n) for p in [np.stack([np.full(7, float(x)), -k * 6.5 - np.arange(7.0)], axis=1)]]
    pool = column(0, 6) + column(50, 2)
    seeds = [{"spikelet_id": 0, "support_id": i, "seed_score": 0.0, "length_mm": 6.0} for i in (0, 500)]
    a, b = growth.compete(seeds, pool, {0: 0, 500: 0})
    assert (len(a.steps), len(b.steps)) == (5, 1)
    assert len(asked) == len(set(asked))


def test_box_joins_broadcast_no_side(spark):
    """A side's cells and arrays aren't in Spark's estimate, so its own choice could send a large one to the driver."""
    d = spark.range(10).selectExpr("id", "1L as page_id", "id * 10.0D as x1", "0.0D as y1", "id * 10.0D + 5 as x2", "5.0D as y2")
    plan = spatial.box_self_join(d, 6.0, ["page_id"], "id")
    assert plan.count() == 9
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
