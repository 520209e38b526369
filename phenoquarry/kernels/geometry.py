"""Polygons and polylines as arrays of points."""

from __future__ import annotations

import numpy as np


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def perimeter(ring: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum())


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(q):
        out: list[np.ndarray] = []
        for r in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def rotated_rectangle(points: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Long side, short side and long axis (unit vector) of the smallest rectangle around the points: one hull edge lies on it."""
    h = hull(points)
    if len(h) < 2:
        return 0.0, 0.0, np.array([1.0, 0.0])
    e = np.roll(h, -1, 0) - h
    n = np.hypot(e[:, 0], e[:, 1])
    u = e[n > 0] / n[n > 0][:, None]
    along, across = h @ u.T, h @ np.stack([-u[:, 1], u[:, 0]])
    w, v = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = int(np.argmin(w * v))
    return (float(w[k]), float(v[k]), u[k]) if w[k] >= v[k] else (float(v[k]), float(w[k]), np.array([-u[k][1], u[k][0]]))


def principal_axis(points: np.ndarray) -> np.ndarray:
    """First axis of the points' covariance; (1, 0) if they coincide."""
    c = points - points.mean(0)
    cov = c.T @ c
    if not cov.any():
        return np.array([1.0, 0.0])
    values, vectors = np.linalg.eigh(cov)
    return vectors[:, int(np.argmax(values))]


def contains(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a ring."""
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    a, b = ring, np.roll(ring, -1, 0)
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return ((x < at) & spans).sum(1) % 2 == 1


def to_segments(points: np.ndarray, path: np.ndarray, closed: bool = False) -> np.ndarray:
    """Distance of each point to the nearest segment of a path."""
    a = path if closed else path[:-1]
    if len(path) < 2:
        return np.hypot(*(points - path[0]).T)
    d = (np.roll(path, -1, 0) - path)[: len(a)]
    den = np.maximum((d * d).sum(1), 1e-300)
    rel = points[:, None, :] - a[None]
    t = np.clip((rel * d).sum(2) / den, 0, 1)
    gap = rel - t[:, :, None] * d
    return np.sqrt((gap * gap).sum(2)).min(1)


def covers(ring: np.ndarray, points: np.ndarray, buffer: float) -> np.ndarray:
    """Whether the ring, grown by a buffer, holds the points: inside, or within the buffer of its edge."""
    return contains(ring, points) | (to_segments(points, ring, closed=True) <= buffer)


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, 0) for r in rings])
    return a, b


def _corners(ring: np.ndarray) -> np.ndarray | None:
    """x1, y1, x2, y2 if the ring is an upright box."""
    if len(ring) != 4:
        return None
    lo, hi = ring.min(0), ring.max(0)
    on = (ring == lo) | (ring == hi)
    turns = (ring != np.roll(ring, -1, 0)).sum(1)
    return np.append(lo, hi) if on.all() and (turns == 1).all() else None


def _held(boxes: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which cells between neighbouring x and y are in any box."""
    out = np.zeros((len(y) - 1, len(x) - 1), bool)
    for x1, y1, x2, y2 in boxes:
        out[(y[:-1] >= y1) & (y[1:] <= y2)] |= (x[:-1] >= x1) & (x[1:] <= x2)
    return out


def _area_of_boxes(a: list[np.ndarray], b: list[np.ndarray], mode: str) -> float:
    every = np.array(a + b)
    x, y = np.unique(every[:, [0, 2]]), np.unique(every[:, [1, 3]])
    one, two = _held(a, x, y), _held(b, x, y)
    return float(np.diff(y) @ (one & two if mode == "and" else one | two) @ np.diff(x))


def area_of(rings_a: list[np.ndarray], rings_b: list[np.ndarray] | None = None, mode: str = "and") -> float:
    """Area where a point is in any ring of A and any ring of B (`and`), or in any ring of either (`or`), by slabs.

    Upright boxes are counted on the grid of their own edges. Else, between neighbouring heights of vertices and crossings every edge is straight and none cross, so the width halfway up
    a slab is exact for its trapezia.
    """
    groups = [rings_a, rings_b if rings_b is not None else rings_a]
    groups = [[r for r in g if len(r) >= 3] for g in groups]
    if mode == "and" and not (groups[0] and groups[1]) or not (groups[0] or groups[1]):
        return 0.0
    corners = [[_corners(r) for r in g] for g in groups]
    if all(c is not None for g in corners for c in g):
        return _area_of_boxes(*corners, mode)
    rings = groups[0] + (groups[1] if rings_b is not None else [])
    a, b = _edges(rings)
    ys = [a[:, 1]]
    for i in range(len(a)):  # crossings of edge i with later ones
        d, e = b[i] - a[i], b[i + 1 :] - a[i + 1 :]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        r = a[i + 1 :] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (r[:, 0] * e[:, 1] - r[:, 1] * e[:, 0]) / den, (r[:, 0] * d[1] - r[:, 1] * d[0]) / den
        ok = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.append(a[i, 1] + t[ok] * d[1])
    y = np.unique(np.concatenate(ys))
    total = 0.0
    for lo, hi in zip(y[:-1], y[1:]):
        if hi - lo <= 1e-12:
            continue
        mid = (lo + hi) / 2
        spans = [_union([s for r in g for s in _spans(r, mid)]) for g in groups]
        width = sum(q - p for p, q in (_meet(*spans) if mode == "and" else _union(spans[0] + spans[1])))
        total += width * (hi - lo)
    return float(total)


def _spans(ring: np.ndarray, y: float) -> list[tuple[float, float]]:
    a, b = ring, np.roll(ring, -1, 0)
    k = (a[:, 1] > y) != (b[:, 1] > y)
    x = np.sort(a[k, 0] + (y - a[k, 1]) * (b[k, 0] - a[k, 0]) / (b[k, 1] - a[k, 1]))
    return list(zip(x[::2], x[1::2]))


def _union(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], q))
        else:
            out.append((p, q))
    return out


def _meet(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [(max(p, r), min(q, s)) for p, q in a for r, s in b if min(q, s) > max(p, r)]


def simplify(path: np.ndarray, tolerance: float = 1.0) -> np.ndarray:
    """Points that keep every dropped one within the tolerance of its chord; the ends always stay."""
    if len(path) < 3 or tolerance <= 0:
        return path
    keep, work = {0, len(path) - 1}, [(0, len(path) - 1)]
    while work:
        i, j = work.pop()
        if j - i < 2:
            continue
        gap = to_segments(path[i + 1 : j], path[[i, j]])
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            m = i + 1 + k
            keep.add(m)
            work += [(i, m), (m, j)]
    return path[sorted(keep)]


def shape_metrics(ring: np.ndarray) -> dict[str, float]:
    """Rotated aspect, solidity, extent of the upright box, compactness."""
    s, h = area(ring), hull(ring)
    long, short, _ = rotated_rectangle(ring)
    box = float(np.prod(np.ptp(ring, axis=0)))
    around = perimeter(ring)
    return {
        "aspect": long / short if short > 0 else 0.0, "solidity": s / area(h) if len(h) >= 3 and area(h) > 0 else 0.0,
        "extent": s / box if box > 0 else 0.0, "compactness": 4 * np.pi * s / around**2 if around > 0 else 0.0,
    }
