"""Masks: rasterising, thinning, skeleton graphs, diameter paths, connected components."""

from __future__ import annotations

import heapq

import numpy as np

from .geometry import contains

_AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
MAX_PIXELS = 4_000_000


def rasterize(rings: list[np.ndarray]) -> tuple[np.ndarray, tuple[int, int]]:
    """Mask of the rings' exteriors (holes are filled) with a free border, and its origin (x, y)."""
    p = np.concatenate(rings)
    x0, y0 = (int(v) for v in np.floor(p.min(0)) - 1)
    w, h = (int(v) for v in np.ceil(p.max(0)) + 2 - (x0, y0))
    if w * h > MAX_PIXELS:
        raise ValueError("mask is too large")
    gx, gy = np.meshgrid(np.arange(w) + x0, np.arange(h) + y0)
    pts = np.stack([gx.ravel(), gy.ravel()], 1) + 0.5
    inside = np.zeros(len(pts), bool)
    for r in rings:
        inside |= contains(r, pts)
    return inside.reshape(h, w), (x0, y0)


def _removable(first: bool) -> np.ndarray:
    """For each ring of neighbours (bit i: _AROUND[i]) whether this pass removes its border pixel."""
    n = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
    count, turns = n.sum(1), (~n & np.roll(n, -1, 1)).sum(1)
    up, right, down, left = n[:, [0, 2, 4, 6]].T
    free = ~(up & right & down) & ~(right & down & left) if first else ~(up & right & left) & ~(up & down & left)
    return (count >= 2) & (count <= 6) & (turns == 1) & free


_PASSES = (_removable(True), _removable(False))


def thin(mask: np.ndarray) -> np.ndarray:
    """Two-pass thinning: removes border pixels whose ring of neighbours changes once, until none is left."""
    m = np.pad(mask.astype(np.uint8), 1)
    h, w = mask.shape
    inner = m[1:-1, 1:-1]
    changed = True
    while changed:
        changed = False
        for removable in _PASSES:
            ring = np.zeros((h, w), np.uint8)
            for i, (dy, dx) in enumerate(_AROUND):
                ring |= m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << i
            gone = removable[ring] & (inner == 1)
            if gone.any():
                inner[gone] = 0
                changed = True
    return inner.astype(bool)


def components(mask: np.ndarray) -> list[np.ndarray]:
    """Pixel lists (y, x) of 8-connected components, largest first, then by first pixel."""
    left, out = {(int(y), int(x)) for y, x in np.argwhere(mask)}, []
    for start in sorted(left):
        if start not in left:
            continue
        left.discard(start)
        queue, own = [start], []
        while queue:
            y, x = queue.pop()
            own.append((y, x))
            for dy, dx in _AROUND:
                q = (y + dy, x + dx)
                if q in left:
                    left.discard(q)
                    queue.append(q)
        out.append(np.array(sorted(own)))
    return sorted(out, key=lambda c: (-len(c), tuple(c[0])))


def topology(skeleton: np.ndarray) -> tuple[int, int]:
    """Numbers of end regions and branch regions of a skeleton."""
    m = np.pad(skeleton, 1)
    degree = sum(np.roll(m, (-dy, -dx), (0, 1)).astype(int) for dy, dx in _AROUND)
    return len(components(m & (degree == 1))), len(components(m & (degree >= 3)))


def _walk(nodes: set[tuple[int, int]], start: tuple[int, int]):
    far, via, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d > far[(y, x)]:
            continue
        for dy, dx in _AROUND:
            q = (y + dy, x + dx)
            if q in nodes and (e := d + (dx * dx + dy * dy) ** 0.5) < far.get(q, np.inf) - 1e-12:
                far[q], via[q] = e, (y, x)
                heapq.heappush(heap, (e, q))
    return far, via


def diameter_path(skeleton: np.ndarray) -> np.ndarray:
    """Longest of the shortest paths of the largest component (x, y), by two sweeps; ties go to the least pixel."""
    found = components(skeleton)
    if not found:
        return np.zeros((0, 2))
    nodes = {tuple(int(v) for v in p) for p in found[0]}
    far, _ = _walk(nodes, min(nodes))
    start = min(far, key=lambda q: (-far[q], q))
    far, via = _walk(nodes, start)
    at = min(far, key=lambda q: (-far[q], q))
    path = [at]
    while at in via:
        at = via[at]
        path.append(at)
    return np.array([(x, y) for y, x in reversed(path)], float)


def mask_components(mask: np.ndarray, threshold: float = 0.5) -> list[tuple[int, np.ndarray, tuple[float, float, float, float]]]:
    """(index, pixels, box) of a mask's components, by area and then place: islands of one or two pixels are kept."""
    out = []
    for i, c in enumerate(components(mask > threshold)):
        (y1, x1), (y2, x2) = c.min(0), c.max(0)
        out.append((i, c, (float(x1), float(y1), float(x2 + 1), float(y2 + 1))))
    return out
