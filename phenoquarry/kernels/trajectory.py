"""Directions and turns along polylines (arrays of points), in mm."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

from .geometry import to_segments

# Spans and windows in mm.
CHUNK, TANGENT, TRIM, FIT, PCA_SPANS, TURN_SPAN, WINDOW, RECENT, COVERED = 2.0, 1.5, 0.5, 3.0, (1.5, 2.0, 3.0), 1.5, 4.0, 5.0, 0.5


def _of_last(fn):
    """fn of a path, kept for the last path that it was asked for (the same array; paths are never changed in place)."""
    last: list = [None, None]

    @functools.wraps(fn)
    def run(p):
        if last[0] is not p:
            last[:] = p, fn(p)
        return last[1]

    return run


def arcs(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p))
    if len(p) > 1:
        d = p[1:] - p[:-1]
        np.cumsum(np.hypot(d[:, 0], d[:, 1]), out=out[1:])
    return out


def length(p: np.ndarray) -> float:
    return float(arcs(p)[-1]) if len(p) else 0.0


def angle(a, b) -> float | None:
    """Directed, in degrees; None for a vector of no length."""
    if a is None or b is None:
        return None
    (ax, ay), (bx, by) = a, b
    m, n = math.hypot(ax, ay), math.hypot(bx, by)
    if min(m, n) <= 1e-9:
        return None
    return math.degrees(math.acos(max(-1.0, min(1.0, (ax * bx + ay * by) / (m * n)))))


def _reach(s: np.ndarray, i: int, span: float) -> int:
    """First index from i on at which the span is walked; the last one if it never is."""
    return min(int(np.searchsorted(s, s[i] + span - 1e-12)), len(s) - 1)


def chunks(p: np.ndarray, span: float = CHUNK) -> list[np.ndarray]:
    """Chords of consecutive stretches of at least the span; the last one may be shorter."""
    s, i, out = arcs(p), 0, []
    while i < len(p) - 1:
        j = max(_reach(s, i, span), i + 1)
        out.append(p[j] - p[i])
        i = j
    return out


def max_turn(p: np.ndarray, span: float = CHUNK) -> float:
    v = chunks(p, span)
    return max((t for a, b in zip(v, v[1:]) if (t := angle(a, b)) is not None), default=0.0)


def head(p: np.ndarray, span: float) -> np.ndarray:
    return p[: _reach(arcs(p), 0, span) + 1] if len(p) > 1 else p


def tail(p: np.ndarray, span: float) -> np.ndarray:
    return head(p[::-1], span)[::-1]


def direction(p: np.ndarray) -> np.ndarray | None:
    """First principal direction, pointing from the first to the last point."""
    if len(p) < 2:
        return None
    x, y = (p - p.sum(0) / len(p)).T
    xx, yy, xy = float(x @ x), float(y @ y), float(x @ y)
    if xx + yy <= 1e-24:
        return None
    t = 0.5 * math.atan2(2 * xy, xx - yy)  # the covariance's first axis
    v = np.array([math.cos(t), math.sin(t)])
    return -v if v @ (p[-1] - p[0]) < 0 else v


def at_arc(p: np.ndarray, s: np.ndarray, d: float) -> np.ndarray:
    return np.array([np.interp(d, s, p[:, 0]), np.interp(d, s, p[:, 1])])


@_of_last
def distal_tangent(p: np.ndarray) -> np.ndarray | None:
    """Direction before the tip: its last TRIM mm don't count, the FIT mm before them are fitted."""
    if len(p) < 2:
        return None
    s = arcs(p)
    hi, lo = max(s[-1] - TRIM, 0.0), max(s[-1] - TRIM - FIT, 0.0)
    inner = p[(s > lo) & (s < hi) & (s > s[-1] - TRIM - FIT)]
    fitted = direction(np.vstack([at_arc(p, s, lo), inner, at_arc(p, s, hi)]))
    if fitted is not None:
        return fitted
    t = tail(p, TANGENT)
    return t[-1] - t[0]


def nearest_index(p: np.ndarray, q: np.ndarray) -> int:
    return int(np.argmin(np.hypot(*(p - q).T)))


def continuation_tangent(p: np.ndarray, tip: np.ndarray, span: float = TANGENT) -> np.ndarray | None:
    if len(p) < 2:
        return None
    i = nearest_index(p, tip)
    j = _reach(arcs(p), i, span)
    return None if i == j else p[j] - p[i]


@_of_last
def _end_directions(p: np.ndarray) -> list[np.ndarray | None]:
    return [direction(tail(p, span)) for span in PCA_SPANS]


def multiscale_angle(target: np.ndarray, support: np.ndarray, tip: np.ndarray) -> float | None:
    """Median over the spans of the angle between the target's end and the support's start."""
    i, s, found = nearest_index(support, tip), arcs(support), []
    for span, end in zip(PCA_SPANS, _end_directions(target)):
        a = angle(end, direction(support[i : _reach(s, i, span) + 1]))
        if a is not None:
            found.append(a)
    return float(np.median(found)) if found else None


@_of_last
def recent_direction(p: np.ndarray) -> np.ndarray | None:
    t = tail(p, RECENT)
    return t[-1] - t[0] if len(t) > 1 else None


@_of_last
def _end_window(p: np.ndarray) -> tuple[np.ndarray, float]:
    a = tail(p, WINDOW)
    return a, max_turn(a, TURN_SPAN)


def join_turns(current: np.ndarray, suffix: np.ndarray) -> dict[str, float]:
    """Turn across the join, the largest that either side has of its own, and by how much the join exceeds it."""
    (a, turn), b = _end_window(current), head(suffix, WINDOW)
    own, merged = max(turn, max_turn(b, TURN_SPAN)), max_turn(np.vstack([a, b]), TURN_SPAN)
    return {"join_local_turn_deg": merged, "join_intrinsic_turn_deg": own, "join_excess_turn_deg": max(0.0, merged - own)}


@dataclass
class Resolved:
    """A support laid out from the current tip on: its points in walking order and where the tip enters."""

    raw: np.ndarray
    path: np.ndarray
    entry: int
    distance: float
    angle: float | None
    extension: float
    internal_turn: float
    stop: str | None = None
    clipped: bool = False

    @property
    def partial(self) -> bool:
        """Whether it claims just a part of the support."""
        return self.clipped or self.stop == "foreign_spikelet_body"

    @property
    def suffix(self) -> np.ndarray:
        return self.path[self.entry :]


def _ways(raw: np.ndarray, path: np.ndarray):
    yield raw, path
    yield raw[::-1], path[::-1]


def resolve(current: np.ndarray, raw: np.ndarray, path: np.ndarray) -> Resolved | None:
    """The better of the two walking directions by entry nearest to the tip; else by what the current path doesn't cover."""
    incoming = distal_tangent(current)
    if incoming is None or len(path) < 2:
        return None
    tip, best = current[-1], None
    for r, p in _ways(raw, path):
        e = nearest_index(p, tip)
        if len(p) - e < 2:
            continue
        out = angle(incoming, continuation_tangent(p, p[e]))
        found = Resolved(r, p, e, float(np.hypot(*(p[e] - tip))), out, float(tip[1] - p[e:, 1].min()), max_turn(p[e:]))
        key = (999.0 if out is None else out, found.internal_turn, found.distance, -length(p[e:]))
        if best is None or key < best[0]:
            best = (key, found)
    return best[1] if best else _uncovered(current, raw, path, incoming)


def _uncovered(current: np.ndarray, raw: np.ndarray, path: np.ndarray, incoming: np.ndarray) -> Resolved | None:
    tip, s, best = current[-1], arcs(current), None
    for r, p in _ways(raw, path):
        covered = np.flatnonzero(to_segments(p, current) <= COVERED)
        if not len(covered) or covered[-1] >= len(p) - 1:
            continue
        e = int(covered[-1])
        extension = float(tip[1] - p[e:, 1].min())
        v = chunks(p[e:])
        if extension <= 0 or not v:
            continue
        gaps = [np.hypot(*(at_arc(current, s, d) - p[e])) for d in s]
        out = angle(incoming, v[0])
        found = Resolved(r, p, e, float(np.hypot(*(p[e] - tip))), out, extension, max_turn(p[e:]))
        key = (max(0.0, s[-1] - s[int(np.argmin(gaps))]), 999.0 if out is None else out, found.internal_turn, -length(p[e:]))
        if best is None or key < best[0]:
            best = (key, found)
    return best[1] if best else None


def _step(p: np.ndarray, span: float) -> tuple[np.ndarray, float]:
    """Point at a span along a path, and the span really walked."""
    s = arcs(p)
    d = min(span, s[-1])
    return at_arc(p, s, d), float(d)


def clip_at_junction(current: np.ndarray, junctions: list[dict], r: Resolved, limit: float = 55.0) -> Resolved | None:
    """The support cut at the first junction with a side arm at which it turns sharply; None if nothing is left before it."""
    where = {tuple(q): i for i, q in enumerate(r.raw)}
    marks = sorted((where[q], j) for j in junctions if (q := tuple(j["raw_point"])) in where and where[q] >= r.entry and j["off_path_reach_mm"] >= min(PCA_SPANS)) if junctions else []
    for i, _ in marks:
        if i >= len(r.raw) - 1:
            continue
        before, turns = np.vstack([current, r.path[r.entry : i + 1]]), []
        for span in PCA_SPANS:
            (a, sa), (b, sb) = _step(before[::-1], span), _step(r.path[i:], span)
            if min(sa, sb) >= min(PCA_SPANS) - 1e-9 and (t := angle(r.path[i] - a, b - r.path[i])) is not None:
                turns.append(t)
        if not turns or np.median(turns) <= limit:
            continue
        if i <= r.entry:
            return None
        suffix = r.path[r.entry : i + 1]
        out = angle(distal_tangent(current), continuation_tangent(suffix, suffix[0]))
        return Resolved(r.raw[: i + 1], r.path[: i + 1], r.entry, r.distance, out, float(current[-1][1] - suffix[:, 1].min()), max_turn(suffix), "ambiguous_junction", True)
    return r


def choose(fused: Resolved | None, sources: list[tuple[str, Resolved]], most_lost: float = TANGENT) -> tuple[str | None, Resolved | None]:
    """The way through a support by its fused path or that of one source (named): sources that end much lower don't count;
    the straightest, then the smoothest, nearest and longest, then the first by name wins."""
    top = lambda r: float(r.suffix[:, 1].min())
    good = [(n, r) for n, r in sources if fused is None or top(r) - top(fused) <= most_lost]
    if not good:
        return (None, None) if fused is None else ("fused", fused)
    key = lambda x: (999.0 if x[1].angle is None else x[1].angle, x[1].internal_turn, x[1].distance, -length(x[1].suffix), x[0])
    name, best = min([*good, *([("", fused)] if fused else [])], key=key)
    return ("fused" if best is fused else "source"), best
