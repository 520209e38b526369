"""Thresholds of the two published policies, as one value instead of hidden defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PairThresholds:
    iou: float
    overlap: float
    buffer_px: float
    same_tile_angle_deg: float | None = None
    same_tile_overlap: float | None = None


@dataclass(frozen=True)
class Policy:
    """The reference thresholds."""

    name: str = "core"
    floor_confidence: float = 0.05
    primary_confidence: float = 0.25
    tile_size: int = 640
    tile_stride: int = 320
    awn: PairThresholds = PairThresholds(0.28, 0.62, 3.0, 1.5, 0.94)
    spikelet: PairThresholds = PairThresholds(0.30, 0.65, 2.0)
    cross_overlap: float = 0.45
    cross_iou: float = 0.35
    cross_area_px2: float = 8.0
    cross_extent_px: float = 24.0
    cross_angle_deg: float | None = None
    ambiguous_factor: float = 0.75
    same_tile_near_overlap: float = 0.75
    same_tile_near_angle_deg: float = 8.0
    compaction_overlap: float = 0.92
    premerge_min_area_mm2: float = 10.0
    premerge_max_area_mm2: float = 250.0
    premerge_max_axis_mm: float = 45.0
    premerge_awn_overlap: float = 0.50
    fragment_gap_mm: float = 2.0
    fragment_area_ratio: float = 0.25
    fragment_angle_deg: float = 20.0
    fragment_overlap: float = 0.50
    neighbours: int = 3
    min_neighbours: int = 2
    trusted_confidence: float = 0.50
    small_ratio: float = 0.20
    isolated_ratio: float = 0.30
    isolated_distance: float = 3.0
    seeds_per_spikelet: int = 4
    group_seeds: bool = False
    bridge_gate: bool = False
    share_margin: float = 0.05
    max_hops: int = 10


CORE = Policy()
STUDIO = replace(CORE, name="studio", cross_angle_deg=12.0, seeds_per_spikelet=16, group_seeds=True, bridge_gate=True)
