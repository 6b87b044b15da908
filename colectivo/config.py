"""Tunables of the analytics jobs, one frozen dataclass per area."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Cleaning:
    min_point_spacing_m: float = 5.0
    max_point_silence_s: float = 30.0
    spike_chord_m: float = 12.0
    spike_snap_m: float = 15.0
    spike_snap_margin_m: float = 6.0
    spike_turn_cos: float = 0.4
    spike_detour_m: float = 15.0
    trusted_accuracy_m: float = 10.0
    min_match_quality: float = 0.6
    min_edges: int = 5
    max_edge_detour_m: float = 30.0
    corner_deviation_m: float = 15.0
    corner_min_step_m: float = 0.5
    search_radius_m: float = 60.0


@dataclass(frozen=True)
class Direction:
    corridor_m: float = 60.0
    min_near_share: float = 0.3
    min_travel_m: float = 150.0
    samples: int = 50
    min_common_edges: int = 5
    min_overlap_share: float = 0.3


@dataclass(frozen=True)
class Variants:
    discovery: str = "components"
    max_divergence_depth: int = 6
    near_m: float = 200.0
    min_cluster_size: int = 3
    small_regime_traces: int = 6
    resample_m: float = 25.0
    min_overlap_m: float = 300.0
    max_excursion_m: float = 250.0
    min_route_m: float = 600.0
    min_route_traces: int = 2
    min_fragment_m: float = 300.0
    terminus_m: float = 150.0
    terminus_share: float = 0.6


@dataclass(frozen=True)
class Consensus:
    min_support: int = 2
    min_support_share: float = 0.5
    coverage_cell_m: float = 100.0
    endpoint_share: float = 0.5
    backtrack_m: float = 150.0
    connect_m: float = 15.0
    weld_m: float = 30.0
    stitch_m: float = 150.0
    trace_bridge_m: float = 700.0
    cross_corridor_m: float = 35.0
    cross_min_traces: int = 3
    straight_turn_deg: float = 20.0
    straight_trace_dev_m: float = 40.0
    merge_turn_deg: float = 110.0
    touch_turn_deg: float = 45.0
    offband_m: float = 35.0
    bridge_m: float = 300.0
    divergence_traces: int = 2
    divergence_separation_m: float = 100.0


@dataclass(frozen=True)
class Engine:
    cleaning: Cleaning = field(default_factory=Cleaning)
    direction: Direction = field(default_factory=Direction)
    variants: Variants = field(default_factory=Variants)
    consensus: Consensus = field(default_factory=Consensus)
    infer_direction: bool = True


@dataclass(frozen=True)
class Schedule:
    utc_offset_hours: int = -4
    min_sessions: int = 10
    min_sessions_per_day: int = 5
    max_cv: float = 0.5
    max_headway_min: int = 60


@dataclass(frozen=True)
class Votes:
    min_votes: int = 3
    min_ratio: float = 0.6
    min_confirmed_share: float = 0.8
    min_trips: int = 3
    overlap_m: float = 50.0
    nearby_m: float = 200.0


@dataclass(frozen=True)
class Routing:
    walk_m_s: float = 1.39
    bus_m_s: float = 4.17
    node_merge_m: float = 20.0
    transfer_m: float = 400.0
    access_m: float = 800.0
