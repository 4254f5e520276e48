"""Parameters of the operators. All are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_M = 6_371_008.8


@dataclass(frozen=True)
class PointScore:
    radius_m: float = 1500.0
    covered_m: float = 600.0
    neighbours: int = 3
    floor_m: float = 50.0
    tau_min: float = 15.0
    high: float = 0.55
    mid: float = 0.30


@dataclass(frozen=True)
class Freshness:
    fresh_min: float = 25.0
    delayed_min: float = 120.0
    skew_min: float = 2.0


@dataclass(frozen=True)
class Baseline:
    window_days: int = 84
    half_life_days: float = 28.0
    holiday_window_days: int = 1095
    holiday_half_life_days: float = 365.0
    min_n: int = 3
    prior_n: float = 4.0
    mask_value: float = 2.0


@dataclass(frozen=True)
class Anomaly:
    min_dispersion: float = 1e-6
    cap: float = 5.0


@dataclass(frozen=True)
class Capacity:
    reference_area: float = 42.9
    floor_area: float = 10.0
    alpha: float = 0.5


@dataclass(frozen=True)
class SourceDelay:
    horizons_min: tuple[int, ...] = (10, 30, 60, 90, 120)
    tolerance_min: float = 2.5
    temporal_min: int = 3
    slot_min: int = 2


@dataclass(frozen=True)
class NowcastGates:
    min_samples: int = 1000
    min_hotspots: int = 80
    min_span_days: float = 7.0
    max_wape: float = 0.20
    min_exact: float = 0.70
    min_adjacent: float = 0.95


@dataclass(frozen=True)
class Search:
    shortest: int = 2
    longest: int = 80
    limit: int = 20
    most: int = 50
    # Fixed value: west, south, east, north of the region
    box: tuple[float, float, float, float] = (126.76, 37.41, 127.20, 37.72)


@dataclass(frozen=True)
class Reconcile:
    name_m: float = 50.0
    phone_m: float = 150.0


@dataclass(frozen=True)
class ConfidenceWeights:
    spatial: float = 0.30
    freshness: float = 0.30
    agreement: float = 0.25
    health: float = 0.15
    single: float = 0.5
    tau_align_min: float = 10.0
    partial: float = 0.5
    skew_min: float = 2.0
    samples: float = 120.0


@dataclass(frozen=True)
class Promotion:
    min_spearman: float = 0.50
    min_adjacent: float = 0.80
    max_regression: float = 0.0


@dataclass(frozen=True)
class Stability:
    hours: tuple[int, ...] = (8, 14, 18)
    net_median: float = 0.80
    net_least: float = 0.60
    conditional_median: float = 0.60
    conditional_least: float = 0.50
    flow_median: float = 0.85
    tail: float = 0.10
    tail_jaccard: float = 0.50
    purpose_median: float = 0.05
    purpose_p90: float = 0.10
    known_share: float = 0.95
    strength: float = 0.20
    eligible_share: float = 0.20
    angle_median: float = 30.0
    angle_p90: float = 75.0
    within_45: float = 0.70
    strength_change: float = 0.10


@dataclass(frozen=True)
class SameDay:
    hours: tuple[int, ...] = (8, 14, 18)
    # People assumed in (a masked cell, an absent cell); the first pair is the primary one
    variants: tuple[tuple[float, float], ...] = ((2.0, 0.0), (0.0, 0.0), (3.0, 0.0), (2.0, 2.0), (2.0, 3.0))
    code_coverage: float = 0.95
    cell_jaccard: float = 0.99
    screening_median: float = 0.30
    conditional_median: float = 0.20
    conditional_positive: int = 2
    rho_range: float = 0.02


@dataclass(frozen=True)
class Repeats:
    days: int = 3
    supported_median: float = 0.30
    conditional_days: int = 2
    conditional_median: float = 0.20
    conditional_positive: int = 7
