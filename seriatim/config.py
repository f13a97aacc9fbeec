"""Parameters of the measures, with their defaults. Where a number of pairs or rows is None, all are taken."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    max_lag: int = 10
    dtw_pairs: int | None = None
    histogram_bins: int = 50
    entropy_bins: int = 10
    overlap_edges: int = 20
    coverage_threshold: float = 0.5
    uniqueness_threshold: float = 1e-6
    test_share: float = 0.3
    horizon: int = 1
    components: int = 10
    full_covariance: bool = False
    rare_share: float = 0.1
    neighbours: int = 5
    pattern_rows: int | None = None
    distance_rows: int | None = None
    trees: int = 50
    depth: int = 10
    seed: int = 42
    dimension_weights: tuple[tuple[str, float], ...] = (("diversity", 0.25), ("fidelity", 0.35), ("privacy", 0.15), ("utility", 0.25))


DEFAULT = Config()
PRICES = ("Open", "High", "Low", "Close")
