"""Run parameters with range checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrispParams:
    """Fixed-radius mode.

    The last two fields only steer execution, never results: the largest group
    handed to one Python task and the most hot spots that may be broadcast.
    """

    radius_miles: float = 5.0
    decay_rate: float = 0.3
    delete_threshold: float = 1.9
    hotspot_threshold: float = 5.0
    incident_weight: float = 1.0
    seed_percent: int = 10
    seed_when_empty: bool = True
    pick: str = "nearest"  # or "first": lowest hot spot id within the radius
    cluster_mode: str = "serial"  # or "bucketed": two phases over buckets
    n_buckets: int = 8
    compat_counts: bool = False  # bucketed: an absorbed lone point counts 1
    max_group_rows: int = 20_000
    broadcast_rows: int = 20_000

    def __post_init__(self):
        if not 0 <= self.decay_rate < 1:
            raise ValueError("decay_rate must be in [0, 1)")
        if self.radius_miles <= 0:
            raise ValueError("radius_miles must be positive")
        if not 0 <= self.seed_percent <= 100:
            raise ValueError("seed_percent must be in [0, 100]")
        if self.pick not in ("nearest", "first"):
            raise ValueError("pick must be 'nearest' or 'first'")
        if self.cluster_mode not in ("serial", "bucketed"):
            raise ValueError("cluster_mode must be 'serial' or 'bucketed'")
        if self.n_buckets < 1:
            raise ValueError("n_buckets must be at least 1")

    @property
    def cluster_miles(self) -> float:
        return self.radius_miles

    @property
    def keep_rate(self) -> float:
        return 1.0 - self.decay_rate


@dataclass(frozen=True)
class FuzzyParams(CrispParams):
    """Gaussian-membership mode. `radius_miles` is the largest reach of a hot
    spot; `init_miles` is the radius new hot spots are formed with."""

    init_miles: float = 2.0
    conf_threshold: float = 0.2
    rule_base: str = "tight"  # or "initial"

    def __post_init__(self):
        super().__post_init__()
        if self.init_miles <= 0:
            raise ValueError("init_miles must be positive")
        if not 0 < self.conf_threshold <= 1:
            raise ValueError("conf_threshold must be in (0, 1]")
        if self.rule_base not in ("tight", "initial"):
            raise ValueError("rule_base must be 'tight' or 'initial'")
        if self.cluster_mode != "serial":
            raise ValueError("the fuzzy mode clusters serially")

    @property
    def cluster_miles(self) -> float:
        return self.init_miles
