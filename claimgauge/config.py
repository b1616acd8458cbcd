"""Thresholds, policy change events and peer baselines.

The default values are fixed values: results must equal those of existing users.
"""

from __future__ import annotations

import dataclasses
import datetime as dt


@dataclasses.dataclass(frozen=True)
class DetectionConfig:
    """Thresholds of the outlier rules and of the rebound check."""

    zscore_threshold: float = 2.0
    new_entity_days: int = 90
    new_entity_volume_percentile: float = 0.90
    oon_rate_threshold: float = 0.80
    billing_ratio_multiplier: float = 3.0
    rebound_window_weeks: int = 12
    rebound_threshold_pct: float = 0.80


@dataclasses.dataclass(frozen=True)
class PolicyChangeEvent:
    """An authorization requirement that was 'added' or 'removed' for some procedure codes."""

    policy_id: str
    affected_procedure_prefixes: tuple[str, ...]
    change_type: str
    effective_date: dt.date
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "affected_procedure_prefixes", tuple(self.affected_procedure_prefixes))


@dataclasses.dataclass(frozen=True)
class BenchmarkBaseline:
    """A peer value for one metric and the relative variance that is still acceptable."""

    metric_name: str
    baseline_value: float
    threshold_pct: float = 0.10


DEFAULT_EVENTS = (
    PolicyChangeEvent(
        policy_id="POL-001",
        affected_procedure_prefixes=("CPT-7",),
        change_type="removed",
        effective_date=dt.date(2024, 7, 1),
        description="Removed prior auth requirement for imaging services",
    ),
)

DEFAULT_BASELINES = (
    BenchmarkBaseline("denial_rate", 0.08, 0.15),
    BenchmarkBaseline("oon_rate", 0.05, 0.20),
    BenchmarkBaseline("cost_per_claim", 1200.0, 0.10),
)

DEFAULT_COST_PER_APPEAL = 350.0


@dataclasses.dataclass(frozen=True)
class PipelineConfig:
    """Everything a full run needs besides its input and output paths."""

    detection: DetectionConfig = DetectionConfig()
    policy_events: tuple[PolicyChangeEvent, ...] = DEFAULT_EVENTS
    benchmarks: tuple[BenchmarkBaseline, ...] = DEFAULT_BASELINES
    cost_per_appeal: float = DEFAULT_COST_PER_APPEAL
