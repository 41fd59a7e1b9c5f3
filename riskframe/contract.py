"""Decision, monitoring and fairness thresholds shared by every job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Contract:
    approve_below: float = 0.15
    review_below: float = 0.30
    psi_warning: float = 0.10
    psi_critical: float = 0.25
    csi_threshold: float = 0.20
    auc_drop_threshold: float = 0.03
    min_drift_scores: int = 500
    min_outcomes: int = 100
    max_rank_breaks: int = 2
    dir_threshold: float = 0.80
    dir_worsen_tolerance: float = 0.01
    auc_promote_margin: float = 0.005
    staleness_hours: int = 720
    retention_days: int = 750
    max_reasons: int = 4
    max_null_fraction: float = 0.05
    min_group_rows: int = 10

    def __post_init__(self):
        checks = {
            "decision bands": 0 < self.approve_below < self.review_below < 1,
            "psi bands": 0 < self.psi_warning < self.psi_critical,
            "csi threshold": self.csi_threshold > 0,
            "auc drop threshold": self.auc_drop_threshold > 0,
            "minimum scores": self.min_drift_scores > 0,
            "dir threshold": 0 < self.dir_threshold <= 1,
            "dir tolerance": 0 <= self.dir_worsen_tolerance < self.dir_threshold,
            "retention": self.retention_days > 0,
        }
        bad = [name for name, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"inconsistent thresholds: {', '.join(bad)}")


DEFAULT = Contract()
