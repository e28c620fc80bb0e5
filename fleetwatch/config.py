"""Thresholds, all overridable. Times are seconds unless a name says otherwise."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BeliefConfig:
    prior_alpha: float = 1000.0
    prior_beta: float = 1.0
    failure_weight: float = 1.0
    anomaly_weight: float = 0.3
    tmr_dissent_weight: float = 2.0
    increased_probing_below: float = 0.999
    suspect_below: float = 0.995
    quarantine_below: float = 0.99
    condemn_below: float = 0.95


@dataclass(frozen=True)
class WindowConfig:
    window_seconds: int = 300
    #: Width of the time chunks a key's history is cut into. One task sees one
    #: (key, chunk), so a key that owns a large share of the rows still spreads.
    chunk_seconds: int = 86_400

    @property
    def window_us(self) -> int:
        return self.window_seconds * 1_000_000

    @property
    def chunk_us(self) -> int:
        return self.chunk_seconds * 1_000_000


@dataclass(frozen=True)
class TrustConfig:
    min_comparisons: int = 10
    decay_factor: float = 0.999
    max_hops: int = 2
    canaries_per_interval: int = 10


@dataclass(frozen=True)
class TelemetryConfig:
    warn_c: float = 85.0
    critical_c: float = 95.0
    backoff_c: float = 80.0
    power_fraction: float = 0.9
    rolling_seconds: int = 60
    rate_seconds: int = 10


@dataclass(frozen=True)
class EwmaConfig:
    lam: float = 0.1
    limit: float = 3.5
    burn_in: int = 1000
    critical_factor: float = 1.5


@dataclass(frozen=True)
class EntropyConfig:
    floor: float = 0.5
    ceiling: float = 15.0


@dataclass(frozen=True)
class DivergenceConfig:
    threshold_nats: float = 0.01
    match_window_ms: int = 2000
    use_jsd: bool = True


@dataclass(frozen=True)
class SpectralConfig:
    baseline_window: int = 500
    hf_ratio: float = 0.3
    cutoff_fraction: float = 0.75
    z_warning: float = 4.0
    z_critical: float = 6.0
    cosine: float = 0.8


@dataclass(frozen=True)
class DistributionConfig:
    baseline_size: int = 5000
    ks_p: float = 0.001
    ad_level_index: int = 1


@dataclass(frozen=True)
class GradientConfig:
    alpha: float = 0.05
    warmup: int = 50
    sigma: float = 4.0


@dataclass(frozen=True)
class LossConfig:
    order: int = 5
    warmup: int = 20
    sigma: float = 3.0
    plateau_window: int = 50
    plateau_tolerance: float = 1e-7


@dataclass(frozen=True)
class TrainingLimits:
    max_weight: float = 1000.0
    max_update: float = 10.0
    max_learning_rate: float = 1.0


@dataclass(frozen=True)
class AuditConfig:
    batch_rows: int = 1000
    retention_days: int = 2555


@dataclass(frozen=True)
class AlertConfig:
    cooldown_seconds: int = 300
    per_minute: int = 60
    aggregate_seconds: int = 60
