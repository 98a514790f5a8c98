"""Thresholds shared by the operators, validated once and passed around as one frozen value."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Every tunable rule of the monitoring operators.

    The defaults are fixed values: results must equal them.
    """

    monitor_interval_seconds: int = 60
    drift_p_value: float = 0.05
    accuracy_threshold: float = 0.85
    retrain_cooldown_seconds: int = 3600
    price_per_prediction: float = 0.002
    tier_prices: tuple[tuple[float | None, float], ...] = (
        (10_000.0, 0.003),
        (100_000.0, 0.002),
        (None, 0.001),
    )
    chunk_chars: int = 800
    chunk_overlap: int = 150
    top_k: int = 5
    min_similarity: float = 0.25
    escalation_confidence: float = 0.40
    memory_turns: int = 6

    def __post_init__(self) -> None:
        if self.monitor_interval_seconds < 10:
            raise ValueError("monitor_interval_seconds must be at least 10")
        if not 0 < self.drift_p_value < 1:
            raise ValueError("drift_p_value must lie strictly between 0 and 1")
        if not 0 < self.accuracy_threshold <= 1:
            raise ValueError("accuracy_threshold must lie in (0, 1]")
        if self.retrain_cooldown_seconds < 0:
            raise ValueError("retrain_cooldown_seconds must not be negative")
        if not 0 <= self.chunk_overlap < self.chunk_chars:
            raise ValueError("chunk_overlap must be smaller than chunk_chars")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "BEACONRY_") -> Settings:
        """Read overrides such as ``BEACONRY_DRIFT_P_VALUE=0.01``; bad values raise."""
        env = os.environ if env is None else env
        chosen = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and f.name != "tier_prices":
                chosen[f.name] = type(f.default)(raw)
        return cls(**chosen)


DEFAULTS = Settings()
