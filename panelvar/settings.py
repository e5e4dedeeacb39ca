"""Default parameters. Every operator takes them as arguments; nothing below is read implicitly."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Shared numeric conventions of the platform.
TRADING_DAYS = 252
OPEN_END = date(9999, 12, 31)
PROB_CLIP = 1e-6
LOG_FLOOR = 1e-8

# Features whose design-matrix column is the logarithm.
LOG_FEATURES = ("rv_5d", "rv_21d", "rv_63d", "vix_level", "parkinson_21d", "garman_klass_21d")


@dataclass(frozen=True)
class Target:
    horizon: int = 5
    quantile: float = 0.80
    lookback: int = 252
    trading_days: int = TRADING_DAYS

    @property
    def label_name(self) -> str:
        return f"rv{self.horizon}_q{round(self.quantile * 100)}"


@dataclass(frozen=True)
class QualityRules:
    outlier: float = 0.15
    stale_run: int = 5
    max_missing: float = 0.005
    max_off_calendar: float = 0.001
    revision: float = 1e-6
    range_tolerance: float = 1e-6
    macro_lag_days: tuple[int, int] = (20, 90)
    max_age_daily: int = 10
    max_age_other: int = 75


@dataclass(frozen=True)
class InferenceSettings:
    draws: int = 1000
    mean_block: int = 20
    dm_horizon: int = 5
    seed: int = 12345


@dataclass(frozen=True)
class RiskSettings:
    confidences: tuple[float, ...] = (0.95, 0.99)
    window: int = 500
    ewma_lambda: float = 0.94
    student_t_df: int = 5
    min_fit_obs: int = 500
    mc_paths: int = 100_000
    mc_horizon: int = 10
    equity_shock: float = -0.20
    vol_multiplier: float = 2.0
    correlation_blend: float = 0.5


@dataclass(frozen=True)
class OverlaySettings:
    target_vol: float = 0.10
    target_vols: tuple[float, ...] = (0.08, 0.10, 0.12)
    ewma_lambda: float = 0.94
    cost_bps: float = 5.0
    costs_bps: tuple[float, ...] = (0.0, 2.0, 5.0, 10.0)
    lag: int = 2
    lags: tuple[int, ...] = (1, 2)
    max_weight: float = 1.0


@dataclass(frozen=True)
class PanelRoles:
    """Which series of the panel plays which part in the market-wide features."""

    market: str
    implied_vol: str
    volume: str
    sector: tuple[str, ...]
    credit: tuple[str, str]
    policy_rate: str
    ten_year: str
    two_year: str
    term_spread: str
    unemployment: str
    price_index: str


@dataclass(frozen=True)
class Fold:
    label: str
    test_start: date
    test_end: date


def yearly_folds(first: int, last: int, prefix: str = "wf") -> list[Fold]:
    return [Fold(f"{prefix}_{y}", date(y, 1, 1), date(y, 12, 31)) for y in range(first, last + 1)]


@dataclass(frozen=True)
class DateWindow:
    name: str
    start: date
    end: date


@dataclass(frozen=True)
class Portfolio:
    weights: dict[str, float] = field(default_factory=dict)
