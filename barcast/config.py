"""Run parameters.

One frozen dataclass carries every tunable value; functions take it as an
argument, so a job is fully described by its inputs plus one ``Params``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# These must equal the published defaults for results to match.
ZONE = "Europe/Berlin"
STEP_SECONDS = 900
MEASURES = ("high", "low", "close", "volume")
TRAIN_CUTOFF = "2023-12-31 23:45"
LAGS = (1, 2, 3, 4)
SMAPE_EPS = 1e-8
STD_FLOOR = 1e-6
WEIGHT_FLOOR = 1e-6
NONZERO_EPS = 1e-8
GATE_PROBABILITY = 0.5
MIN_TRAIN_ROWS = 50
MIN_VAL_ROWS = 10
MIN_POOLED_TRAIN_ROWS = 100
MIN_POOLED_VAL_ROWS = 20
CLASS_MARGIN = 5
SPARE_ROWS = 10


@dataclass(frozen=True)
class Params:
    horizon: int = 10
    val_days: int = 28
    train_cutoff: str = TRAIN_CUTOFF
    zone: str = ZONE
    features: tuple[str, ...] = MEASURES
    lags: tuple[int, ...] = LAGS
    # "last": every target sees the lags of the last listed feature (the
    # published behaviour); "own": each target sees its own lags.
    lag_source: str = "last"
    # "pooled": the pooled target runs on into the next series at a series
    # end (the published behaviour); "asset": it stops there.
    boundary: str = "pooled"
    pred_thresh: float = 1e-3
    activity_mean: float = 0.01
    activity_std: float = 0.01
    activity_nonzero: float = 0.05
    use_classifier: bool = True
    cls_eps: float = 1e-6
    rounds: int = 200
    refit_rounds: int = 100
    pooled_rounds: int = 200
    pooled_gate_rounds: int = 100
    patience: int = 20
    max_assets: int | None = None
    # Slots per window group: no task ever holds a whole series. The results
    # do not depend on it, nor on gaps.
    chunk_slots: int | None = 4096

    def __post_init__(self) -> None:
        if self.lag_source not in ("last", "own"):
            raise ValueError(f"lag_source must be 'last' or 'own', not {self.lag_source!r}")
        if self.boundary not in ("pooled", "asset"):
            raise ValueError(f"boundary must be 'pooled' or 'asset', not {self.boundary!r}")
        if not self.features:
            raise ValueError("at least one feature is needed")
        if self.horizon < 1 or not self.lags or min(self.lags) < 1:
            raise ValueError("horizon and lags must be positive")
        unknown = set(self.features) - set(MEASURES)
        if unknown:
            raise ValueError(f"unknown features: {sorted(unknown)}")

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def horizons(self) -> range:
        return range(1, self.horizon + 1)

    @property
    def lag_columns(self) -> list[str]:
        return [f"f_lag{k}" for k in self.lags]

    @property
    def min_pool_rows(self) -> int:
        return max(self.lags) + self.horizon + SPARE_ROWS

    def cutoff(self) -> Column:
        """Last training instant as a foldable timestamp (session zone UTC)."""
        moment = datetime.fromisoformat(self.train_cutoff)
        text = F.lit(moment.isoformat(sep=" ")).cast("timestamp")
        return text if moment.tzinfo else F.to_utc_timestamp(text, self.zone)

    def val_cutoff(self) -> Column:
        """Last instant of the fitting part: cutoff minus ``val_days`` of elapsed time."""
        return F.timestamp_seconds(F.unix_seconds(self.cutoff()) - self.val_seconds)

    @property
    def val_seconds(self) -> int:
        return self.val_days * 86_400


def parse_features(text: str) -> tuple[str, ...]:
    """``"close, high"`` → ``("close", "high")``; blanks are ignored."""
    return tuple(part.strip() for part in text.split(",") if part.strip())
