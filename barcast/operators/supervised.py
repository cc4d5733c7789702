"""Supervised rows: features now, one target per horizon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.operators.splits import train_pool, with_split
from barcast.operators.windows import by_time, lag_columns_of, with_calendar, with_lags_and_leads, with_lags_and_times


def validation_frame(bars: DataFrame, params: Params) -> DataFrame:
    """Train and val bars with lags and future values that never cross the split border.

    The first rows of either split therefore have missing lags, and its last
    rows missing targets.
    """
    parts = with_split(train_pool(bars, params), params)
    return with_calendar(with_lags_and_leads(parts, params, ("asset", "split")), params)


def refit_frame(bars: DataFrame, params: Params) -> DataFrame:
    """All bars with lags over the whole series, so test rows see train values.

    ``truth_<feature>`` holds the values exactly 1..H grid steps later, used to
    score; ``next_<feature>`` those of the next H rows up to the cutoff, used to fit.
    """
    cut = params.cutoff()
    full = with_calendar(with_lags_and_times(with_split(bars, params), params), params)
    for f in params.features:
        # A target is usable for fitting only if it, too, is at or before the cutoff.
        inside = [F.when(F.col("next_t")[h - 1] <= cut, F.col(f"next_{f}")[h - 1]) for h in params.horizons]
        full = full.withColumn(f"truth_{f}", F.col(f"next_{f}")).withColumn(f"next_{f}", F.array(*inside))
    return by_time(full, params, "truth")


def long_targets(frame: DataFrame, params: Params, keep: list[str]) -> DataFrame:
    """One row per bar, feature and horizon: (keep…, feature, horizon, lags…, y).

    Rows are expanded in place; nothing is shuffled.
    """
    per_feature = [
        F.struct(
            F.lit(f).alias("feature"),
            *[c.alias(f"f_lag{k}") for k, c in zip(params.lags, lag_columns_of(f, params))],
            F.col(f"next_{f}").alias("targets"),
        )
        for f in params.features
    ]
    wide = frame.select(*keep, F.inline(F.array(*per_feature)))
    return wide.select(
        *keep, "feature", *params.lag_columns, F.posexplode("targets").alias("pos", "y")
    ).select(*keep, "feature", (F.col("pos") + 1).alias("horizon"), *params.lag_columns, "y")


def known_targets(long: DataFrame) -> DataFrame:
    return long.where(F.col("y").isNotNull())


def all_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without any missing value in ``columns``."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
