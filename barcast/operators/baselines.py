"""Zero and persistence forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.functions.scoring import smape
from barcast.operators.splits import is_origin, validation_window
from barcast.operators.windows import by_time, with_lags_and_times

BASELINES = ("zero", "persistence")


def origin_truths(bars: DataFrame, params: Params) -> DataFrame:
    """Evaluation origins with the values of every feature 1..H grid steps later."""
    window = validation_window(bars, params)
    ahead = with_lags_and_times(window, params, lags=False).where(is_origin(params))
    return by_time(ahead, params, "next")


def truth_cells(bars: DataFrame, params: Params) -> DataFrame:
    """One row per origin, feature and horizon: (asset, feature, origin, horizon, now, truth)."""
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).alias("now"), F.col(f"next_{f}").alias("ahead"))
            for f in params.features
        ]
    )
    by_feature = origin_truths(bars, params).select("asset", F.col("t").alias("origin"), F.inline(rows))
    cells = by_feature.select("asset", "feature", "origin", "now", F.posexplode("ahead").alias("pos", "truth"))
    return cells.select(
        "asset", "feature", "origin", (F.col("pos") + 1).alias("horizon"), "now", "truth"
    )


def baseline_pred(name: str) -> Column:
    """Zero, or the value at the origin for all horizons."""
    return {"zero": F.lit(0.0), "persistence": F.col("now")}[name]


def baseline_forecasts(bars: DataFrame, params: Params, name: str) -> DataFrame:
    return truth_cells(bars, params).withColumn("pred", baseline_pred(name)).drop("now")


def baseline_results(bars: DataFrame, params: Params) -> DataFrame:
    """(asset, feature, baseline, sMAPE): one mean over all origins and horizons.

    Both baselines are scored in one aggregation; the cells are expanded
    map-side and collapse in the partial aggregate before the exchange.
    """
    scored = (
        truth_cells(bars, params)
        .groupBy("asset", "feature")
        .agg(*[smape(F.col("truth"), baseline_pred(b)).alias(b) for b in BASELINES])
    )
    return scored.unpivot(["asset", "feature"], list(BASELINES), "baseline", "sMAPE")
