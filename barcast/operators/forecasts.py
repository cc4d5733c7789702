"""Assembly of long-form forecasts with their truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.functions.measures import clamped, gated
from barcast.functions.times import steps_after
from barcast.operators.baselines import baseline_pred
from barcast.operators.splits import eligible_assets, test_part
from barcast.operators.supervised import refit_frame
from barcast.operators.windows import lag_columns_of

FORECAST_COLUMNS = ["asset", "feature", "origin", "horizon", "target_time", "pred", "true"]


def post_processed(pred: Column, probability: Column, params: Params) -> Column:
    """No model → 0; gate by probability; clamp tiny values."""
    return clamped(gated(F.coalesce(pred, F.lit(0.0)), probability), params.pred_thresh)


def forecast_cells(frame: DataFrame, params: Params) -> DataFrame:
    """One row per test origin, feature and horizon, with its truth (missing past the end).

    ``frame`` is the refit frame. An origin counts only when all its features
    are known. The truth comes from the window pass that built the frame, not
    from a join of every cell back to the bars.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).alias("now"),
                _has_all(lag_columns_of(f, params)).alias("valid"),
                F.col(f"truth_{f}").alias("ahead"),
            )
            for f in params.features
        ]
    )
    by_feature = (
        test_part(frame, params).select("asset", F.col("t").alias("origin"), F.inline(rows)).where("valid")
    )
    cells = by_feature.select("asset", "feature", "origin", "now", F.posexplode("ahead").alias("pos", "true"))
    horizon = F.col("pos") + 1
    return cells.select(
        "asset",
        "feature",
        "origin",
        horizon.alias("horizon"),
        steps_after(F.col("origin"), horizon).alias("target_time"),
        "now",
        "true",
    )


def _has_all(columns: list[Column]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & c.isNotNull()
    return condition


def baseline_test_forecasts(bars: DataFrame, params: Params, name: str) -> DataFrame:
    """Zero or persistence forecasts of the test period, post-processed like a model's."""
    eligible = eligible_assets(bars, params, "refit").select("asset")
    frame = refit_frame(bars.join(eligible, "asset", "left_semi"), params)
    cells, pred = forecast_cells(frame, params), baseline_pred(name)
    final = post_processed(pred, F.lit(None).cast("double"), params)
    return cells.withColumn("pred", final).select(*FORECAST_COLUMNS)
