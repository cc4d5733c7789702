"""One model per series, feature and horizon, trained side by side over the cluster.

Spark does the windows, gates, filters, post-processing and scoring. The one
grouped-map function fits the H horizons of one (asset, feature): its group is
at most one row per grid point, and inactive series are filtered out before the
exchange to Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.config import CLASS_MARGIN, MIN_TRAIN_ROWS, MIN_VAL_ROWS, Params
from barcast.functions.measures import nan_to_null
from barcast.functions.scoring import smape
from barcast.functions.times import steps_after
from barcast.operators.evaluation import inactive_eval
from barcast.operators.forecasts import FORECAST_COLUMNS, forecast_cells, post_processed
from barcast.operators.learner import Binning, balanced_logit, boosted_forecast, probability
from barcast.operators.splits import eligible_assets, train_pool
from barcast.operators.stats import activity_flags
from barcast.operators.supervised import refit_frame, validation_frame
from barcast.operators.windows import lag_columns_of
from barcast.session import staged

FITTED_SCHEMA = (
    "asset string, feature string, t timestamp, horizon int, pred double, probability double, y double, "
    "rounds int, n_train long"
)
_MAX_FIT_TASKS = 50_000
_FITTED_COLUMNS = [part.strip().split(" ")[0] for part in FITTED_SCHEMA.split(",")]


def model_input(frame: DataFrame, active: DataFrame, params: Params, targets: str) -> DataFrame:
    """One row per bar and active feature: only the columns a fit needs.

    ``targets`` is the prefix of the per-feature arrays of future values.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                *[c.alias(f"f_lag{k}") for k, c in zip(params.lags, lag_columns_of(f, params))],
                *[F.col(f"{targets}_{f}")[h - 1].alias(f"y{h}") for h in params.horizons],
            )
            for f in params.features
        ]
    )
    long = frame.select("asset", "t", "split", "hour", "dow", F.inline(rows))
    return long.join(active, ["asset", "feature"], "left_semi")


def _fit_group(params: Params, rounds: int, validated: bool):
    lag_names, horizon = params.lag_columns, params.horizon
    use_gate, eps, patience = params.use_classifier, params.cls_eps, params.patience

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        asset, feature = pdf["asset"].iat[0], pdf["feature"].iat[0]
        pdf = pdf.sort_values("t", kind="stable")
        x = pdf[[*lag_names, "hour", "dow"]].to_numpy(dtype=float)
        split = pdf["split"].to_numpy()
        fit_part = split == "train" if validated else split != "test"
        out_part = split == "val" if validated else (split == "test") & ~np.isnan(x).any(axis=1)
        bins = Binning(x[fit_part])
        codes, x_filled, times = bins.codes(x), np.nan_to_num(x, nan=0.0), pdf["t"].to_numpy()
        frames = []
        for h in range(1, horizon + 1):
            y = pdf[f"y{h}"].to_numpy(dtype=float)
            known = ~np.isnan(y)
            train = fit_part & known
            out = out_part & known if validated else out_part
            if validated and (train.sum() < MIN_TRAIN_ROWS or out.sum() < MIN_VAL_ROWS):
                continue
            pred, chance, used = np.full(out.sum(), np.nan), np.full(out.sum(), np.nan), 0
            if train.sum() >= MIN_TRAIN_ROWS and out.any():
                pred, used = boosted_forecast(
                    codes[train], y[train], codes[out], bins.width, rounds, y[out] if validated else None, patience
                )
                positive = (np.abs(y[train]) > eps).astype(float)
                if use_gate and CLASS_MARGIN < positive.sum() < len(positive) - CLASS_MARGIN:
                    w = balanced_logit(x_filled[train], positive)
                    if w is not None:
                        chance = probability(x_filled[out], w)
            cells = {"t": times[out], "horizon": h, "pred": pred, "probability": chance, "y": y[out]}
            frames.append(pd.DataFrame(cells).assign(rounds=used, n_train=int(train.sum())))
        if not frames:
            return pd.DataFrame(columns=_FITTED_COLUMNS)
        return pd.concat(frames).assign(asset=asset, feature=feature)[_FITTED_COLUMNS]

    return fit


def fitted(rows: DataFrame, active: DataFrame, params: Params, rounds: int, validated: bool) -> DataFrame:
    """Raw forecasts, non-zero probabilities and truths of every model; missing values are null.

    Fitting takes seconds to minutes per group while its rows are few, so the
    partition count follows the number of groups, not the bytes.
    """
    tasks = min(max(active.count(), 1), _MAX_FIT_TASKS)
    out = (
        rows.repartition(tasks, "asset", "feature")
        .groupBy("asset", "feature")
        .applyInPandas(_fit_group(params, rounds, validated), FITTED_SCHEMA)
    )
    return out.withColumns({c: nan_to_null(F.col(c)) for c in ("pred", "probability", "y")})


def per_asset_eval(bars: DataFrame, params: Params) -> DataFrame:
    """(asset, feature, horizon, sMAPE, n_train, n_val): fit on train, stop early and score on val."""
    train = bars.where(F.col("t") <= params.val_cutoff())
    flags = activity_flags(train, params).select("asset", "feature", "is_active")
    active = staged(flags, "activity").where("is_active").select("asset", "feature")
    rows = model_input(validation_frame(bars, params), active, params, "next")
    final = post_processed(F.col("pred"), F.col("probability"), params)
    modelled = (
        fitted(rows, active, params, params.rounds, validated=True)
        .groupBy("asset", "feature", "horizon")
        .agg(
            smape(F.col("y"), final).alias("sMAPE"),
            F.max("n_train").alias("n_train"),
            F.count(F.lit(1)).alias("n_val"),
        )
    )
    return modelled.unionByName(inactive_eval(bars, params))


def refit_forecasts(bars: DataFrame, params: Params) -> DataFrame:
    """Fit on everything up to the cutoff, forecast every valid origin after it.

    Active series come back from the grouped fit with their truths; inactive
    ones get zero forecasts from a plain projection. The two are disjoint, so
    nothing is joined cell by cell.
    """
    flags = staged(
        activity_flags(train_pool(bars, params), params).select("asset", "feature", "is_active"), "activity"
    )
    eligible = staged(eligible_assets(bars, params, "refit").select("asset"), "eligible")
    frame = refit_frame(bars.join(eligible, "asset", "left_semi"), params)
    for f in params.features:
        target = F.when(F.col("split") == "test", F.col(f"truth_{f}")).otherwise(F.col(f"next_{f}"))
        frame = frame.withColumn(f"y_{f}", target)

    active, quiet = (flags.where(c).select("asset", "feature") for c in ("is_active", "not is_active"))
    rows = model_input(frame, active, params, "y")
    final = post_processed(F.col("pred"), F.col("probability"), params)
    modelled = fitted(rows, active, params, params.refit_rounds, validated=False).select(
        "asset",
        "feature",
        F.col("t").alias("origin"),
        "horizon",
        steps_after(F.col("t"), F.col("horizon")).alias("target_time"),
        final.alias("pred"),
        F.col("y").alias("true"),
    )
    zeros = (
        forecast_cells(frame.join(quiet, "asset", "left_semi"), params)
        .join(quiet, ["asset", "feature"], "left_semi")
        .withColumn("pred", F.lit(0.0))
        .select(*FORECAST_COLUMNS)
    )
    return modelled.unionByName(zeros)
