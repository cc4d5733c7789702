"""Result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.functions.scoring import smape
from barcast.operators.stats import activity_flags, model_gate, per_feature_horizon
from barcast.operators.supervised import validation_frame
from barcast.session import staged

_BUCKETS = 2048


def forecast_eval(forecasts: DataFrame) -> DataFrame:
    """(asset, feature, horizon, sMAPE, n) over forecasts whose truth is known."""
    return (
        forecasts.where(F.col("true").isNotNull())
        .groupBy("asset", "feature", "horizon")
        .agg(smape(F.col("true"), F.col("pred")).alias("sMAPE"), F.count(F.lit(1)).alias("n"))
    )


def inactive_eval(bars: DataFrame, params: Params) -> DataFrame:
    """Zero forecasts for inactive series: (asset, feature, horizon, sMAPE, n_train, n_val).

    The flags come from a plain aggregation over the training bars. Only assets
    with an inactive feature go through the window pass, and no model sees them.
    """
    train = bars.where(F.col("t") <= params.val_cutoff())
    quiet = staged(
        activity_flags(train, params).where(~F.col("is_active")).select("asset", "feature"), "inactive"
    )
    frame = validation_frame(bars.join(quiet, "asset", "left_semi"), params)
    in_val = F.col("split") == "val"

    def measures(y):
        return {
            "n_train": F.count(F.when(F.col("split") == "train", y)),
            "n_val": F.count(F.when(in_val, y)),
            "sMAPE": smape(F.when(in_val & y.isNotNull(), y), F.lit(0.0), only_known=True),
        }

    scored = per_feature_horizon(frame, ["asset"], params, measures, keep=("split",))
    return (
        scored.where(model_gate())
        .join(quiet, ["asset", "feature"], "left_semi")
        .select("asset", "feature", "horizon", "sMAPE", "n_train", "n_val")
    )


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median of ``value`` per key, without gathering a group or a bucket in one task.

    Each middle rank (two of them where the count is even) keeps an interval of values. A pass counts
    the interval's values in buckets, by partial aggregates, and goes on with the
    bucket that holds the rank; it ends where a bucket has a single value, however many rows
    have it. Nulls and NaN don't count, a key without values has no row; values must be finite.
    """
    rows = staged(df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")), "median_rows")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.array(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    state = staged(whole.select(*keys, F.posexplode(ranks).alias("_side", "_rank"), "_low", "_high"), "median_state")
    found = []
    while True:
        found.append(state.where("_low = _high"))
        open_ = state.where("_low < _high")
        if open_.isEmpty():
            break
        share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        inside = rows.join(open_, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        buckets = (
            inside.withColumn("_b", F.least(F.floor(share * _BUCKETS), F.lit(_BUCKETS - 1)))
            .groupBy(*keys, "_side", "_rank", "_b")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        )
        end = F.sum("_n").over(Window.partitionBy(*keys, "_side").orderBy("_b"))
        holds = (F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_n"))
        left = (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_rank")
        state = staged(buckets.withColumn("_end", end).where(holds).select(*keys, "_side", left, "_low", "_high"), "median_state")
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.avg("_low").alias(f"median_{value}"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Per feature and horizon: mean and median sMAPE over assets, assets, scored rows."""
    keys = ["feature", "horizon"]
    means = results.groupBy(*keys).agg(
        F.avg("sMAPE").alias("mean_sMAPE"),
        F.count("sMAPE").alias("n_assets"),
        F.sum("n").alias("n_rows"),
    )
    return means.join(exact_median(results, keys, "sMAPE"), keys, "left")


def worst_assets(results: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` assets with the largest mean sMAPE, ties by asset (a top-k report)."""
    means = results.groupBy("asset").agg(F.avg("sMAPE").alias("mean_sMAPE"))
    return means.orderBy(F.desc("mean_sMAPE"), "asset").limit(n)
