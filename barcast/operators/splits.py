"""Train, validation and test parts, evaluation origins, and eligibility gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.config import MIN_TRAIN_ROWS, MIN_VAL_ROWS, Params
from barcast.functions.times import seconds_before, steps_after


def train_pool(bars: DataFrame, params: Params) -> DataFrame:
    return bars.where(F.col("t") <= params.cutoff())


def test_part(bars: DataFrame, params: Params) -> DataFrame:
    return bars.where(F.col("t") > params.cutoff())


def split_name(params: Params) -> Column:
    return (
        F.when(F.col("t") <= params.val_cutoff(), "train")
        .when(F.col("t") <= params.cutoff(), "val")
        .otherwise("test")
    )


def with_split(bars: DataFrame, params: Params) -> DataFrame:
    """Mark each bar train (up to cutoff − val_days), val (up to the cutoff) or test."""
    return bars.withColumn("split", split_name(params))


def split_counts(bars: DataFrame, params: Params) -> DataFrame:
    return with_split(bars, params).groupBy("asset", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )


def last_train_times(bars: DataFrame, params: Params) -> DataFrame:
    return train_pool(bars, params).groupBy("asset").agg(F.max("t").alias("last_train"))


def validation_window(bars: DataFrame, params: Params) -> DataFrame:
    """Bars from ``last_train − val_days`` to ``last_train`` of each asset.

    The earliest window start over all assets is a scalar subquery: it becomes
    a literal before the scan, so storage skips everything older.
    """
    last = last_train_times(bars, params)
    start = F.min(seconds_before(F.col("last_train"), params.val_seconds)).alias("start")
    recent = train_pool(bars, params).where(F.col("t") >= last.agg(start).scalar())
    return recent.join(last, "asset").where(
        F.col("t") >= seconds_before(F.col("last_train"), params.val_seconds)
    )


def is_origin(params: Params) -> Column:
    """The whole horizon after this bar still lies in the training period."""
    return steps_after(F.col("t"), params.horizon) <= F.col("last_train")


def eval_origins(bars: DataFrame, params: Params) -> DataFrame:
    """Validation bars from which every horizon can be scored."""
    return validation_window(bars, params).where(is_origin(params))


def pool_sizes(bars: DataFrame, params: Params) -> DataFrame:
    """Per asset: rows up to the cutoff (split into train and val) and after it."""
    part = split_name(params)
    return bars.groupBy("asset").agg(
        F.count_if(part == "train").alias("n_train"),
        F.count_if(part == "val").alias("n_val"),
        F.count_if(part == "test").alias("n_test"),
    )


def pool_gate(params: Params) -> Column:
    return F.col("n_train") + F.col("n_val") >= params.min_pool_rows


def validation_gate() -> Column:
    return (F.col("n_train") >= MIN_TRAIN_ROWS) & (F.col("n_val") >= MIN_VAL_ROWS)


def eligible_assets(bars: DataFrame, params: Params, use: str) -> DataFrame:
    """Assets with enough rows. ``use``: ``pooled``, ``validation`` or ``refit``."""
    gates = {
        "pooled": pool_gate(params),
        "validation": pool_gate(params) & validation_gate(),
        "refit": pool_gate(params) & (F.col("n_test") > 0),
    }
    return pool_sizes(bars, params).where(gates[use])
