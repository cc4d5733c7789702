"""Per-series statistics and gates. Results have one row per asset and feature (and horizon)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.config import CLASS_MARGIN, MIN_TRAIN_ROWS, MIN_VAL_ROWS, Params
from barcast.functions.measures import guarded_std


def unpivot_features(bars: DataFrame, params: Params, keep: list[str] | None = None) -> DataFrame:
    """Wide bars → (…, feature, value) for the chosen features."""
    keep = keep or ["asset", "t"]
    return bars.unpivot(keep, list(params.features), "feature", "value")


def per_feature(
    df: DataFrame, keys: list[str], params: Params, aggregates: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """Aggregate every feature in one pass over the wide rows, then turn the small result long.

    Unpivoting after the aggregation keeps the row count that is shuffled at
    one per key instead of one per key and feature and input row.
    """
    built = {f: aggregates(f) for f in params.features}
    wide = df.groupBy(*keys).agg(
        *[c.alias(f"{f}__{name}") for f, named in built.items() for name, c in named.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{name}").alias(name) for name in named])
            for f, named in built.items()
        ]
    )
    return wide.select(*keys, F.inline(rows))


def per_feature_horizon(
    df: DataFrame,
    keys: list[str],
    params: Params,
    aggregates: Callable[[Column], dict[str, Column]],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """As ``per_feature``, over the future-value arrays: one row per feature and horizon.

    Features become rows (×4) but horizons stay columns, so the aggregation
    sees a tenth of the cells as rows and still compiles to one tight loop.
    ``keep`` names further columns the aggregates use.
    """
    names = list(aggregates(F.lit(0.0)))
    features = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"next_{f}").alias("ahead")) for f in params.features]
    )
    wide = (
        df.select(*keys, *keep, F.inline(features))
        .groupBy(*keys, "feature")
        .agg(*[c.alias(f"{n}_{h}") for h in params.horizons for n, c in aggregates(F.col("ahead")[h - 1]).items()])
    )
    horizons = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), *[F.col(f"{n}_{h}").alias(n) for n in names])
            for h in params.horizons
        ]
    )
    return wide.select(*keys, "feature", F.inline(horizons))


def train_stats(train: DataFrame, params: Params) -> DataFrame:
    """Per asset and feature: mean and sample spread, with unusable spreads set to 1."""
    return per_feature(
        train, ["asset"], params, lambda f: {"mean": F.avg(f), "std": guarded_std(F.stddev_samp(f))}
    )


def activity_stats(train: DataFrame, params: Params) -> DataFrame:
    """Per asset and feature: mean size, population spread, share of non-zero rows; empty → 0."""

    def build(f: str) -> dict[str, Column]:
        size = F.abs(F.col(f))
        share = F.avg(F.when(size.isNotNull(), (size > params.cls_eps).cast("double")))
        zero = F.lit(0.0)
        return {
            "mean_abs": F.coalesce(F.avg(size), zero),
            "std": F.coalesce(F.stddev_pop(f), zero),
            "nonzero_frac": F.coalesce(share, zero),
        }

    return per_feature(train, ["asset"], params, build)


def is_active(params: Params) -> Column:
    return (
        (F.col("mean_abs") >= params.activity_mean)
        | (F.col("std") >= params.activity_std)
        | (F.col("nonzero_frac") >= params.activity_nonzero)
    )


def activity_flags(train: DataFrame, params: Params) -> DataFrame:
    return activity_stats(train, params).withColumn("is_active", is_active(params))


def class_balance(led_train: DataFrame, params: Params) -> DataFrame:
    """Per model: fitting rows, non-zero targets, and whether a zero gate can be fitted."""
    counts = per_feature_horizon(
        led_train,
        ["asset"],
        params,
        lambda y: {"n": F.count(y), "n_nonzero": F.count_if(F.abs(y) > params.cls_eps)},
    )
    return counts.withColumn("has_gate", class_gate())


def class_gate() -> Column:
    return (F.col("n_nonzero") > CLASS_MARGIN) & (F.col("n_nonzero") < F.col("n") - CLASS_MARGIN)


def model_rows(led: DataFrame, params: Params) -> DataFrame:
    """Per asset, feature and horizon: rows with a known target in train and val.

    ``led`` must carry ``split`` and future values taken within the split.
    """
    return per_feature_horizon(
        led,
        ["asset"],
        params,
        lambda y: {
            "n_train": F.count(F.when(F.col("split") == "train", y)),
            "n_val": F.count(F.when(F.col("split") == "val", y)),
        },
        keep=("split",),
    )


def model_gate() -> Column:
    return (F.col("n_train") >= MIN_TRAIN_ROWS) & (F.col("n_val") >= MIN_VAL_ROWS)


def eligible_models(led: DataFrame, params: Params) -> DataFrame:
    return model_rows(led, params).where(model_gate())


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample spread of columns, one row each."""
    wide = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))
