"""The pooled frame: many series stacked into one table for a shared model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcast.config import STEP_SECONDS, Params
from barcast.functions.measures import magnitude_weight, normalised
from barcast.operators.ordering import asset_codes, with_positions
from barcast.operators.splits import eligible_assets, train_pool, with_split
from barcast.operators.supervised import all_known
from barcast.operators.windows import lag_plan, lead_plan, shifted, with_calendar, with_lags
from barcast.session import staged
from barcast.sources.bars import file_order


CHUNK_SLOTS = 4096  # where the parameters set no chunk size


def pooled_lags(bars: DataFrame, params: Params) -> DataFrame:
    """Bars up to the cutoff with lags; rows with any missing value dropped."""
    rows = with_lags(train_pool(bars, params), params)
    return all_known(rows, [*params.features, *lag_plan(params)])


def pooled_frame(bars: DataFrame, params: Params) -> DataFrame:
    """Pooled rows with lags, calendar, split and future values that stop at the split end.

    Future values count kept rows: rows with a missing value are dropped first,
    and gaps between the rest don't matter.
    """
    eligible = eligible_assets(train_pool(bars, params), params, "pooled").select("asset")
    pool = train_pool(bars, params).join(eligible, "asset", "left_semi")
    rows = all_known(with_lags(pool, params), [*params.features, *lag_plan(params)])
    rows = with_calendar(with_split(rows, params), params)
    ahead = {**lead_plan(params), "next_t": ("t", params.horizons)}
    led = shifted(rows, ["asset"], {}, params.chunk_slots, ahead)
    end = F.when(F.col("split") == "train", params.val_cutoff()).otherwise(params.cutoff())
    inside = {
        f"next_{f}": F.array(*[F.when(F.col("next_t")[h - 1] <= end, F.col(f"next_{f}")[h - 1]) for h in params.horizons])
        for f in params.features
    }
    return led.withColumns(inside).drop("next_t")


def _chunk(params: Params) -> Column:
    return F.floor(F.unix_seconds("t") / (STEP_SECONDS * (params.chunk_slots or CHUNK_SLOTS))).cast("long")


def chunk_counts(frame: DataFrame, params: Params) -> DataFrame:
    """(asset, split, chunk, rows): rows of each stretch of time of a series in a split."""
    return frame.groupBy("asset", "split", _chunk(params).alias("chunk")).agg(F.count(F.lit(1)).alias("rows"))


def series_places(counts: DataFrame) -> DataFrame:
    """(asset, split, n, start): where each series begins in the stacked split, in file-name order, and its rows."""
    per_asset = counts.groupBy("asset").agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("rows"))), F.lit(0)).alias(s) for s in ("train", "val")]
    )
    ranked = with_positions(per_asset, file_order(F.col("asset")), ["train", "val"], "places")
    both = F.array(
        *[F.struct(F.lit(s).alias("split"), F.col(s).alias("n"), F.col(f"{s}_start").alias("start")) for s in ("train", "val")]
    )
    return ranked.select("asset", F.inline(both)).where("n > 0")


def first_rows(frame: DataFrame, counts: DataFrame, params: Params) -> DataFrame:
    """The first H rows of each series in a split with their ``rank``.

    Counts of earlier chunks tell in which chunks they lie, so only those are ranked.
    """
    earlier = Window.partitionBy("asset", "split").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).where(F.col("before") < params.horizon)
    near = frame.withColumn("chunk", _chunk(params)).join(begins.select("asset", "split", "chunk", "before"), ["asset", "split", "chunk"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("asset", "split", "chunk").orderBy("t")) - 1
    return near.withColumn("rank", place).where(F.col("rank") < params.horizon)


def run_on_targets(frame: DataFrame, params: Params) -> DataFrame:
    """Let targets run past a series end into the next series of the same split.

    Only the last H rows of a series need it and only the first H rows of a
    series can supply it, so the positional join is between two thin slices
    (H rows per series each); all other rows pass through. Places are counts of
    rows, so gaps don't matter: a row among the last H knows how many rows follow. ``frame`` should be
    a stored table: it is read for the counts, the slices and the body.
    """
    counts = staged(chunk_counts(frame, params), "chunk_counts")
    places = series_places(counts)
    probe = f"next_{params.features[0]}"
    tail_key = ["asset", "split", "t"]
    heads = first_rows(frame, counts, params).join(places, ["asset", "split"]).select(
        "split", (F.col("start") + F.col("rank")).alias("target_pos"), *params.features
    )
    tails = frame.where(F.col(probe)[params.horizon - 1].isNull())
    follow = F.size(F.filter(probe, lambda v: v.isNotNull()))
    wanted = (
        tails.select(*tail_key, F.transform(probe, lambda v: v.isNull()).alias("open"), follow.alias("follow"))
        .join(places, ["asset", "split"])
        .select(*tail_key, (F.col("start") + F.col("n") - 1 - F.col("follow")).alias("own_pos"), F.posexplode("open").alias("k", "is_open"))
        .where("is_open")
        .withColumn("target_pos", F.col("own_pos") + F.col("k") + 1)
    )
    found = wanted.join(heads, ["split", "target_pos"])
    filled = found.groupBy(*tail_key).agg(
        *[
            F.array(*[F.max(F.when(F.col("k") == h - 1, F.col(f))) for h in params.horizons]).alias(f"over_{f}")
            for f in params.features
        ]
    )
    patched = tails.join(filled, tail_key, "left").withColumns(
        {
            f"next_{f}": F.array(
                *[F.coalesce(F.col(f"next_{f}")[h - 1], F.col(f"over_{f}")[h - 1]) for h in params.horizons]
            )
            for f in params.features
        }
    )
    return frame.where(F.col(probe)[params.horizon - 1].isNotNull()).unionByName(patched.select(*frame.columns))


def pooled_supervised(bars: DataFrame, params: Params) -> DataFrame:
    """Stored pooled frame with asset codes and targets as columns ``y_<feature>_<h>``.

    One column per target, so that fitting one model reads one target from storage.
    """
    frame = staged(pooled_frame(bars, params), "pooled")
    targeted = run_on_targets(frame, params) if params.boundary == "pooled" else frame
    coded = targeted.join(asset_codes(frame), "asset")
    columns = [c for c in coded.columns if not c.startswith("next_")]
    targets = [
        F.col(f"next_{f}")[h - 1].alias(f"y_{f}_{h}") for f in params.features for h in params.horizons
    ]
    return staged(coded.select(*columns, *targets), "pooled_targets")


def assets_without_train(frame: DataFrame) -> DataFrame:
    """Pooled assets with validation rows only: they have no statistics and are left out."""
    val = frame.where(F.col("split") == "val").select("asset").distinct()
    return val.join(frame.where(F.col("split") == "train").select("asset").distinct(), "asset", "left_anti")


def normalised_rows(rows: DataFrame, stats: DataFrame, feature: str, lag_columns: list[str], target: str) -> DataFrame:
    """Lags and target in units of the target feature's own series statistics, plus the row weight.

    ``stats`` has one row per asset and feature; ``y`` keeps the raw target and
    ``y_norm`` is the normalised one.
    """
    mine = stats.where(F.col("feature") == feature).select("asset", "mean", "std")
    mean, std = F.col("mean"), F.col("std")
    y_norm = normalised(F.col(target), mean, std)
    return (
        rows.where(F.col(target).isNotNull())
        .join(mine, "asset")
        .withColumns({c: normalised(F.col(c), mean, std) for c in lag_columns})
        .withColumns({"y": F.col(target), "y_norm": y_norm, "weight": magnitude_weight(y_norm)})
    )
