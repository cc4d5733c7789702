"""Registered queries: (spark, sf_dir) → DataFrame over the whole given tables.

Instants are returned as epoch numbers, so any engine compares them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcast.config import STEP_SECONDS
from barcast.functions.measures import (
    denormalised,
    is_nonzero,
    magnitude_weight,
    normalised,
)
from barcast.functions.scoring import smape
from barcast.operators import clean, evaluation, forecasts, ordering, pooled, splits, stats, supervised, windows
from barcast.operators import pooled_models as shared
from barcast.operators.baselines import baseline_forecasts, baseline_results, truth_cells
from barcast.operators.series_models import per_asset_eval, refit_forecasts
from barcast.operators.summary import asset_summary, head_sample, merged_summary, partial_summaries, table_profile
from barcast.plans.fixture import FIXTURE_PARAMS as P
from barcast.plans.fixture import raw_ohlcv, table
from barcast.session import scratch_path, staged
from barcast.sources import assets as asset_source
from barcast.sources import sinks
from barcast.sources.bars import bars_report, read_bars, write_bars
from barcast.sources.pages import page_links
from barcast.sources.raw import RAW_SCHEMA, normalise_records, read_raw
from barcast.streaming.summary import start_stored_summary, stored_summary, stream_raw

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
MEASURES = ["high", "low", "close", "volume"]


def query(fn: Query | None = None, *, name: str | None = None):
    """Register a query under its function name, or under ``name`` where that is taken."""
    if fn is None:
        return lambda f: query(f, name=name)
    _REGISTRY[name or fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy bars, for queries that read them once."""
    return clean.regular_bars(raw_ohlcv(spark, sf_dir))


def _stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a stored table, for queries that read them more than once."""
    return staged(_bars(spark, sf_dir), "bars")


def _sec(name: str, alias: str):
    return F.unix_seconds(F.col(name)).alias(alias)


def _us(name: str, alias: str):
    return F.unix_micros(F.col(name)).alias(alias)


# --- scans -----------------------------------------------------------------


@query
def raw_scan(spark, sf_dir):
    """Two ordered inputs (before and after the cutoff) and a missing one, scanned back in order."""
    raw, root = raw_ohlcv(spark, sf_dir), scratch_path(spark, "raw")
    early = F.col("ExecutionTime") <= P.cutoff()
    names = ["ID", "ExecutionTime", *MEASURES]
    raw.where(early).select(*names).write.parquet(f"{root}/train")
    raw.where(~early).select(*names).write.parquet(f"{root}/test")
    scan = read_raw(spark, [f"{root}/train", f"{root}/absent", f"{root}/test"])
    after = F.col("ExecutionTime") > P.cutoff()
    return scan.records.groupBy("ID", after.alias("is_test")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("seq").alias("n_seq"),
        F.count("close").alias("n_close"),
        F.min(F.unix_micros("ExecutionTime")).alias("first_us"),
        F.max(F.unix_micros("ExecutionTime")).alias("last_us"),
        F.round(F.sum("high"), 4).alias("sum_high"),
    )


@query
def normalize_ts(spark, sf_dir):
    """Text times, some invalid, and missing ids: what is left after normalising."""
    events = table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_id") % 13 == 0, F.lit("not a time"))
        .when(F.col("event_id") % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("ts").cast("string"))
    )
    raw = events.select(
        F.when(F.col("event_id") % 19 != 0, F.col("event_type")).alias("ID"),
        text.alias("ExecutionTime"),
        F.col("value").alias("high"),
        F.col("event_id").alias("seq"),
    )
    rows = clean.usable_records(normalise_records(raw))
    return rows.select("ID", "seq", _us("ExecutionTime", "t_us"), "high", F.col("low").isNull().alias("low_missing"))


@query
def bars_scan(spark, sf_dir):
    """Stored bars read back up to the cutoff, which chooses folders by month."""
    path = scratch_path(spark, "stored_bars")
    write_bars(_bars(spark, sf_dir), path)
    return (
        splits.train_pool(read_bars(spark, path, until=P.cutoff()), P)
        .groupBy("asset")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.unix_seconds("t")).alias("last_s"))
    )


@query
def bars_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "stored_bars")
    write_bars(_bars(spark, sf_dir), path)
    return read_bars(spark, path).select("asset", _sec("t", "t_s"), *MEASURES)


@query
def top_n_assets(spark, sf_dir):
    return asset_source.first_assets(raw_ohlcv(spark, sf_dir).withColumnRenamed("ID", "asset"), 3)


_LISTED = ["  view", "absent-1", "", "click ", "purchase", "view", "absent-2"]


@query
def asset_allowlist(spark, sf_dir):
    """Rows of the listed assets: list order kept, cap 2 counted after unknown ids."""
    raw = raw_ohlcv(spark, sf_dir).withColumnRenamed("ID", "asset")
    kept = asset_source.listed_assets(raw, asset_source.asset_list(spark, _LISTED), cap=2)
    return raw.join(kept, "asset").groupBy("asset", "pos").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def asset_missing(spark, sf_dir):
    raw = raw_ohlcv(spark, sf_dir).withColumnRenamed("ID", "asset")
    return asset_source.unknown_assets(raw, asset_source.asset_list(spark, _LISTED)).select("asset", "pos")


@query(name="table_profile")
def table_profile_events(spark, sf_dir):
    return table_profile(table(spark, sf_dir, "events"))


@query(name="head_sample")
def head_sample_events(spark, sf_dir):
    return head_sample(raw_ohlcv(spark, sf_dir), ["seq", "ID"], 5).select(
        "ID", "seq", _us("ExecutionTime", "t_us"), *MEASURES
    )


@query(name="page_links")
def page_link_list(spark, sf_dir):
    return page_links(table(spark, sf_dir, "pages"), ".parquet").select("page_id", "link_pos", "href", "is_match")


@query
def skipped_files(spark, sf_dir):
    """Bars of all readable files, beside two that are none: rows by asset, and what the report says."""
    path = scratch_path(spark, "bars_with_broken_files")
    write_bars(_bars(spark, sf_dir), path)
    # text files among the data: every event as a line, in two files
    table(spark, sf_dir, "events").select(F.concat_ws(",", "event_id", "value").alias("value")).repartition(2).write.mode("append").text(path)
    report = bars_report(spark, path)
    bad = report.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n_skipped"))
    kept = read_bars(spark, path, skip_corrupt=True, report=report).groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows"))
    return kept.join(bad)


@query
def raw_by_id_roundtrip(spark, sf_dir):
    """Raw rows appended twice in folders by id, counted and summed from there."""
    path, raw = scratch_path(spark, "raw_by_id"), raw_ohlcv(spark, sf_dir)
    sinks.write_raw_by_id(raw, path)
    sinks.write_raw_by_id(raw.where("close is not null"), path)
    return spark.read.parquet(path).groupBy("ID").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("close").alias("n_close"), F.round(F.sum("high"), 4).alias("sum_high")
    )


@query
def results_csv(spark, sf_dir):
    """The baseline table written as CSV with a header and read back."""
    path = scratch_path(spark, "results_csv")
    sinks.write_results(baseline_results(_stored_bars(spark, sf_dir), P), path)
    stored = spark.read.option("header", "true").schema("asset string, feature string, baseline string, sMAPE double").csv(path)
    return stored.withColumn("sMAPE", F.round("sMAPE", 6))


@query
def forecasts_csv(spark, sf_dir):
    """Forecasts appended to a CSV folder in two parts, counted from there."""
    path, cells = scratch_path(spark, "forecasts_csv"), staged(_test_forecasts(spark, sf_dir), "forecasts")
    sinks.append_forecasts(cells.where("asset = 'view'"), path)
    sinks.append_forecasts(cells.where("asset <> 'view'"), path)
    stored = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return stored.groupBy("asset", "feature", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("pred"), 4).alias("sum_pred")
    )


# --- cleaning --------------------------------------------------------------


@query
def grid_bounds(spark, sf_dir):
    return clean.grid_bounds(clean.asset_spans(raw_ohlcv(spark, sf_dir)))


@query
def time_grid(spark, sf_dir):
    spans = staged(clean.asset_spans(raw_ohlcv(spark, sf_dir)), "spans")
    return clean.time_grid(spans.select("asset"), clean.find_grid(spans)).select("asset", _sec("t", "t_s"))


@query
def dedupe_last(spark, sf_dir):
    return clean.dedupe_last(raw_ohlcv(spark, sf_dir)).select("asset", _us("t", "t_us"), *MEASURES)


@query
def regular_bars(spark, sf_dir):
    return _bars(spark, sf_dir).select("asset", _sec("t", "t_s"), *MEASURES)


@query
def offgrid_rows(spark, sf_dir):
    return clean.cleaning_report(raw_ohlcv(spark, sf_dir))


@query(name="asset_summary")
def asset_summary_table(spark, sf_dir):
    return asset_summary(raw_ohlcv(spark, sf_dir)).select(
        "ID",
        "total_count",
        "nonzero_count",
        F.round("fraction_zero", 9).alias("fraction_zero"),
        _us("first_ts", "first_us"),
        _us("last_ts", "last_us"),
    )


# --- splits and gates ------------------------------------------------------


@query
def split_counts(spark, sf_dir):
    return splits.split_counts(_bars(spark, sf_dir), P).select(
        "asset", "split", "n_rows", _sec("first_t", "first_s"), _sec("last_t", "last_s")
    )


@query
def eval_origins(spark, sf_dir):
    return splits.eval_origins(_stored_bars(spark, sf_dir), P).select(
        "asset", _sec("t", "origin_s"), _sec("last_train", "last_train_s"), "close"
    )


def _uneven(spark, sf_dir):
    """Unfilled bars: series lengths differ, so the row gates have something to do."""
    return clean.dedupe_last(raw_ohlcv(spark, sf_dir))


@query
def eligible_assets(spark, sf_dir):
    return splits.eligible_assets(_uneven(spark, sf_dir), P, "validation")


@query
def eligible_models(spark, sf_dir):
    frame = supervised.validation_frame(_bars(spark, sf_dir), P)
    return stats.eligible_models(frame, P)


@query
def supervised_rows(spark, sf_dir):
    """Long supervised rows with a known target, counted and summed by model and split."""
    long = supervised.long_targets(supervised.validation_frame(_bars(spark, sf_dir), P), P, ["asset", "split"])
    return supervised.known_targets(long).groupBy("asset", "split", "feature", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("f_lag4").alias("n_lag4"),
        F.round(F.sum("y"), 4).alias("sum_y"),
        F.round(F.sum(F.col("y") * F.coalesce("f_lag1", F.lit(0.0))), 6).alias("sum_y_lag1"),
    )


@query
def unpivot_features(spark, sf_dir):
    long = stats.unpivot_features(_bars(spark, sf_dir), P)
    return long.select("asset", _sec("t", "t_s"), "feature", "value")


# --- windows and calendar --------------------------------------------------


@query
def calendar_features(spark, sf_dir):
    """Local hour and weekday of every order date and event time (the dates span many clock changes)."""
    orders = table(spark, sf_dir, "orders").select(
        F.timestamp_seconds(
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 96) * 900
        ).alias("t")
    )
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("t"))
    rows = windows.with_calendar(orders.unionByName(events), P)
    return rows.groupBy("hour", "dow").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.unix_micros("t")).alias("first_us"),
        F.max(F.unix_micros("t")).alias("last_us"),
    )


def _lag_output(df):
    return df.select("asset", _sec("t", "t_s"), *P.lag_columns)


@query
def lags_full(spark, sf_dir):
    return _lag_output(windows.with_lags(_bars(spark, sf_dir), P))


@query
def lags_by_split(spark, sf_dir):
    parts = splits.with_split(splits.train_pool(_bars(spark, sf_dir), P), P)
    return _lag_output(windows.with_lags(parts, P, ("asset", "split")))


@query
def lags_pooled(spark, sf_dir):
    return _lag_output(pooled.pooled_lags(_bars(spark, sf_dir), P))


@query
def lags_own(spark, sf_dir):
    """The per-feature variant: every feature with its own lags."""
    own = P.with_(lag_source="own")
    rows = windows.with_lags(_bars(spark, sf_dir), own)
    return rows.select("asset", _sec("t", "t_s"), *[f"{f}_lag{k}" for f in MEASURES for k in P.lags])


@query
def horizon_truth(spark, sf_dir):
    cells = truth_cells(_stored_bars(spark, sf_dir), P)
    return cells.select("asset", "feature", _sec("origin", "origin_s"), "horizon", "now", "truth")


@query
def asset_codes(spark, sf_dir):
    return ordering.asset_codes(raw_ohlcv(spark, sf_dir).select(F.col("ID").alias("asset")))


@query
def part_codes(spark, sf_dir):
    """Codes over a larger label set: part names."""
    labels = table(spark, sf_dir, "part").select(F.col("p_name").alias("asset"))
    return ordering.asset_codes(labels)


def _target_cells(rows: DataFrame) -> DataFrame:
    futures = F.arrays_zip(*[F.col(f"next_{f}").alias(f) for f in P.features])
    cells = rows.select("asset", "split", "t", F.posexplode(futures).alias("k", "y")).where("y.close is not null")
    return cells.select("asset", "split", _sec("t", "t_s"), (F.col("k") + 1).alias("horizon"), "y.*")


@query
def pooled_target(spark, sf_dir):
    """Targets of all features that run on into the next series at a series end."""
    frame = staged(pooled.pooled_frame(_stored_bars(spark, sf_dir), P), "pooled")
    return _target_cells(pooled.run_on_targets(frame, P))


@query
def pooled_target_gapped(spark, sf_dir):
    """Run-on targets over bars with gaps and missing values: steps count the kept rows."""
    frame = staged(pooled.pooled_frame(staged(_uneven(spark, sf_dir), "uneven"), P), "pooled")
    futures = F.arrays_zip(*[F.col(f"next_{f}").alias(f) for f in P.features])
    rows = pooled.run_on_targets(frame, P)
    cells = rows.select("asset", "split", "t", F.posexplode(futures).alias("k", "y")).where("y.close is not null")
    return cells.select("asset", "split", _us("t", "t_us"), (F.col("k") + 1).alias("horizon"), "y.*")


@query
def truth_gapped(spark, sf_dir):
    """Forecast cells over bars on the grid with gaps: the truth is that of the target's time, or missing."""
    on_grid = _uneven(spark, sf_dir).where(F.unix_micros("t") % (STEP_SECONDS * 1_000_000) == 0)
    cells = forecasts.baseline_test_forecasts(staged(on_grid, "gapped"), P, "persistence")
    return cells.select("asset", "feature", _us("origin", "origin_us"), "horizon", "pred", F.col("true").alias("truth"))


@query
def lags_gapped(spark, sf_dir):
    rows = windows.with_lags(_uneven(spark, sf_dir), P)
    return rows.select("asset", _us("t", "t_us"), *P.lag_columns)


@query
def asset_target(spark, sf_dir):
    """The other boundary: targets stop at the series end."""
    return _target_cells(pooled.pooled_frame(_stored_bars(spark, sf_dir), P))


# --- statistics ------------------------------------------------------------


def _train(bars):
    return bars.where(F.col("t") <= P.val_cutoff())


@query
def train_stats(spark, sf_dir):
    found = stats.train_stats(_train(_bars(spark, sf_dir)), P)
    return found.select("asset", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def activity_stats(spark, sf_dir):
    found = stats.activity_stats(_train(_bars(spark, sf_dir)), P)
    return found.select(
        "asset", "feature", *[F.round(c, 8).alias(c) for c in ("mean_abs", "std", "nonzero_frac")]
    )


@query
def activity_flags(spark, sf_dir):
    return stats.activity_flags(_train(_bars(spark, sf_dir)), P).select("asset", "feature", "is_active")


@query
def class_balance(spark, sf_dir):
    frame = windows.with_leads(_train(_bars(spark, sf_dir)), P)
    return stats.class_balance(frame, P)


@query
def describe_features(spark, sf_dir):
    rows = windows.with_calendar(pooled.pooled_lags(_bars(spark, sf_dir), P), P)
    found = stats.describe_columns(rows, [*P.lag_columns, "hour", "dow"])
    return found.select("column_name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _normalised(spark, sf_dir):
    """All targets (feature, horizon) with their lags, in units of the target's own series."""
    frame = staged(pooled.pooled_frame(_stored_bars(spark, sf_dir), P), "pooled")
    found = staged(stats.train_stats(frame.where("split = 'train'"), P), "stats")
    parts = []
    for feature in P.features:
        targets = F.posexplode(f"next_{feature}").alias("place", "target")
        rows = frame.select("asset", "t", "split", *P.lag_columns, targets).withColumns(
            {"feature": F.lit(feature), "horizon": F.col("place") + 1}
        )
        mine = pooled.normalised_rows(rows.drop("place"), found, feature, P.lag_columns, "target")
        parts.append(mine)
    return reduce(DataFrame.unionByName, parts)


_TARGET = ("asset", "split", "feature", "horizon")


@query
def zscore_features(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in (*P.lag_columns, "y_norm")]
    return _normalised(spark, sf_dir).select("asset", _sec("t", "t_s"), "feature", "horizon", *rounded)


@query
def zscore_roundtrip(spark, sf_dir):
    back = denormalised(F.col("y_norm"), F.col("mean"), F.col("std"))
    return _normalised(spark, sf_dir).groupBy(*_TARGET).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(back - F.col("y")) > 1e-9).alias("n_off"),
        F.round(F.sum(back), 4).alias("sum_back"),
    )


@query
def sample_weights(spark, sf_dir):
    weight = magnitude_weight(normalised(F.col("y"), F.col("mean"), F.col("std")))
    return _normalised(spark, sf_dir).groupBy(*_TARGET).agg(
        F.round(F.sum(weight), 4).alias("sum_weight"), F.round(F.min(weight), 6).alias("min_weight")
    )


@query
def nonzero_labels(spark, sf_dir):
    label = is_nonzero(denormalised(F.col("y_norm"), F.col("mean"), F.col("std")))
    return _normalised(spark, sf_dir).groupBy(*_TARGET).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(label).alias("n_nonzero")
    )


# --- forecasts -------------------------------------------------------------


@query
def gate_and_threshold(spark, sf_dir):
    """Missing model, gate and clamp over every bar: close/40000 as forecast, none on Wednesdays; hour/23 as probability, none on Sundays."""
    rows = windows.with_calendar(_bars(spark, sf_dir), P)
    chance = F.when(F.col("dow") != 6, F.col("hour") / 23)
    raw = F.when(F.col("dow") != 2, F.col("close") / 40000)
    pred = forecasts.post_processed(raw, chance, P)
    return rows.select("asset", _sec("t", "t_s"), F.round(pred, 12).alias("pred"))


def _baseline(spark, sf_dir, name):
    rows = baseline_forecasts(_stored_bars(spark, sf_dir), P, name)
    return rows.select("asset", "feature", _sec("origin", "origin_s"), "horizon", "truth", "pred")


@query
def baseline_zero(spark, sf_dir):
    return _baseline(spark, sf_dir, "zero")


@query
def baseline_persistence(spark, sf_dir):
    return _baseline(spark, sf_dir, "persistence")


@query
def forecast_frame(spark, sf_dir):
    cells = forecasts.baseline_test_forecasts(_stored_bars(spark, sf_dir), P, "persistence")
    return cells.select(
        "asset",
        "feature",
        _sec("origin", "origin_s"),
        "horizon",
        _sec("target_time", "target_s"),
        "pred",
        F.col("true").alias("truth"),
    )


@query
def inactive_eval(spark, sf_dir):
    found = evaluation.inactive_eval(_stored_bars(spark, sf_dir), P)
    return found.withColumn("sMAPE", F.round("sMAPE", 6))


# --- scores ----------------------------------------------------------------


@query
def smape_unit(spark, sf_dir):
    """Score over raw rows with missing and zero cells: close against low."""
    raw = raw_ohlcv(spark, sf_dir)
    return raw.groupBy("ID").agg(
        F.round(smape(F.col("close"), F.col("low")), 6).alias("sMAPE"), F.count(F.lit(1)).alias("n_cells")
    )


@query(name="baseline_results")
def baseline_results_table(spark, sf_dir):
    found = baseline_results(_stored_bars(spark, sf_dir), P)
    return found.withColumn("sMAPE", F.round("sMAPE", 6))


def _test_forecasts(spark, sf_dir):
    return forecasts.baseline_test_forecasts(_stored_bars(spark, sf_dir), P, "persistence")


def _test_results(spark, sf_dir):
    return evaluation.forecast_eval(_test_forecasts(spark, sf_dir))


@query
def forecast_eval(spark, sf_dir):
    return _test_results(spark, sf_dir).withColumn("sMAPE", F.round("sMAPE", 6))


@query
def eval_summary(spark, sf_dir):
    found = evaluation.eval_summary(staged(_test_results(spark, sf_dir), "results"))
    return found.select(
        "feature",
        "horizon",
        F.round("mean_sMAPE", 6).alias("mean_sMAPE"),
        F.round("median_sMAPE", 6).alias("median_sMAPE"),
        "n_assets",
        "n_rows",
    )


@query
def worst_assets(spark, sf_dir):
    found = evaluation.worst_assets(_test_results(spark, sf_dir))
    return found.withColumn("mean_sMAPE", F.round("mean_sMAPE", 6))


@query
def median_skewed(spark, sf_dir):
    """Exact medians of all event values by user, where a third of all rows belong to one and half of all values are equal."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    value = F.when(F.col("event_id") % 2 == 0, F.lit(50.0)).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(user.alias("user_id"), value.alias("value"))
    return evaluation.exact_median(rows, ["user_id"], "value").withColumn("median_value", F.round("median_value", 6))


def _user_records(spark, sf_dir):
    """A second source of raw records: one series per user, over all events."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ID"), F.col("ts").cast("timestamp").alias("ExecutionTime"),
        F.when(value >= 20, value).otherwise(0.0).alias("high"), F.when(value >= 20, value / 2).otherwise(0.0).alias("low"),
        F.when(value >= 20, value * 0.75).otherwise(0.0).alias("close"), F.lit(0.0).alias("volume"), F.col("event_id").alias("seq"),
    )


@query
def asset_summary_users(spark, sf_dir):
    """The summary of every user's series from partial summaries stored by day."""
    raw = _user_records(spark, sf_dir).withColumn("day", F.to_date("ExecutionTime"))
    partials = staged(partial_summaries(raw, ["day"]), "partials")
    return merged_summary(partials).select(
        "ID", "total_count", "nonzero_count", F.round("fraction_zero", 9).alias("fraction_zero"),
        _us("first_ts", "first_us"), _us("last_ts", "last_us"),
    )


@query
def worst_assets_users(spark, sf_dir):
    """The 20 users whose value the one before predicts worst."""
    bars = _user_records(spark, sf_dir).select(F.col("ID").alias("asset"), F.col("ExecutionTime").alias("t"), "seq", "high", "close")
    ordered = Window.partitionBy("asset").orderBy("t", "seq")
    before = bars.select("asset", F.lit("high").alias("feature"), F.lit(1).alias("horizon"), F.lag("high").over(ordered).alias("pred"), F.col("high").alias("true"))
    scored = evaluation.forecast_eval(before.where("pred is not null"))
    return evaluation.worst_assets(scored).withColumn("mean_sMAPE", F.round("mean_sMAPE", 6))


@query
def stream_summary(spark, sf_dir):
    """The running summary of raw files that arrive one by one, kept as a stored table."""
    root = scratch_path(spark, "stream")
    raw_ohlcv(spark, sf_dir).select(*RAW_SCHEMA.names).repartition(6).write.parquet(f"{root}/in")
    stream = stream_raw(spark, f"{root}/in", files_per_batch=1)
    start_stored_summary(stream, f"{root}/checkpoint", f"{root}/state", once=True, compact_every=4).awaitTermination()
    return stored_summary(spark, f"{root}/state").select(
        "ID", "total_count", "nonzero_count", F.round("fraction_zero", 9).alias("fraction_zero"),
        _us("first_ts", "first_us"), _us("last_ts", "last_us"),
    )


@query
def refit_partial(spark, sf_dir):
    """Stored forecasts after a second run over two assets, one of which got none: others keep those of the first run."""
    path, cells = scratch_path(spark, "forecast_runs"), staged(_test_forecasts(spark, sf_dir), "forecasts")
    sinks.write_forecasts(cells, path)
    chosen = spark.createDataFrame([("view",), ("click",)], "asset string")
    sinks.write_forecasts(cells.where("asset = 'view'").withColumn("pred", F.lit(-1.0)), path, chosen)
    return sinks.read_forecasts(spark, path).groupBy("asset", "feature", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("true").alias("n_truth"), F.round(F.sum("pred"), 4).alias("sum_pred")
    )


@query
def per_asset_rows(spark, sf_dir):
    """What every model of an active series is fitted and scored on."""
    bars = _stored_bars(spark, sf_dir)
    active = staged(stats.activity_flags(_train(bars), P).where("is_active").select("asset", "feature"), "active")
    return stats.eligible_models(supervised.validation_frame(bars, P), P).join(active, ["asset", "feature"], "left_semi")


@query
def refit_cells(spark, sf_dir):
    """The cells that refitted models forecast: every test origin with its target's time and truth."""
    cells = forecasts.baseline_test_forecasts(_stored_bars(spark, sf_dir), P, "zero")
    return cells.select("asset", "feature", _sec("origin", "origin_s"), "horizon", _sec("target_time", "target_s"), F.col("true").alias("truth"))


# --- models (no SQL counterpart) -------------------------------------------


@query(name="per_asset_eval")
def per_asset_models(spark, sf_dir):
    """All 4 × 10 models of every series, fitted on train and scored on validation."""
    return per_asset_eval(_stored_bars(spark, sf_dir), P)


@query(name="refit_forecasts")
def refit_models(spark, sf_dir):
    """All models refitted up to the cutoff; forecasts of the test period with their truth."""
    return refit_forecasts(_stored_bars(spark, sf_dir), P).select(
        "asset",
        "feature",
        _sec("origin", "origin_s"),
        "horizon",
        _sec("target_time", "target_s"),
        "pred",
        F.col("true").alias("truth"),
    )


@query
def pooled_rows(spark, sf_dir):
    """Rows, non-zero targets and weights that each of the 4 × 10 shared models is fitted on."""
    frame = pooled.pooled_supervised(_stored_bars(spark, sf_dir), P)
    found = stats.train_stats(frame.where("split = 'train'"), P)
    return shared.pooled_rows(frame, found, P).withColumn("sum_weight", F.round("sum_weight", 4))


@query(name="pooled_eval")
def pooled_models(spark, sf_dir):
    """All 4 × 10 shared models over all series, with all their rounds."""
    return shared.pooled_eval(_stored_bars(spark, sf_dir), P)
