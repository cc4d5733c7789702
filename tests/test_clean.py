import random
from datetime import timedelta

import pandas as pd
import pytest
from conftest import RAW, SF, utc
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.functions.times import grid_ceil, grid_floor, local_hour, local_weekday, seconds_before
from barcast.operators.clean import Grid, cleaning_report, dedupe_last, find_grid, asset_spans, regular_bars, time_grid
from barcast.operators.summary import asset_summary, table_profile
from barcast.plans.fixture import raw_ohlcv


def rec(asset, when, high, seq, close=1.0):
    return (asset, utc(when) if when else None, high, 0.0, close, 0.0, seq)


def test_last_known_value_per_measure(spark):
    raw = spark.createDataFrame(
        [rec("A", "2024-01-01 10:00", 1.0, 1, 5.0), rec("A", "2024-01-01 10:00", 2.0, 2, None)], RAW
    )
    row = dedupe_last(raw).first()
    assert (row["high"], row["close"]) == (2.0, 5.0)


def test_grid_drops_off_grid_rows_and_fills_zeros(spark):
    raw = spark.createDataFrame(
        [
            rec("A", "2024-01-01 10:00", 1.0, 1),
            rec("A", "2024-01-01 10:07", 9.0, 2),
            rec("B", "2024-01-01 10:30", 3.0, 3),
            rec(None, "2024-01-01 12:00", 3.0, 4),
        ],
        RAW,
    )
    rows = regular_bars(raw).orderBy("asset", "t").collect()
    assert [(r["asset"], r["high"]) for r in rows] == [
        ("A", 1.0), ("A", 0.0), ("A", 0.0), ("B", 0.0), ("B", 0.0), ("B", 3.0)
    ]
    report = {r["asset"]: r for r in cleaning_report(raw).collect()}
    assert report["A"]["n_off_grid"] == 1 and report["A"]["n_filled_slots"] == 2
    assert report["B"]["n_off_grid"] == 0


def test_asset_without_any_valid_time_becomes_zeros(spark):
    raw = spark.createDataFrame([rec("A", "2024-01-01 10:00", 1.0, 1), rec("C", None, 7.0, 2)], RAW)
    assert {(r["asset"], r["high"]) for r in regular_bars(raw).collect()} == {("A", 1.0), ("C", 0.0)}


def test_no_valid_time_at_all_fails(spark):
    raw = spark.createDataFrame([rec("A", None, 1.0, 1)], RAW)
    with pytest.raises(ValueError):
        regular_bars(raw)


def test_grid_steps_through_a_clock_change(spark):
    lo, hi = int(utc("2023-10-28 22:00").timestamp()), int(utc("2023-10-29 03:00").timestamp())
    assets = spark.createDataFrame([("A",)], "asset string")
    grid = time_grid(assets, Grid(lo, hi, 1)).select("t", local_hour(F.col("t")).alias("hour"))
    rows = {r["t"].isoformat(): r["hour"] for r in grid.select(F.date_format("t", "HH:mm").alias("k"), "t", "hour").collect()}
    assert len(rows) == 21
    twice = grid.where(F.col("hour") == 2).count()
    assert twice == 8


def test_elapsed_days_ignore_clock_changes(spark):
    df = spark.createDataFrame([(utc("2023-11-01 22:30"),)], "t timestamp")
    out = df.select(F.date_format(seconds_before(F.col("t"), 28 * 86400), "yyyy-MM-dd HH:mm").alias("s")).first()
    assert out["s"] == "2023-10-04 22:30"


def test_cutoff_is_local_unless_it_names_an_offset(spark):
    df = spark.range(1)

    def shown(p):
        return df.select(F.date_format(p.cutoff(), "yyyy-MM-dd HH:mm").alias("s")).first()["s"]

    assert shown(Params()) == "2023-12-31 22:45"
    assert shown(Params(train_cutoff="2024-07-01T12:00+00:00")) == "2024-07-01 12:00"
    assert shown(Params(train_cutoff="2024-07-01T12:00")) == "2024-07-01 10:00"


def test_floor_and_ceil(spark):
    df = spark.createDataFrame([(utc("2024-01-01 10:07:30"),), (utc("2024-01-01 10:15"),)], "t timestamp")
    rows = df.select(F.unix_seconds("t").alias("s"), grid_floor(F.col("t")).alias("lo"), grid_ceil(F.col("t")).alias("hi"))
    a, b = rows.orderBy("s").collect()
    assert a["hi"] - a["lo"] == 900 and a["lo"] % 900 == 0
    assert b["lo"] == b["hi"] == b["s"]


def test_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([(utc("2024-01-01 12:00"),)], "t timestamp")
    assert df.select(local_weekday(F.col("t")).alias("d")).first()["d"] == 0


def test_missing_measure_is_not_a_zero_row(spark):
    raw = spark.createDataFrame([("A", utc("2024-01-01"), 0.0, 0.0, None, 0.0, 1), ("A", utc("2024-01-02"), 0.0, 0.0, 0.0, 0.0, 2)], RAW)
    row = asset_summary(raw).first()
    assert (row["total_count"], row["nonzero_count"], row["fraction_zero"]) == (2, 1, 0.5)


def test_fixture_counts(spark):
    """Row counts stated for the derived fixture at the smallest scale."""
    raw = raw_ohlcv(spark, SF)
    assert raw.count() == 1001
    report = cleaning_report(raw).agg(F.sum("n_off_grid"), F.sum("n_repeated")).first()
    assert tuple(report) == (100, 33)
    assert raw.where("close is null").count() == 143
    bars = regular_bars(raw)
    assert bars.count() == 17_268
    grid = find_grid(asset_spans(raw))
    assert bars.count() == grid.n_assets * grid.n_slots
    nulls = table_profile(bars).agg(F.sum("n_null")).first()[0]
    assert nulls == 0


def test_cleaning_equals_brute_force_under_skew(spark):
    """A third of the rows in one asset, a ninth on one (asset, time); compared row by row with pandas."""
    rng = random.Random(11)
    start = utc("2024-03-30 20:00")
    rows = []
    for seq in range(6000):
        asset = "hot" if seq % 3 == 0 else f"a{rng.randrange(12)}"
        minutes = 45 if seq % 9 == 0 else rng.randrange(96) * 15 + (7 if rng.random() < 0.1 else 0)
        values = [None if rng.random() < 0.3 else float(rng.randrange(5)) for _ in range(4)]
        rows.append((asset, start + timedelta(minutes=minutes), *values, seq))
    raw = spark.createDataFrame(rows, RAW).repartition(16)
    got = {(r["asset"], r["t"]): tuple(r[2:]) for r in regular_bars(raw).select(
        "asset", F.date_format("t", "yyyy-MM-dd HH:mm").alias("t"), "high", "low", "close", "volume").collect()}

    frame = pd.DataFrame(rows, columns=["asset", "t", "high", "low", "close", "volume", "seq"])
    grid = pd.date_range(frame["t"].min().floor("15min"), frame["t"].max().ceil("15min"), freq="15min")
    want = {}
    for asset, part in frame.sort_values("seq").groupby("asset"):
        bars = part.set_index("t")[["high", "low", "close", "volume"]].groupby(level=0).last().reindex(grid).fillna(0.0)
        for when, values in zip(bars.index, bars.to_numpy()):
            want[(asset, when.strftime("%Y-%m-%d %H:%M"))] = tuple(values)
    assert got == want


def test_one_exchange_and_hash_aggregation(spark):
    plan = regular_bars(raw_ohlcv(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(ID") == 1
