import random

import pytest
from conftest import BARS, SF, series
from pyspark.sql import functions as F

from barcast.config import Params, parse_features
from barcast.operators import pooled, splits, stats, supervised, windows
from barcast.operators.clean import regular_bars
from barcast.operators.ordering import asset_codes, with_positions
from barcast.plans.fixture import FIXTURE_PARAMS, raw_ohlcv
from barcast.session import staged


def test_lags_come_from_the_last_listed_feature(spark):
    bars = spark.createDataFrame(series("A", "2024-01-01", [1.0, 2.0, 3.0], [7.0, 8.0, 9.0]), BARS)

    def first_lags(features):
        rows = windows.with_lags(bars, Params(features=features)).orderBy("t").collect()
        return [r["f_lag1"] for r in rows]

    assert first_lags(("high", "low", "close", "volume")) == [None, 7.0, 8.0]
    assert first_lags(("volume", "close")) == [None, 1.0, 2.0]
    own = windows.with_lags(bars, Params(lag_source="own")).orderBy("t").collect()
    assert [(r["close_lag1"], r["volume_lag1"]) for r in own] == [(None, None), (1.0, 7.0), (2.0, 8.0)]


@pytest.mark.parametrize("chunk", [10, 16, 4096])
def test_chunked_windows_equal_plain_windows(spark, chunk):
    rng = random.Random(chunk)
    rows = [r for a in "ABC" for r in series(a, "2023-12-31 21:00", [rng.random() for _ in range(57)])]
    bars = spark.createDataFrame(rows, BARS)
    params = Params(chunk_slots=chunk)
    plain = windows.with_lags_and_leads(bars, params.with_(chunk_slots=None))
    cut = windows.with_lags_and_leads(bars, params)
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_chunk_must_cover_the_shifts(spark):
    bars = spark.createDataFrame(series("A", "2024-01-01", [1.0]), BARS)
    with pytest.raises(ValueError):
        windows.with_lags_and_leads(bars, Params(chunk_slots=5))


@pytest.mark.parametrize("chunk", [16, 64, 4096])
def test_chunks_do_not_matter_on_gapped_bars(spark, chunk):
    rng = random.Random(chunk)
    rows = [r for r in series("A", "2024-01-01", [float(i) for i in range(58 * 58)])][::58]
    rows += [r for r in series("B", "2024-01-01", [float(i) for i in range(900)]) if rng.random() < 0.2]
    bars = spark.createDataFrame(rows, BARS)
    params = Params(chunk_slots=chunk)
    plain = windows.with_lags_and_leads(bars, params.with_(chunk_slots=None))
    assert sorted(map(str, windows.with_lags_and_leads(bars, params).collect())) == sorted(map(str, plain.collect()))


def test_truth_is_matched_by_time(spark):
    kept = [r for i, r in enumerate(series("A", "2024-01-01", [float(i) for i in range(12)])) if i not in (2, 3)]
    bars = spark.createDataFrame(kept, BARS)
    params = Params(horizon=4)
    for p in (params, params.with_(chunk_slots=8)):
        rows = windows.by_time(windows.with_lags_and_times(bars, p), p, "next").orderBy("t").collect()
        assert rows[0]["next_close"] == [1.0, None, None, 4.0]
        assert rows[1]["next_close"] == [None, None, 4.0, 5.0]
        assert rows[-1]["next_close"] == [None] * 4


def test_only_chunk_borders_are_grouped_by_asset_alone(spark):
    bars = staged(regular_bars(raw_ohlcv(spark, SF)), "bars")
    plan = windows.with_lags_and_leads(bars, FIXTURE_PARAMS)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(asset" in line]
    whole = [line for line in exchanges if "_chunk" not in line]
    assert len(whole) == 1 and len(exchanges) > 1


def test_split_scope_resets_lags(spark):
    values = [float(i) for i in range(12)]
    params = Params(train_cutoff="2024-01-01T02:30+00:00", val_days=0)
    bars = spark.createDataFrame(series("A", "2024-01-01", values), BARS)
    # val_days=0: everything up to the cutoff is train
    frame = supervised.validation_frame(bars, params).orderBy("t").collect()
    assert [r["split"] for r in frame] == ["train"] * 11
    assert [r["f_lag1"] for r in frame][:3] == [None, 0.0, 1.0]
    assert frame[-1]["next_close"][0] is None and frame[-2]["next_close"][0] == 10.0


def test_split_sizes_of_the_fixture(spark):
    bars = regular_bars(raw_ohlcv(spark, SF))
    counts = {(r["asset"], r["split"]): r["n_rows"] for r in splits.split_counts(bars, FIXTURE_PARAMS).collect()}
    assert {counts[("click", s)] for s in ("train", "val", "test")} == {1724, 672, 482}


def _tiny_pool(spark, features):
    rows = series("A", "2024-01-01", [1.0, 2.0, 3.0]) + series("B", "2024-01-01", [10.0, 20.0, 30.0])
    bars = spark.createDataFrame(rows, BARS)
    params = Params(horizon=2, features=features, train_cutoff="2024-02-01", val_days=1)
    led = windows.with_leads(splits.with_split(bars, params), params)
    return staged(led, "tiny"), params


def test_pooled_target_runs_into_the_next_series(spark):
    frame, params = _tiny_pool(spark, ("close",))
    rows = pooled.run_on_targets(frame, params).orderBy("asset", "t").collect()
    assert [r["next_close"][1] for r in rows] == [3.0, 10.0, 20.0, 30.0, None, None]
    assert [r["next_close"][0] for r in rows] == [2.0, 3.0, 10.0, 20.0, 30.0, None]


def test_pooled_target_passes_over_short_series(spark):
    rows = [r for a, v in (("A", [1.0, 2.0]), ("B", [5.0]), ("C", [7.0, 8.0])) for r in series(a, "2024-01-01", v)]
    params = Params(horizon=3, features=("close",), train_cutoff="2024-02-01", val_days=1)
    frame = staged(windows.with_leads(splits.with_split(spark.createDataFrame(rows, BARS), params), params), "short")
    out = pooled.run_on_targets(frame, params).orderBy("asset", "t").collect()
    assert [r["next_close"] for r in out] == [
        [2.0, 5.0, 7.0], [5.0, 7.0, 8.0], [7.0, 8.0, None], [8.0, None, None], [None, None, None]
    ]


def test_series_boundary_option(spark):
    frame, params = _tiny_pool(spark, ("close",))
    kept = frame.orderBy("asset", "t").collect()
    assert [r["next_close"][1] for r in kept] == [3.0, None, None, 30.0, None, None]


def test_positions_over_many_partitions(spark):
    df = spark.range(1000).select(F.format_string("k%05d", (F.col("id") * 7919) % 1000).alias("k"), F.col("id") % 5)
    df = df.toDF("k", "size")
    rows = with_positions(df, F.col("k"), ["size"], "many").orderBy("k").collect()
    assert [r["pos"] for r in rows] == list(range(1000))
    total = 0
    for r in rows:
        assert r["size_start"] == total
        total += r["size"]


def test_codes_follow_label_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "asset string")
    assert {r["asset"]: r["asset_code"] for r in asset_codes(df).collect()} == {"a": 0, "b": 1, "c": 2}


def test_activity_and_class_edges(spark):
    one = spark.createDataFrame([(0.01, 0.0, 0.0)], "mean_abs double, std double, nonzero_frac double")
    assert one.select(stats.is_active(Params()).alias("a")).first()["a"]
    below = spark.createDataFrame([(0.0099, 0.0099, 0.049)], "mean_abs double, std double, nonzero_frac double")
    assert not below.select(stats.is_active(Params()).alias("a")).first()["a"]
    gates = spark.createDataFrame([(0, 5, 20), (1, 6, 12), (2, 6, 11)], "i int, n_nonzero int, n int")
    assert [r["g"] for r in gates.select("i", stats.class_gate().alias("g")).orderBy("i").collect()] == [False, True, False]


def test_unusable_spread_becomes_one(spark):
    bars = spark.createDataFrame(series("A", "2024-01-01", [4.0, 4.0]) + series("B", "2024-01-01", [1.0]), BARS)
    assert {r["std"] for r in stats.train_stats(bars, Params()).collect()} == {1.0}


def test_model_rows_shrink_with_the_horizon(spark):
    frame = supervised.validation_frame(regular_bars(raw_ohlcv(spark, SF)), FIXTURE_PARAMS)
    for r in stats.model_rows(frame, FIXTURE_PARAMS).collect():
        assert (r["n_train"], r["n_val"]) == (1724 - r["horizon"], 672 - r["horizon"])


def test_pooled_assets_without_train_rows_are_reported(spark):
    frame = spark.createDataFrame([("A", "train"), ("A", "val"), ("B", "val")], "asset string, split string")
    assert [r["asset"] for r in pooled.assets_without_train(frame).collect()] == ["B"]


def test_parameters_are_checked():
    assert parse_features(" close, high ,,") == ("close", "high")
    for bad in (dict(lag_source="x"), dict(boundary="x"), dict(features=()), dict(features=("open",)), dict(horizon=0)):
        with pytest.raises(ValueError):
            Params(**bad)
