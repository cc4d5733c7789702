import math
import random

import numpy as np
import pytest
from conftest import BARS, SF, series
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.functions.scoring import smape
from barcast.operators.clean import regular_bars
from barcast.operators.evaluation import eval_summary, exact_median, forecast_eval, inactive_eval, worst_assets
from barcast.operators.learner import Binning, balanced_logit, boosted_forecast, probability
from barcast.operators.baselines import baseline_results
from barcast.operators.pooled_models import best_prefix, fitted, pooled_eval
from barcast.operators.series_models import per_asset_eval, refit_forecasts
from barcast.plans.fixture import FIXTURE_PARAMS, raw_ohlcv
from barcast.session import staged


def cycle(i: int, shift: float = 0.0) -> float:
    return 10 + 8 * math.sin(2 * math.pi * (i + shift) / 96)


@pytest.fixture(scope="module")
def learnable(spark):
    """Three assets whose measures follow a daily cycle; 2,000 rows each."""
    rows = [r for k, a in enumerate("ABC") for r in series(a, "2024-01-01", [cycle(i, 7 * k) for i in range(2000)])]
    return staged(spark.createDataFrame(rows, BARS), "learnable")


P = Params(horizon=3, features=("close", "volume"), train_cutoff="2024-01-17T00:00+00:00", val_days=4, rounds=60)


def test_per_asset_models_score_low_and_repeat(spark, learnable):
    found = per_asset_eval(learnable, P)
    baseline = {(r["asset"], r["feature"], r["baseline"]): r["sMAPE"] for r in baseline_results(learnable, P).collect()}
    rows = found.collect()
    assert len(rows) == 3 * 2 * 3
    for r in rows:
        assert r["sMAPE"] < baseline[r["asset"], r["feature"], "persistence"] and r["n_val"] == 4 * 96 - r["horizon"]
    again = {(r["asset"], r["feature"], r["horizon"]): r["sMAPE"] for r in per_asset_eval(learnable, P).collect()}
    assert again == {(r["asset"], r["feature"], r["horizon"]): r["sMAPE"] for r in rows}


def test_refit_forecasts_cover_every_test_origin(spark, learnable):
    out = staged(refit_forecasts(learnable, P.with_(refit_rounds=40)), "refit")
    n_test = 2000 - 16 * 96 - 1
    assert out.count() == 3 * 2 * 3 * n_test
    assert out.where("`true` is null").groupBy("horizon").count().orderBy("horizon").collect()[2]["count"] == 3 * 2 * 3
    scores = forecast_eval(out)
    for r in scores.collect():
        assert r["sMAPE"] < 15.0 and r["n"] == n_test - r["horizon"]
    truth = learnable.select("asset", F.col("t").alias("target_time"), F.col("close").alias("expected"))
    wrong = out.where("feature = 'close'").join(truth, ["asset", "target_time"]).where("`true` <> expected").count()
    assert wrong == 0


def test_short_series_get_zeros_and_too_short_ones_nothing(spark):
    def asset(name, before):
        values = [5.0 + i % 3 for i in range(before + 20)]
        return [(name, t, *v) for (_, t, *v) in series(name, "2024-01-01", values)][: before + 20]

    params = Params(horizon=10, features=("close",), refit_rounds=5, train_cutoff="2024-01-01T09:45+00:00")
    # "mid" starts at 00:00 (40 rows up to the cutoff), "tiny" at 05:00 (20 rows)
    rows = asset("mid", 40) + series("tiny", "2024-01-01 05:00", [5.0] * 40)
    out = refit_forecasts(spark.createDataFrame(rows, BARS), params).collect()
    assert {r["asset"] for r in out} == {"mid"} and {r["pred"] for r in out} == {0.0}


def test_gate_adds_exact_zeros_on_sparse_series(spark):
    rng = random.Random(1)
    values = [(20 + rng.random() if (i // 4) % 24 >= 17 else 0.0) for i in range(2000)]
    bars = staged(spark.createDataFrame(series("Z", "2024-01-01", values), BARS), "sparse")
    params = P.with_(features=("close",), refit_rounds=30)

    def zeros_and_score(p):
        out = staged(refit_forecasts(bars, p), "gate")
        row = out.where("`true` is not null").agg(
            F.avg((F.col("pred") == 0).cast("int")).alias("z"), smape(F.col("true"), F.col("pred")).alias("s")
        ).first()
        return row["z"], row["s"]

    gated, open_ = zeros_and_score(params), zeros_and_score(params.with_(use_classifier=False))
    assert gated[0] > open_[0] and gated[1] <= open_[1]


def test_inactive_series_are_reported_with_zero_forecasts(spark):
    rows = inactive_eval(staged(regular_bars(raw_ohlcv(spark, SF)), "bars"), FIXTURE_PARAMS).collect()
    assert {r["asset"] for r in rows} == {"dormant"} and len(rows) == 40
    assert all((r["n_train"], r["n_val"]) == (1724 - r["horizon"], 672 - r["horizon"]) for r in rows)


def test_pooled_models_beat_the_baselines(spark, learnable):
    """Rounds of every model lie within their bounds; on a learnable cycle the scores lie below both baselines."""
    quick = P.with_(features=("close",), horizon=3, lag_source="own", boundary="asset", pooled_rounds=60, patience=5)
    rows = pooled_eval(learnable, quick).collect()
    assert [(r["feature"], r["horizon"]) for r in rows] == [("close", h) for h in (1, 2, 3)]
    worst = {r["baseline"]: min(r["sMAPE"], 1e9) for r in baseline_results(learnable, quick).where("asset = 'A'").collect()}
    for r in rows:
        assert 1 <= r["rounds"] <= 60 and r["sMAPE"] < worst["persistence"] < worst["zero"]
        # nothing is ever zero here, so the gate changes nothing
        assert r["gate_rounds"] == 0 and r["sMAPE_gated"] == r["sMAPE"]


def test_pooled_gate_on_sparse_series(spark):
    rng = random.Random(1)
    values = [(20 + rng.random() if (i // 4) % 24 >= 17 else 0.0) for i in range(2000)]
    bars = staged(spark.createDataFrame(series("Z", "2024-01-01", values), BARS), "sparse")
    row = pooled_eval(bars, P.with_(features=("close",), pooled_rounds=10, pooled_gate_rounds=10, patience=5), horizons=[1]).first()
    assert row["gate_rounds"] > 0 and row["sMAPE_gated"] < row["sMAPE"]


def test_best_prefix():
    assert best_prefix([3.0, 2.0, 2.5, 1.0, 1.0, 4.0], 2) == (4, True)
    assert best_prefix([3.0, 2.0, 2.5, 2.6, 1.0], 2) == (2, True)
    assert best_prefix([3.0, 2.0, 1.0], 5) == (3, False)


def test_own_lags_and_series_boundary(spark, learnable):
    own = P.with_(lag_source="own", boundary="asset", rounds=5, pooled_rounds=3, horizon=2)
    assert per_asset_eval(learnable, own).count() == 3 * 2 * 2
    out = pooled_eval(learnable, own, features=("close", "volume"), horizons=[2], parallelism=2)
    assert {(r["feature"], r["horizon"]) for r in out.collect()} == {("close", 2), ("volume", 2)}


def test_pooled_models_need_rows(spark):
    bars = spark.createDataFrame(series("A", "2024-01-01", [1.0] * 30), BARS)
    with pytest.raises(ValueError):
        pooled_eval(bars, P)


def _numeric_frame(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(400).select(
        (F.col("id") % 37).cast("double").alias("a"),
        (F.col("id") % 37 > 20).cast("double").alias("label"),
        ((F.col("id") % 37) * 2.0).alias("y"),
        (F.col("id") % 5 + 1).cast("double").alias("w"),
        F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"),
    )
    return VectorAssembler(inputCols=["a"], outputCol="x").transform(df)


def _parts(rows):
    return rows.where("split = 'train'"), rows.where("split = 'val'")


def test_boosting_losses_fall_and_patience_stops(spark):
    from pyspark.ml.regression import GBTRegressor

    rows = _numeric_frame(spark)
    learner = GBTRegressor(featuresCol="x", labelCol="y", weightCol="w", maxDepth=3, stepSize=0.5, seed=1)
    learned = fitted(learner, *_parts(rows), 6, 3)
    assert learned.losses == sorted(learned.losses, reverse=True) and learned.model.getNumTrees == learned.rounds
    noise = rows.withColumn("y", F.when(F.col("split") == "val", -F.col("y")).otherwise(F.col("y")))
    stopped = fitted(learner, *_parts(noise), 20, 2)
    assert stopped.rounds < 20 and stopped.model.getNumTrees == stopped.rounds and len(stopped.losses) == 4


def test_boosted_classes_separate(spark):
    from pyspark.ml.classification import GBTClassifier

    rows = _numeric_frame(spark)
    learned = fitted(GBTClassifier(featuresCol="x", labelCol="label", maxDepth=3, maxBins=64, seed=1), *_parts(rows), 5, 5)
    assert learned.losses[-1] < learned.losses[0]
    assert learned.model.transform(rows).where("prediction <> label").count() == 0


def test_balanced_logit_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    label = (x[:, 0] + rng.normal(size=500) > 0.8).astype(float)
    w = balanced_logit(x, label)
    share = np.where(label == 1, 500 / (2 * label.sum()), 500 / (2 * (500 - label.sum())))
    pull = share * (probability(x, w) - label)
    assert np.abs(np.append(x.T @ pull + w[:-1], pull.sum())).max() < 1e-3
    assert balanced_logit(x, np.zeros(500)) is None


def test_trees_handle_missing_values_and_small_leaves():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    x[:100, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 50.0, x[:, 1])
    bins = Binning(x)
    codes = bins.codes(x)
    pred, used = boosted_forecast(codes, y, codes, bins.width, 100)
    assert used == 100 and abs(pred[:100] - 50).max() < 3 and np.corrcoef(pred[100:], y[100:])[0, 1] > 0.95
    few = codes[:30]
    flat, _ = boosted_forecast(few, y[:30], few, bins.width, 10)
    assert np.allclose(flat, y[:30].mean())


def test_exact_median_with_ties_and_even_counts(spark):
    rng = random.Random(5)
    groups = {k: [round(rng.random() * 200, 2) for _ in range(n)] + [0.0] * z for k, n, z in (("a", 501, 0), ("b", 300, 900), ("c", 40, 40), ("d", 1, 0))}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median_v"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: pytest.approx(float(np.median(vs))) for k, vs in groups.items()}


def test_exact_median_over_uneven_values(spark):
    """Values of very different size, negative ones, missing ones, and one value in half of the rows."""
    rng = random.Random(6)
    groups = {i: [rng.choice([1e-9, 7.0, 7.0, -1e6, 1e12]) * rng.random() if rng.random() < 0.5 else 7.0 for _ in range(rng.randint(1, 60))] for i in range(40)}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(1, None), (2, float("nan")), (99, None)]
    got = {r["k"]: r["median_v"] for r in exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert got == {k: pytest.approx(float(np.median(vs))) for k, vs in groups.items()}


def test_summary_and_worst_assets(spark):
    rows = [(a, "close", h, s, 5) for a, s in (("a", 10.0), ("b", 30.0), ("c", 30.0)) for h in (1, 2)]
    results = spark.createDataFrame(rows, "asset string, feature string, horizon int, sMAPE double, n long")
    assert [r["asset"] for r in worst_assets(results, 2).collect()] == ["b", "c"]
    row = eval_summary(results).where("horizon = 1").first()
    assert (row["n_assets"], row["n_rows"], row["median_sMAPE"]) == (3, 15, 30.0)
    assert row["mean_sMAPE"] == pytest.approx(70 / 3)
