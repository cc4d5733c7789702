"""Models over few rows are fitted in tasks, and are those that pyspark.ml fits."""

import random

import numpy as np
import pytest
from conftest import BARS, series
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.operators import level_trees, pooled_models
from barcast.operators.pooled import pooled_supervised
from barcast.operators.stats import train_stats
from barcast.session import staged

P = Params(
    horizon=2, features=("close", "volume"), train_cutoff="2024-01-12T00:00+00:00", val_days=3, pooled_rounds=14, pooled_gate_rounds=9, patience=3
)


@pytest.fixture(scope="module")
def sparse(spark):
    rng = random.Random(6)
    rows = [r for a in "AB" for r in series(a, "2024-01-01", [rng.choice([0.0, 5 + rng.random()]) + (i // 4) % 24 for i in range(1100)])]
    bars = spark.createDataFrame(rows, BARS)
    return staged(bars.withColumn("close", F.when(F.col("close") > 12, F.col("close")).otherwise(0.0)), "sparse")


@pytest.mark.parametrize("classes", [False, True])
@pytest.mark.parametrize("rounds", [1, 12])
def test_same_ensembles(spark, classes, rounds):
    """More distinct values than bins, few values, zeros and a constant; weights of all sizes."""
    rng = np.random.default_rng(2)
    n, train = 1200, 900
    x = np.column_stack([rng.normal(size=n), rng.gamma(1, size=n).round(1) * (rng.random(n) > 0.6), rng.integers(0, 24, n), np.full(n, 3.0)])
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + (x[:, 2] > 12) + rng.normal(size=n)
    y, weight = ((y > 1).astype(float), np.ones(n)) if classes else (y, np.abs(y) + 1e-6)
    rows = [(i, Vectors.dense(a.tolist()), float(b), float(w)) for i, (a, b, w) in enumerate(zip(x, y, weight))]
    frame = spark.createDataFrame(rows, ["i", "x", "y", "w"]).coalesce(1).cache()
    fit, val = frame.where(F.col("i") < train), frame.where(F.col("i") >= train)
    learner = GBTClassifier(labelCol="y") if classes else GBTRegressor(labelCol="y", weightCol="w", predictionCol="p")
    model = learner.setParams(**pooled_models._TREES).setMaxIter(rounds).fit(fit)
    best, _ = pooled_models.best_prefix(model.evaluateEachIteration(val, *([] if classes else ["squared"])), rounds)
    column = F.col("rawPrediction") if classes else F.col("p")
    shown = pooled_models.first_rounds(model, best).transform(val).orderBy("i").select(column).collect()
    got, used = level_trees.boosted(x, y, weight, train, pooled_models._LEVELS, rounds, rounds, classes)
    assert used == best
    assert got == pytest.approx([r[0][1] if classes else r[0] for r in shown], abs=1e-12)


def test_rounds_end_with_the_patience():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 1)), rng.normal(size=300)  # nothing to learn
    settings = pooled_models._LEVELS
    many, used = level_trees.boosted(x, y, np.ones(300), 200, settings, 60, 4)
    again, same = level_trees.boosted(x, y, np.ones(300), 200, settings, used, 4)
    assert used == same < 60 and (many == again).all()


def test_same_rows_as_by_pyspark_ml(spark, sparse):
    frame = pooled_supervised(sparse, P)
    stats = train_stats(frame.where("split = 'train'"), P)
    sizes = pooled_models.pooled_rows(frame, stats, P).collect()
    quick = P.with_(pooled_rounds=5, pooled_gate_rounds=4, patience=2)
    got = pooled_models.score_in_tasks(frame, stats, sizes, quick, 3)
    assert [r[:2] for r in got] == [(r["feature"], r["horizon"]) for r in sizes] and len(got) == 4
    size, row = next((s, r) for s, r in zip(sizes, got) if 0 < s["n_nonzero"] < s["n_train"])
    want = pooled_models.score_one(pooled_models.feature_rows(frame, stats, P, size["feature"]).repartition(1), size, quick)
    assert row[:2] + row[4:] == want[:2] + want[4:] and row[2:4] == pytest.approx(want[2:4], rel=1e-9)


def test_few_rows_need_no_job_for_each_level(spark, sparse, monkeypatch):
    def refuse(self, data):
        raise AssertionError("a fit by jobs")

    monkeypatch.setattr(GBTRegressor, "fit", refuse)
    monkeypatch.setattr(GBTClassifier, "fit", refuse)
    rows = pooled_models.pooled_eval(sparse, P, horizons=[1]).collect()
    assert [(r["feature"], r["horizon"]) for r in rows] == [("close", 1), ("volume", 1)]
