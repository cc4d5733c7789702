"""The first rounds of an ensemble are what a fit of so many rounds gives, so none is fitted twice."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor

from barcast.operators import pooled_models

SETTINGS = dict(featuresCol="x", maxDepth=3, stepSize=0.05, seed=42)


@pytest.mark.parametrize("kind", [GBTRegressor, GBTClassifier])
def test_first_rounds(spark, kind):
    rng = random.Random(3)
    rows = [(Vectors.dense(a, b), float(a * b + rng.random() > 0.7)) for a, b in ((rng.random(), rng.random()) for _ in range(300))]
    frame = spark.createDataFrame(rows, ["x", "y"]).repartition(1).cache()
    learner = kind(labelCol="y", predictionCol="p", **SETTINGS)
    whole, fresh = learner.copy({learner.maxIter: 6}).fit(frame), learner.copy({learner.maxIter: 4}).fit(frame)
    short = pooled_models.first_rounds(whole, 4)
    assert type(short) is type(whole) and short.getNumTrees == 4 and short.treeWeights == fresh.treeWeights
    column = "p" if kind is GBTRegressor else "probability"
    shown = lambda model: [r[0] for r in model.transform(frame).select(column).collect()]
    assert shown(short) == shown(fresh) != shown(whole)


def test_nothing_is_fitted_twice(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(Vectors.dense(rng.random()), rng.random()) for _ in range(120)]  # nothing to learn, so the first rounds are the best
    frame = spark.createDataFrame(rows, ["x", "y"]).repartition(1)
    train, val = frame.limit(80).cache(), frame.subtract(frame.limit(80)).cache()
    fits, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data: fits.append(self.getMaxIter()) or fit(self, data))
    got = pooled_models.fitted(GBTRegressor(labelCol="y", predictionCol="p", **SETTINGS), train, val, 12, 4)
    assert fits == [5, 10, 12][: len(fits)] and got.model.getNumTrees == got.rounds < fits[-1]
