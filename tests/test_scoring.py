import pytest
from pyspark.sql import functions as F

from barcast.functions.measures import clamped, gated
from barcast.functions.scoring import smape

NAN, INF = float("nan"), float("inf")


def score(spark, truth, pred):
    df = spark.createDataFrame(list(zip(truth, pred)), "y double, p double")
    return df.agg(smape(F.col("y"), F.col("p")).alias("s")).first()["s"]


@pytest.mark.parametrize(
    "truth, pred, expected",
    [
        ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], 0.0),
        ([10.0, 0.0], [5.0, 0.0], (5.0 / 7.5) * 100 / 2),
        ([NAN, 1.0, 0.0], [1.0, 2.0, 0.0], 22.222222222),
        ([None, 1.0, 0.0], [1.0, 2.0, 0.0], 22.222222222),
        ([INF, 1.0], [1.0, 2.0], 66.666666667),
        ([1.0], [-1.0], 200.0),
    ],
)
def test_smape(spark, truth, pred, expected):
    assert score(spark, truth, pred) == pytest.approx(expected)


def test_smape_of_nothing_is_missing(spark):
    assert score(spark, [1.0], [1.0]) == 0.0
    empty = spark.createDataFrame([], "y double, p double")
    assert empty.agg(smape(F.col("y"), F.col("p")).alias("s")).first()["s"] is None


def test_gate_and_clamp_edges(spark):
    rows = [(0.5, 0.5), (0.5, 0.499), (0.5, None), (0.0009, 0.9), (0.001, 0.9), (-0.0009, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, pred double, p double")
    out = df.select("i", clamped(gated(F.col("pred"), F.col("p")), 1e-3).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in out] == [0.5, 0.0, 0.5, 0.0, 0.001, 0.0]
    off = df.select(clamped(F.col("pred"), 0.0).alias("v")).collect()
    assert sorted(r["v"] for r in off) == sorted(r[0] for r in rows)
