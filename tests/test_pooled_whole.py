"""Shared models over the smallest tables, checked by what they must satisfy."""

from conftest import SF

from barcast.operators.clean import regular_bars
from barcast.operators.pooled_models import pooled_eval
from barcast.plans.fixture import raw_ohlcv
from barcast.plans.queries import P, registered
from barcast.session import staged


def test_pooled_rows_gate_the_models(spark):
    """Row counts of all models: one row less a step, and never more non-zero targets than rows."""
    rows = registered()["pooled_rows"](spark, SF).collect()
    assert {(r["feature"], r["horizon"]) for r in rows} == {(f, h) for f in P.features for h in P.horizons}
    by_model = {(r["feature"], r["horizon"]): r for r in rows}
    for (feature, h), r in by_model.items():
        assert r["n_train"] == by_model[feature, 1]["n_train"] - (h - 1) and r["n_val"] == by_model[feature, 1]["n_val"] - (h - 1)
        assert 0 < r["n_nonzero"] < r["n_train"] and r["sum_weight"] > 0


def test_pooled_scores(spark):
    """Two models with all their rounds; the registered query fits the others in the same way."""
    bars = staged(regular_bars(raw_ohlcv(spark, SF)), "bars")
    rows = pooled_eval(bars, P, features=("close",), horizons=[1, 10]).collect()
    assert [(r["feature"], r["horizon"]) for r in rows] == [("close", 1), ("close", 10)]
    for r in rows:
        assert 1 <= r["rounds"] <= P.pooled_rounds and 1 <= r["gate_rounds"] <= P.pooled_gate_rounds
        assert 0 <= r["sMAPE_gated"] < r["sMAPE"] <= 200
