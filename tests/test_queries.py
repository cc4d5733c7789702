import pytest
from compare import compare, connect
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from barcast.plans.oracle import oracle
from barcast.plans.queries import registered

# Kept out of the quick suite: fits take minutes. test_models.py covers them.
SLOW = {"per_asset_eval", "refit_forecasts", "pooled_eval"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_every_query_but_the_model_fits_has_sql():
    assert set(registered()) - set(oracle()) == SLOW
    assert set(registered()) <= set(queries()) and set(oracle()) <= set(oracle_sql())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 6 * 4 * 2 and all(0 <= r["sMAPE"] <= 200 for r in rows)


def test_zero_baseline_identity(spark):
    """A zero forecast errs by 200 % exactly where the truth is not zero."""
    from pyspark.sql import functions as F

    from barcast.operators.baselines import truth_cells
    from barcast.operators.clean import regular_bars
    from barcast.plans.fixture import FIXTURE_PARAMS, raw_ohlcv
    from barcast.session import staged

    bars = staged(regular_bars(raw_ohlcv(spark, SF)), "bars")
    share = {
        (r["asset"], r["feature"]): 200 * r["s"]
        for r in truth_cells(bars, FIXTURE_PARAMS)
        .groupBy("asset", "feature")
        .agg(F.avg((F.abs("truth") > 2e-8).cast("int")).alias("s"))
        .collect()
    }
    for r in entry(spark).where("baseline = 'zero'").collect():
        assert r["sMAPE"] == pytest.approx(share[(r["asset"], r["feature"])], abs=1e-5)
