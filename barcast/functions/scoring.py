"""Zero-safe symmetric percentage error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barcast.config import SMAPE_EPS


def smape_cell(truth: Column, pred: Column, eps: float = SMAPE_EPS) -> Column:
    """Error of one cell in [0, 2].

    Zero against zero, and any cell with a missing side, counts as no error.
    The NaN guard is explicit because Spark orders NaN above every number.
    """
    size = (F.abs(truth) + F.abs(pred)) / 2.0
    return F.when(~F.isnan(size) & (size > eps), F.abs(pred - truth) / size).otherwise(F.lit(0.0))


def smape(truth: Column, pred: Column, eps: float = SMAPE_EPS, only_known: bool = False) -> Column:
    """Aggregate: percentage mean of the cells, leaving out undefined ones (inf/inf).

    With ``only_known`` rows without a truth are left out instead of counting as no error.
    """
    cell = smape_cell(truth, pred, eps)
    counted = ~F.isnan(cell) & truth.isNotNull() if only_known else ~F.isnan(cell)
    return F.avg(F.when(counted, cell)) * 100.0
