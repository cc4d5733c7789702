"""Expressions over measures: missing values, zero rows, normalisation, post-processing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from barcast.config import GATE_PROBABILITY, NONZERO_EPS, STD_FLOOR, WEIGHT_FLOOR


def nan_to_null(c: Column) -> Column:
    """One kind of missing value: NaN becomes null."""
    return F.when(~F.isnan(c), c)


def is_zero_row(measures: list[str] | tuple[str, ...]) -> Column:
    """All measures are exactly zero; a missing measure is not zero."""
    return reduce(and_, (F.coalesce(F.col(m) == 0, F.lit(False)) for m in measures))


def guarded_std(std: Column) -> Column:
    """Spread safe to divide by: missing, non-finite or tiny becomes 1."""
    usable = F.coalesce(~F.isnan(std) & (F.abs(std) < float("inf")) & (std >= STD_FLOOR), F.lit(False))
    return F.when(usable, std).otherwise(F.lit(1.0))


def normalised(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def denormalised(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def magnitude_weight(y: Column) -> Column:
    """Row weight from the target it is fitted on."""
    return F.abs(y) + F.lit(WEIGHT_FLOOR)


def is_nonzero(y: Column, eps: float = NONZERO_EPS) -> Column:
    return (F.abs(y) > eps).cast("int")


def gated(pred: Column, probability: Column) -> Column:
    """Zero where the non-zero probability is below one half; no probability, no change."""
    return F.when(probability < GATE_PROBABILITY, F.lit(0.0)).otherwise(pred)


def clamped(pred: Column, threshold: float | None) -> Column:
    """Forecasts smaller than ``threshold`` in size become zero."""
    if threshold is None or threshold <= 0:
        return pred
    return F.when(F.abs(pred) < threshold, F.lit(0.0)).otherwise(pred)
