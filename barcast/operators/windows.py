"""Lags and leads over bars, in chunks of time.

A plain ``partitionBy("asset")`` window puts a whole series into one task.
Each series is therefore cut into time chunks and the window runs per (series,
chunk). Only rows next to a chunk border miss neighbours; these few rows, with
the rows they need, are shifted once more over the whole series. That holds for
any spacing of rows: a chunk may be short or missing. The result equals the
plain window, and group size does not depend on the length of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcast.config import STEP_SECONDS, Params
from barcast.functions.times import local_hour, local_weekday, steps_after

_CHUNK, _BEFORE, _AFTER = "_chunk", "_before", "_after"


def shifted(
    bars: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[str, int]],
    chunk_slots: int | None,
    arrays: dict[str, tuple[str, range]] | None = None,
) -> DataFrame:
    """Add row-shifted columns.

    ``columns`` maps a new name to (source column, shift); a positive shift
    looks ahead, a negative one back. ``arrays`` maps a new name to (source,
    shifts) and yields one array per row. ``chunk_slots=None`` runs the plain
    window.
    """
    arrays = arrays or {}
    shifts = [s for _, s in columns.values()] + [s for _, r in arrays.values() for s in r]
    back, ahead = max([0, *(-s for s in shifts)]), max([0, *shifts])

    def added(framed: DataFrame, groups: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*groups).orderBy("t")

        def at(source: str, shift: int) -> Column:
            return F.lead(source, shift).over(w) if shift >= 0 else F.lag(source, -shift).over(w)

        return framed.select(
            "*",
            *[at(source, shift).alias(name) for name, (source, shift) in columns.items()],
            *[F.array(*[at(source, s) for s in shifts_]).alias(name) for name, (source, shifts_) in arrays.items()],
        )

    if chunk_slots is None:
        return added(bars, keys)
    if max(back, ahead) > chunk_slots:
        raise ValueError("chunk_slots must cover the largest shift")
    groups = [*keys, _CHUNK]
    chunk = F.floor(F.unix_seconds("t") / (STEP_SECONDS * chunk_slots)).cast("long")
    chunked = bars.withColumn(_CHUNK, chunk)
    in_order = Window.partitionBy(*groups).orderBy("t")
    reach = back + ahead
    # rows before and after within the chunk, as far as they matter
    placed = added(chunked, groups).withColumns(
        {
            _BEFORE: F.row_number().over(in_order) - 1,
            _AFTER: F.count(F.lit(1)).over(in_order.rowsBetween(1, max(1, reach))),
        }
    )
    helpers = [_CHUNK, _BEFORE, _AFTER]
    border = (F.col(_BEFORE) < back) | (F.col(_AFTER) < ahead)
    inside = placed.where(~border).drop(*helpers)
    near = placed.where((F.col(_BEFORE) < reach) | (F.col(_AFTER) < reach)).select(*bars.columns, *helpers)
    return inside.unionByName(added(near, keys).where(border).drop(*helpers))


def lag_plan(params: Params) -> dict[str, tuple[str, int]]:
    """Lag columns. With ``lag_source="last"`` there is one set, of the last listed feature."""
    if params.lag_source == "last":
        return {f"f_lag{k}": (params.features[-1], -k) for k in params.lags}
    return {f"{f}_lag{k}": (f, -k) for f in params.features for k in params.lags}


def lead_plan(params: Params) -> dict[str, tuple[str, range]]:
    """Per feature the values 1..H steps ahead, as one array."""
    return {f"next_{f}": (f, params.horizons) for f in params.features}


def with_lags(bars: DataFrame, params: Params, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Lag columns only. ``keys`` sets the scope: whole series, or series within a split."""
    return shifted(bars, keys, lag_plan(params), params.chunk_slots)


def with_leads(bars: DataFrame, params: Params, keys: Sequence[str] = ("asset",)) -> DataFrame:
    return shifted(bars, keys, {}, params.chunk_slots, lead_plan(params))


def with_lags_and_leads(bars: DataFrame, params: Params, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Lags and future values together: one exchange and one sort."""
    return shifted(bars, keys, lag_plan(params), params.chunk_slots, lead_plan(params))


def with_lags_and_times(bars: DataFrame, params: Params, lags: bool = True) -> DataFrame:
    """Future values with the times of their rows, as ``by_time`` needs them; lags on demand."""
    ahead = {**lead_plan(params), "next_t": ("t", params.horizons)}
    return shifted(bars, ["asset"], lag_plan(params) if lags else {}, params.chunk_slots, ahead)


def with_calendar(bars: DataFrame, params: Params) -> DataFrame:
    """Local hour and weekday (Monday = 0)."""
    return bars.withColumns(
        {"hour": local_hour(F.col("t"), params.zone), "dow": local_weekday(F.col("t"), params.zone)}
    )


def lag_columns_of(feature: str, params: Params) -> list[Column]:
    """The lag columns a target is predicted from, under their common names."""
    if params.lag_source == "last":
        return [F.col(name) for name in params.lag_columns]
    return [F.col(f"{feature}_lag{k}").alias(f"f_lag{k}") for k in params.lags]


def by_time(frame: DataFrame, params: Params, prefix: str) -> DataFrame:
    """Let ``<prefix>_<feature>`` hold the value exactly h steps after ``t``, null where no row has that time.

    Needs ``next_t``, the times of the H rows ahead. On gap-free bars this changes nothing. Rows must lie
    a step apart or more: between denser ones a target can lie beyond the H rows and would count as missing.
    """
    places = F.array(*[F.array_position("next_t", steps_after(F.col("t"), h)) for h in params.horizons])

    def exact_values(name: str) -> Column:
        return F.transform("_places", lambda p: F.get(F.col(name), (p - 1).cast("int")))

    exact = {f"{prefix}_{f}": exact_values(f"{prefix}_{f}") for f in params.features}
    return frame.withColumn("_places", places).withColumns(exact).drop("_places", "next_t")


def complete_lags(params: Params) -> Column:
    """All lag columns are known."""
    condition = F.lit(True)
    for name in lag_plan(params):
        condition = condition & F.col(name).isNotNull()
    return condition
