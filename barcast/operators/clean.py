"""Raw records → regular bars."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.config import MEASURES, STEP_SECONDS
from barcast.functions.times import grid_ceil, grid_floor, on_grid
from barcast.session import staged

# Grid rows one task generates.
_ROWS_PER_TASK = 4_000_000
_SLOTS_PER_SPAN = 4096


@dataclass(frozen=True)
class Grid:
    """The common grid: first and last epoch second, and how many assets share it."""

    lo: int
    hi: int
    n_assets: int

    @property
    def n_slots(self) -> int:
        return (self.hi - self.lo) // STEP_SECONDS + 1


def usable_records(raw: DataFrame) -> DataFrame:
    """Rows that can be placed: known ID and time."""
    return raw.where(F.col("ID").isNotNull() & F.col("ExecutionTime").isNotNull())


def asset_spans(raw: DataFrame) -> DataFrame:
    """First and last record time per asset, also of assets without any valid time."""
    return (
        raw.where(F.col("ID").isNotNull())
        .groupBy(F.col("ID").alias("asset"))
        .agg(F.min("ExecutionTime").alias("first_t"), F.max("ExecutionTime").alias("last_t"))
    )


def grid_bounds(spans: DataFrame) -> DataFrame:
    """One row: outer grid points over all assets and their number of slots."""
    lo, hi = grid_floor(F.min("first_t")), grid_ceil(F.max("last_t"))
    return spans.agg(
        lo.alias("lo"),
        hi.alias("hi"),
        (F.expr("count(*)")).alias("n_assets"),
    ).withColumn("n_slots", ((F.col("hi") - F.col("lo")) / STEP_SECONDS).cast("long") + 1)


def find_grid(spans: DataFrame) -> Grid:
    """Bounds as plain values (a one-row result); fails when there is nothing to place."""
    row = grid_bounds(spans).first()
    if row is None or row["lo"] is None:
        raise ValueError("no valid timestamps in the raw records")
    return Grid(row["lo"], row["hi"], row["n_assets"])


def time_grid(assets: DataFrame, grid: Grid) -> DataFrame:
    """Every (asset, grid point), generated in parallel by asset and stretch of time."""
    span = _SLOTS_PER_SPAN * STEP_SECONDS
    tasks = max(1, math.ceil(grid.n_assets * grid.n_slots / _ROWS_PER_TASK))
    stretches = assets.select(
        "asset", F.explode(F.sequence(F.lit(grid.lo), F.lit(grid.hi), F.lit(span))).alias("start")
    ).repartition(tasks, "asset", "start")
    stop = F.least(F.col("start") + (span - STEP_SECONDS), F.lit(grid.hi))
    seconds = F.explode(F.sequence(F.col("start"), stop, F.lit(STEP_SECONDS))).alias("s")
    return stretches.select("asset", seconds).select("asset", F.timestamp_seconds("s").alias("t"))


def last_known(measure: str, order: str = "seq") -> Column:
    """Aggregate: latest non-missing value; value and order are fixed-width, so it hash-aggregates."""
    return F.max_by(F.col(measure), F.when(F.col(measure).isNotNull(), F.col(order)))


def dedupe_last(raw: DataFrame) -> DataFrame:
    """One row per (asset, time): per measure the last non-missing value in ingest order.

    Map-side partial aggregation collapses copies before the exchange, so one
    heavily repeated key costs no more than one row per task.
    """
    return (
        usable_records(raw)
        .groupBy(F.col("ID").alias("asset"), F.col("ExecutionTime").alias("t"))
        .agg(*[last_known(m).alias(m) for m in MEASURES])
    )


def regular_bars(raw: DataFrame) -> DataFrame:
    """Raw records → gap-free bars of every asset on the common grid, missing measures 0.

    Grid points enter the same aggregation as the records, as rows without
    measures: de-duplication, re-indexing and filling share one exchange and
    need no join. Off-grid records are dropped before it.
    """
    spans = staged(asset_spans(raw), "spans")
    grid = find_grid(spans)
    slots = time_grid(spans.select("asset"), grid).select(
        F.col("asset").alias("ID"),
        F.col("t").alias("ExecutionTime"),
        *[F.lit(None).cast("double").alias(m) for m in MEASURES],
        F.lit(None).cast("long").alias("seq"),
    )
    records = raw.where(on_grid(F.col("ExecutionTime"))).select(*slots.columns)
    merged = dedupe_last(records.unionByName(slots))
    return merged.select("asset", "t", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Per asset: what cleaning drops, merges and fills.

    Two-level counting, so a repeated (asset, time) is combined map-side.
    """
    spans = staged(asset_spans(raw), "spans")
    n_slots = find_grid(spans).n_slots
    per_time = (
        raw.where(F.col("ID").isNotNull())
        .groupBy(F.col("ID").alias("asset"), F.col("ExecutionTime").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    timed, placed = F.col("t").isNotNull(), on_grid(F.col("t"))
    return (
        per_time.groupBy("asset")
        .agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(~timed, F.col("n"))), F.lit(0)).alias("n_bad_time"),
            F.coalesce(F.sum(F.when(~placed, F.col("n"))), F.lit(0)).alias("n_off_grid"),
            F.coalesce(F.sum(F.when(timed, F.col("n") - 1)), F.lit(0)).alias("n_repeated"),
            F.count_if(placed).alias("n_kept_slots"),
        )
        .withColumn("n_filled_slots", F.lit(n_slots) - F.col("n_kept_slots"))
    )
