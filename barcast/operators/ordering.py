"""Positions in a global order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcast.session import staged


def with_positions(df: DataFrame, order_key: Column, sizes: list[str], label: str) -> DataFrame:
    """Add ``pos`` (0-based rank by ``order_key``) and ``<size>_start`` (running total before the row).

    ``order_key`` must be unique. Rows are range-partitioned and stored, so that
    their partition numbers are final; running totals are taken inside each
    partition and shifted by the totals of the earlier ones. The only ungrouped
    window runs over one row per partition.
    """
    placed = staged(
        df.withColumn("_key", order_key)
        .repartitionByRange("_key")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_one", F.lit(1).cast("long")),
        label,
    )
    names = ["_one", *sizes]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(*[F.sum(n).alias(f"{n}_sum") for n in names])
        .select("_part", *[F.coalesce(F.sum(f"{n}_sum").over(before), F.lit(0)).alias(f"{n}_base") for n in names])
    )
    inside = Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_local") for n in names]
    ).join(starts, "_part")
    return ranked.select(
        *df.columns,
        (F.col("_one_local") + F.col("_one_base")).alias("pos"),
        *[(F.col(f"{n}_local") + F.col(f"{n}_base")).alias(f"{n}_start") for n in sizes],
    )


def asset_codes(assets: DataFrame) -> DataFrame:
    """Dense integer code per asset in label order."""
    ranked = with_positions(assets.select("asset").distinct(), F.col("asset"), [], "codes")
    return ranked.select("asset", F.col("pos").cast("int").alias("asset_code"))
