"""Profiles of raw records and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.config import MEASURES
from barcast.functions.measures import is_zero_row


def summary_aggregates() -> list[Column]:
    """Mergeable aggregates: the batch and the streaming summary share them."""
    return [
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(~is_zero_row(MEASURES)).alias("nonzero_count"),
        F.min("ExecutionTime").alias("first_ts"),
        F.max("ExecutionTime").alias("last_ts"),
    ]


def with_zero_share(summary: DataFrame) -> DataFrame:
    share = F.when(
        F.col("total_count") > 0, 1.0 - F.col("nonzero_count") / F.col("total_count")
    ).otherwise(F.lit(1.0))
    return summary.select("ID", "total_count", "nonzero_count", share.alias("fraction_zero"), "first_ts", "last_ts")


def asset_summary(raw: DataFrame) -> DataFrame:
    """Per asset: rows, rows that are not all zero, share of zero rows, first and last time."""
    grouped = raw.where(F.col("ID").isNotNull()).groupBy("ID").agg(*summary_aggregates())
    return with_zero_share(grouped).orderBy("ID")


def partial_summaries(raw: DataFrame, chunk: list[str]) -> DataFrame:
    """The same aggregates per asset and chunk: small rows that can be stored and merged in any order."""
    return raw.where(F.col("ID").isNotNull()).groupBy("ID", *chunk).agg(*summary_aggregates())


def merged_summary(partials: DataFrame) -> DataFrame:
    """The summary from partial ones, each of which counts once."""
    merged = partials.groupBy("ID").agg(
        F.sum("total_count").alias("total_count"),
        F.sum("nonzero_count").alias("nonzero_count"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    return with_zero_share(merged).orderBy("ID")


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, row count, null count; one aggregation pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.col("n_rows"),
                (F.col("n_rows") - F.col(f"c{i}")).alias("n_null"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(rows))


def head_sample(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """First rows by key (a table has no order of its own)."""
    return df.orderBy(*keys).limit(n)
