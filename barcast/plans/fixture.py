"""Raw bar records derived from the ``events`` table.

Five series by event type plus a nearly silent one; holds duplicates, off-grid
times, missing closes, all-zero rows and an inactive series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.functions.times import grid_floor
from barcast.session import prepare

FIXTURE_PARAMS = Params(train_cutoff="2024-01-25 23:45", val_days=7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    slot = F.timestamp_seconds(grid_floor(at))
    value, low_value = F.col("value"), F.col("value") < 20

    def scaled(c):
        return F.when(low_value, F.lit(0.0)).otherwise(c)

    main = events.select(
        F.col("event_type").alias("ID"),
        F.when(F.col("event_id") % 10 == 3, at).otherwise(slot).alias("ExecutionTime"),
        scaled(value).alias("high"),
        scaled(value / 2).alias("low"),
        F.when(F.col("event_id") % 7 != 0, scaled(value * 0.75)).alias("close"),
        scaled((F.col("user_id") % 5).cast("double")).alias("volume"),
        F.col("event_id").alias("seq"),
    )
    silent = events.where(F.col("event_id") % 1000 == 0).select(
        F.lit("dormant").alias("ID"),
        slot.alias("ExecutionTime"),
        *[(value * 1e-5).alias(m) for m in ("high", "low", "close")],
        F.lit(0.0).alias("volume"),
        F.col("event_id").alias("seq"),
    )
    return main.unionByName(silent)
