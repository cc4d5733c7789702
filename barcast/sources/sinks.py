"""Result writers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcast.config import MEASURES
from barcast.sources.bars import bucketed

FORECAST_BUCKETS = 16


def write_results(results: DataFrame, path: str) -> None:
    """Result table as CSV with a header, replacing what was there."""
    results.write.mode("overwrite").option("header", "true").csv(path)


def write_raw_by_id(raw: DataFrame, path: str) -> None:
    """Append raw rows in one directory per ID.

    The rebalancing exchange gathers an ID's rows, but splits any partition
    that turns out large, so a hot ID is written by many tasks.
    """
    (
        raw.where(F.col("ID").isNotNull())
        .select("ID", "ExecutionTime", *MEASURES)
        .hint("rebalance", "ID")
        .write.mode("append")
        .partitionBy("ID")
        .parquet(path)
    )


FORECAST_SCHEMA = (
    "asset string, feature string, origin timestamp, horizon int, target_time timestamp, pred double, `true` double, "
    "run string, buckets int, bucket int, month string"
)
_LEDGER = "asset string, run string, number bigint"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """(asset, run, number) of all finished runs; none before the first."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def write_forecasts(forecasts: DataFrame, path: str, assets: DataFrame | None = None, buckets: int = FORECAST_BUCKETS) -> str:
    """Store a run's forecasts and enter its assets in the ledger. Returns the run's id.

    Forecasts of a run lie in folders of their own, and readers take each asset from the newest run
    that the ledger names. The ledger is written last: until then, and if the run fails, all
    readers see the runs before. ``assets`` are those of the run (by default those with
    forecasts); one without forecasts has none from then on. Other assets stay as they are.
    """
    spark = forecasts.sparkSession
    run = uuid.uuid4().hex
    columns = [c for c in forecasts.columns if c in ("asset", "feature", "origin", "horizon", "target_time", "pred", "true")]
    stored = f"{path}/forecasts"
    (
        bucketed(forecasts.select(*columns), buckets, "origin")
        .withColumn("run", F.lit(run))
        .sortWithinPartitions("bucket", "month", "asset", "feature", "horizon", "origin")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#asset", "true")
        .partitionBy("run", "buckets", "bucket", "month")
        .parquet(stored)
    )
    if assets is None:
        assets = read_run(spark, path, run)
    newest = _ledger(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    entries = assets.select("asset").distinct().withColumns({"run": F.lit(run), "number": F.lit(newest + 1).cast("bigint")})
    entries.write.mode("append").parquet(f"{path}/ledger")
    return run


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """All that one run stored, finished or not."""
    return spark.read.schema(FORECAST_SCHEMA).parquet(f"{path}/forecasts").where(F.col("run") == run).drop("run", "buckets", "bucket", "month")


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts of every asset's newest finished run."""
    newest = _ledger(spark, path).groupBy("asset").agg(F.max_by("run", "number").alias("run"))
    stored = spark.read.schema(FORECAST_SCHEMA).parquet(f"{path}/forecasts")
    return stored.join(newest, ["asset", "run"], "left_semi").drop("run", "buckets", "bucket", "month")


def append_forecasts(forecasts: DataFrame, path: str) -> None:
    """Add forecasts to a CSV folder asset by asset; every file has the header."""
    forecasts.write.mode("append").option("header", "true").csv(path)
