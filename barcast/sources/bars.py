"""Regular bars on storage.

Bars lie in folders by bucket of the asset and by month, sorted by asset and
time within a file, with a bloom filter on the asset. The number of files
depends on buckets and months and not on the number of assets. The
number of buckets is part of the folder names, so a table describes itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcast.config import MEASURES
from barcast.session import staged
from barcast.sources.files import file_of_row, file_report

BARS_SCHEMA = T.StructType(
    [
        T.StructField("asset", T.StringType()),
        T.StructField("t", T.TimestampType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
    ]
)
BUCKETS = 64
# Ids that become predicates on folders and row groups; longer lists are a semi join, with the same rows.
PREDICATE_IDS = 1_000
_FOLDERS = ("buckets", "bucket", "month")
_STORED = T.StructType(
    [
        *BARS_SCHEMA,
        T.StructField("buckets", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("month", T.StringType()),
    ]
)


def _bucket(asset: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(asset), buckets).cast("int")


def _month(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def bucketed(df: DataFrame, buckets: int, month_of: str) -> DataFrame:
    """``df`` with the folder columns, dealt out by folder.

    A folder holds at most one row per asset and grid point of a month, whatever the skew of
    the raw records; the rebalancing exchange still splits a large one.
    """
    placed = df.withColumns(
        {"buckets": F.lit(buckets), "bucket": _bucket(F.col("asset"), F.lit(buckets)), "month": _month(F.col(month_of))}
    )
    return placed.hint("rebalance", "bucket", "month")


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    (
        bucketed(bars.select(*BARS_SCHEMA.names), buckets, "t")
        .sortWithinPartitions("bucket", "month", "asset", "t")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#asset", "true")
        .partitionBy(*_FOLDERS)
        .parquet(path)
    )


def asset_predicate(assets: Sequence[str]) -> Column:
    """Rows of the given assets, with their buckets as a condition on folders."""
    buckets = F.array(*[_bucket(F.lit(a), F.col("buckets")) for a in assets])
    return F.array_contains(buckets, F.col("bucket")) & F.col("asset").isin(list(assets))


def read_bars(
    spark: SparkSession,
    path: str,
    skip_corrupt: bool = False,
    assets: Sequence[str] | None = None,
    since: Column | None = None,
    until: Column | None = None,
    report: DataFrame | None = None,
) -> DataFrame:
    """Stored bars, with assets as text.

    ``assets``, ``since`` and ``until`` choose folders first, so files of other buckets and months
    are not opened. With ``skip_corrupt`` unreadable files are left out, broken ones as a whole;
    ``report`` (of ``bars_report``) says which, and is made here if it is not given.
    """
    reader = spark.read.schema(_STORED)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    bars = reader.parquet(path)
    if since is not None:
        bars = bars.where((F.col("month") >= _month(since)) & (F.col("t") >= since))
    if until is not None:
        bars = bars.where((F.col("month") <= _month(until)) & (F.col("t") <= until))
    if assets is not None and len(assets) <= PREDICATE_IDS:
        bars = bars.where(asset_predicate(assets)) if assets else bars.limit(0)
    elif assets is not None:
        wanted = spark.createDataFrame([(a,) for a in assets], "asset string")
        bars = bars.join(wanted, "asset", "left_semi")
    if skip_corrupt:
        report = bars_report(spark, path) if report is None else report
        bad = report.where("error is not null").select(F.col("file").alias("_file"))
        bars = bars.withColumn("_file", file_of_row()).join(bad, "_file", "left_anti")
    return bars.select(*BARS_SCHEMA.names)


def bars_report(spark: SparkSession, path: str) -> DataFrame:
    """Which files of stored bars can be read: a stored ``file_report``."""
    return staged(file_report(spark, path, BARS_SCHEMA), "file_report")


def file_order(asset) -> F.Column:
    """Sort key of an asset's file name: differs from the asset's own order on prefixes."""
    return F.concat(asset, F.lit(".parquet"))
