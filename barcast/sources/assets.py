"""Which assets a job runs on: the first N, or an explicit list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.sources.bars import file_order


def distinct_assets(bars: DataFrame) -> DataFrame:
    return bars.select("asset").distinct()


def first_assets(bars: DataFrame, n: int) -> DataFrame:
    """The first ``n`` assets in file-name order (a top-k, so no full sort)."""
    return distinct_assets(bars).orderBy(file_order(F.col("asset"))).limit(n)


def asset_list(spark: SparkSession, lines: Iterable[str] | None = None, path: str | None = None) -> DataFrame:
    """Listed ids with their position: trimmed, blank lines dropped, repeats kept once."""
    if path is not None:
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "line"))
    else:
        rows = spark.createDataFrame(list(enumerate(lines or [])), "pos int, line string")
    ident = F.regexp_replace("line", r"^\s+|\s+$", "")
    return (
        rows.select("pos", ident.alias("asset"))
        .where(F.col("asset") != "")
        .groupBy("asset")
        .agg(F.min("pos").alias("pos"))
    )


def listed_assets(bars: DataFrame, listed: DataFrame, cap: int | None = None) -> DataFrame:
    """Listed ids that have bars, in list order; the cap counts after unknown ids are dropped."""
    known = listed.join(distinct_assets(bars), "asset", "left_semi")
    return known.orderBy("pos").limit(cap) if cap is not None else known


def unknown_assets(bars: DataFrame, listed: DataFrame) -> DataFrame:
    return listed.join(distinct_assets(bars), "asset", "left_anti")


def restricted(bars: DataFrame, params: Params, listed: DataFrame | None = None) -> DataFrame:
    """Bars of the assets a job should run on, by a semi join with the choice."""
    cap = params.max_assets
    if listed is None and cap is None:
        return bars
    chosen = listed_assets(bars, listed, cap) if listed is not None else first_assets(bars, cap)
    return bars.join(chosen.select("asset"), "asset", "left_semi")
