"""Raw record scan: several inputs in order, with a stable ingest order per row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcast.config import MEASURES
from barcast.functions.measures import nan_to_null
from barcast.functions.times import as_instant
from barcast.session import prepare
from barcast.sources.files import file_of_row, file_ordinals

RAW_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("ExecutionTime", T.TimestampType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
        T.StructField("seq", T.LongType()),
    ]
)

# ``seq`` packs (file number, row in file) into one long, so that "latest in
# ingest order" is a fixed-width aggregate.
_ROW_BITS = 40


@dataclass(frozen=True)
class RawScan:
    records: DataFrame
    skipped: list[str]


def normalise_records(df: DataFrame) -> DataFrame:
    """Typed raw columns; absent columns become nulls, NaN becomes null."""
    present = set(df.columns)

    def measure(name: str):
        if name not in present:
            return F.lit(None).cast("double").alias(name)
        return nan_to_null(F.col(name).cast("double")).alias(name)

    ident = F.col("ID").cast("string") if "ID" in present else F.lit(None).cast("string")
    extra = [c for c in ("file_ord", "row_index", "seq") if c in present]
    return df.select(
        ident.alias("ID"),
        as_instant(df, "ExecutionTime").alias("ExecutionTime"),
        *[measure(m) for m in MEASURES],
        *extra,
    )


def read_raw(spark: SparkSession, paths: list[str]) -> RawScan:
    """Scan Parquet inputs in the given order; inputs that do not exist are skipped and reported.

    Adds ``file_ord``, ``row_index`` and their packed form ``seq``. Files are
    ranked by executors; the optimizer joins the ranks by their true size.
    """
    sources: list[tuple[int, str, DataFrame]] = []
    skipped: list[str] = []
    prepare(spark)
    for number, path in enumerate(paths):
        try:
            sources.append((number, path, spark.read.parquet(path)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            skipped.append(path)
    if not sources:
        raise FileNotFoundError(f"no input found among {paths}")
    ordinals = file_ordinals(spark, [(number, path) for number, path, _ in sources])
    parts = []
    for number, _, source in sources:
        located = source.select(*source.columns, file_of_row().alias("_file"), F.col("_metadata.row_index").alias("row_index"))
        mine = ordinals.where(F.col("input") == number).select(F.col("file").alias("_file"), "file_ord")
        parts.append(normalise_records(located.join(mine, "_file")))
    records = reduce(DataFrame.unionByName, parts)
    packed = F.shiftleft(F.col("file_ord"), _ROW_BITS) + F.col("row_index")
    return RawScan(records.withColumn("seq", packed), skipped)
