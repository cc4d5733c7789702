"""Files behind a path: listing, order and readability, without a file list on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barcast.operators.ordering import with_positions
from barcast.session import staged

NO_FOOTER, CUT = "no readable footer", "data ends early"


def plain_path(c: Column) -> Column:
    """"file:///x" and "file:/x" name the same file."""
    return F.regexp_replace(c, r"^([A-Za-z0-9+.-]+):/+", "$1:/")


def file_of_row() -> Column:
    return plain_path(F.col("_metadata.file_path"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of every data file below ``path``; contents are not read.

    Files without a byte hold no rows, and no reader looks at them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(file_of_row().alias("file"), "length")


def file_ordinals(spark: SparkSession, inputs: list[tuple[int, str]]) -> DataFrame:
    """(file, file_ord) over all (number, path) inputs: by number, then by file name.

    Ranks come from range partitions, so any number of files is ordered by executors.
    """
    parts = [listed_files(spark, path).select(F.lit(number).alias("input"), "file") for number, path in inputs]
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    ranked = with_positions(files, F.struct("input", "file"), [], "files")
    return staged(ranked.select("input", "file", F.col("pos").alias("file_ord")), "file_ordinals")


def file_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, length, n_rows, n_read, checksum, error) of every file; ``error`` is null where the file is sound.

    ``n_rows`` is what the footer promises (null without a readable one),
    ``n_read`` how many rows could be decoded in all columns of ``schema``, and ``checksum`` their
    combined hash. A file that breaks in the middle is a bad file, although its first rows could be read.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true")
    promised = reader.parquet(path).groupBy(file_of_row().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    decoded = reader.parquet(path).select(file_of_row().alias("file"), F.xxhash64(*schema.names).alias("h"))
    read = decoded.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_read"), F.bit_xor("h").alias("checksum")
    )
    files = listed_files(spark, path).join(promised, "file", "left").join(read, "file", "left")
    error = (
        F.when(F.col("n_rows").isNull(), NO_FOOTER)
        # the checksum is part of the condition, so the scan decodes every column of every row
        .when((F.coalesce("n_read", F.lit(0)) < F.col("n_rows")) | (F.col("checksum").isNull() & (F.col("n_rows") > 0)), CUT)
    )
    return files.select("file", "length", "n_rows", F.coalesce("n_read", F.lit(0)).alias("n_read"), "checksum", error.alias("error"))
