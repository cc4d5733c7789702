"""Running per-asset summary over a stream of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barcast.operators.summary import merged_summary, partial_summaries, summary_aggregates, with_zero_share
from barcast.sources.raw import RAW_SCHEMA, normalise_records


def stream_raw(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw Parquet files as they arrive in ``folder``."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalise_records(reader.parquet(folder))


def running_summary(stream: DataFrame) -> DataFrame:
    """The batch summary's aggregates under update semantics.

    State is one fixed-size row per asset; rows are combined map-side before
    the state store, so a hot asset sends one row per task and batch. No
    watermark is needed: the keys are assets, not time windows.
    """
    grouped = stream.where(F.col("ID").isNotNull()).groupBy("ID").agg(*summary_aggregates())
    return with_zero_share(grouped)


def start_summary(
    stream: DataFrame, checkpoint: str, sink: str, once: bool = False, **options: str
) -> StreamingQuery:
    """Emit the changed assets of every batch to a sink that accepts updates (such as Kafka)."""
    writer = (
        running_summary(stream)
        .writeStream.outputMode("update")
        .format(sink)
        .option("checkpointLocation", checkpoint)
        .options(**{k: v for k, v in options.items() if k != "queryName"})
    )
    if "queryName" in options:
        writer = writer.queryName(options["queryName"])
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


_STATE = "ID string, total_count bigint, nonzero_count bigint, first_ts timestamp, last_ts timestamp, kind string, batch bigint"
COMPACT_EVERY = 100  # batches between two merged snapshots


def _stored(spark: SparkSession, state: str, kind: str) -> DataFrame:
    return spark.read.schema(_STATE).parquet(state).where(F.col("kind") == kind)


def current_partials(spark: SparkSession, state: str) -> DataFrame:
    """Partial summaries that make up the state: the newest snapshot and the batches after it."""
    base = _stored(spark, state, "base")
    newest = base.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("newest"))
    last = newest.first()["newest"]
    return base.where(F.col("batch") == last).unionByName(_stored(spark, state, "part").where(F.col("batch") > last))


def upsert_batch(state: str, compact_every: int = COMPACT_EVERY):
    """The function that puts a batch into the state table below ``state``.

    A batch owns one folder by its id and overwrites it, so a batch that is replayed after a failure
    changes nothing. It stores one row per asset of the batch. Every
    ``compact_every`` batches all rows so far are merged into a snapshot, which is replaced the same way.
    """

    def put(batch: DataFrame, number: int) -> None:
        partial_summaries(batch, []).write.mode("overwrite").parquet(f"{state}/kind=part/batch={number}")
        if number % compact_every == compact_every - 1:
            # reads this batch's rows and those of the snapshot before, never the folder it writes
            spark = batch.sparkSession
            before = current_before(spark, state, number)
            merged = merged_summary(before).drop("fraction_zero")
            merged.write.mode("overwrite").parquet(f"{state}/kind=base/batch={number}")

    return put


def current_before(spark: SparkSession, state: str, number: int) -> DataFrame:
    """What ``current_partials`` was made of at batch ``number``, without that batch's own snapshot."""
    older = _stored(spark, state, "base").where(F.col("batch") < number)
    last = older.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("last")).first()["last"]
    parts = _stored(spark, state, "part").where((F.col("batch") > last) & (F.col("batch") <= number))
    return older.where(F.col("batch") == last).unionByName(parts)


def start_stored_summary(stream: DataFrame, checkpoint: str, state: str, once: bool = False, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the running summary as a table that any job can read with ``stored_summary``."""
    writer = stream.writeStream.foreachBatch(upsert_batch(state, compact_every)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_summary(spark: SparkSession, state: str) -> DataFrame:
    """The summary of all batches so far; equal to the batch summary of the same rows."""
    return merged_summary(current_partials(spark, state))
