"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Lists = list[list]
SLICE_BYTES = 4 << 20  # rows turned into Python values at a time, one row at least


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has that name in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those with a dot in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``SLICE_BYTES``, in order: Python values of long texts take several times their bytes."""
    if batch.nbytes <= SLICE_BYTES or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from sliced(batch.slice(0, half))
        yield from sliced(batch.slice(half))


def map_lists(df: DataFrame, work: Callable[[Iterator[Lists]], Iterable[Lists]], schema: str) -> DataFrame:
    """One Arrow pass: ``work`` gets the columns of each slice of a batch as lists and yields output columns as lists.

    ``work`` runs once per task, so what it sets up before its first batch is
    shared by all rows of the task.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([c.to_pylist() for c in part.columns] for batch in batches for part in sliced(batch))
        for out in work(columns):
            arrays = [pa.array(values, type=field.type) for values, field in zip(out, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    if any(set(".`") & set(c) for c in df.columns):  # columns go by position, and such names are no plain references
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return df.mapInArrow(run, schema)


def row_map(df: DataFrame, start: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Like ``map_lists`` for one output row per input row; ``start()`` makes the row function of a task."""
    width = len(StructType.fromDDL(schema))

    def work(batches: Iterator[Lists]) -> Iterator[Lists]:
        one = start()
        for columns in batches:
            rows = [one(*values) for values in zip(*columns)]
            yield [list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]

    return map_lists(df, work, schema)


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null for a null id)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % divisor


def held_out(doc_id: str, divisor: int, remainder: int) -> Column:
    """True where the id's remainder marks a held-out row; a null id is never held out."""
    return F.coalesce(id_remainder(doc_id, divisor) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label, weight) of at most ``per_class`` labelled rows of each class.

    The rows with the smallest hash of their id are taken, never from the
    held-out quarter, so the choice depends on the ids alone. ``weight`` is
    the share of the class among all usable labels over its share in the
    sample. Rows with a null id or label are left out; an id labelled twice
    counts with its larger label.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", 4, 2))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    total = sum(counts.values())
    parts = []
    for value in (0, 1):
        n = counts.get(value, 0)
        taken = min(n, per_class)
        weight = n / total / (taken / sum(min(c, per_class) for c in counts.values())) if taken else 0.0
        parts.append(
            usable.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_class)
            .withColumn("weight", F.lit(float(weight)))
        )
    chosen = parts[0].unionByName(parts[1])
    # at most 2 * per_class rows of three numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
