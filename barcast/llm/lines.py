"""Line dedup: windows of three consecutive lines that were seen before are removed.

All steps are DataFrame functions. The windows of a text are hashed (twice 64
bits), one aggregation finds those that occur more than once and where each
occurs first, and the positions of all later occurrences are merged into the
line ranges that stay. The aggregation collapses copies map-side, so a window
that a third of all rows share is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import plain_columns, unused

WINDOW = 3
_LAST = (1 << 63) - 1  # stands for a null id


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_at"), F.xxhash64("text").alias("_hash")]


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(_at, _hash, pos, h1, h2) of every window of ``width`` lines; positions count from 0."""
    lines = docs.where(F.col("text").isNotNull()).select(*_row_key(), F.split("text", "\n").alias("lines")).where(F.size("lines") >= width)
    count = F.size("lines") - (width - 1)
    shifted = F.arrays_zip(*[F.slice("lines", i + 1, count).alias(f"l{i}") for i in range(width)])
    rows = lines.select("_at", "_hash", F.posexplode(shifted).alias("pos", "w"))
    parts = [F.col(f"w.l{i}") for i in range(width)]
    return rows.select("_at", "_hash", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(_at, _hash, pos) of the windows that occur at a smaller (id, position, hash of the text) too."""
    rows = windows(docs, width)
    repeated = (
        rows.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("_at", "pos", "_hash")).alias("first"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    return rows.join(repeated, ["h1", "h2"]).where(F.struct("_at", "pos", "_hash") > F.col("first")).select("_at", "_hash", "pos")


def deduplicated(docs: DataFrame, width: int = WINDOW, counts: bool = True) -> DataFrame:
    """``docs`` with the lines of repeated windows removed from ``text``, plus ``n_lines`` and ``n_removed``.

    The first occurrence by (doc_id, position, hash of the text) stays; a null id
    counts as the largest. Texts with fewer lines than a window, empty and null texts stay as
    they are. Rows that repeat both id and text are one document and get the
    same result; a text whose lines are all removed becomes empty. Columns of
    ``docs`` named ``n_lines`` or ``n_removed`` are replaced, others are kept
    whatever their names. Without ``counts`` the columns are those of ``docs``.
    """
    at, digest, cut, lines, keep = unused(docs.columns, "_at", "_hash", "_cut", "_lines", "_keep")
    removed = later_windows(docs, width).groupBy(F.col("_at").alias(at), F.col("_hash").alias(digest)).agg(F.array_sort(F.collect_set("pos")).alias(cut))
    kept = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    row_key = [column.alias(name) for column, name in zip(_row_key(), (at, digest))]
    rows = docs.select(*plain_columns(docs), *row_key).join(removed, [at, digest], "left").withColumn(lines, F.split("text", "\n"))
    count = F.coalesce(F.size(lines), F.lit(0))
    cuts = F.coalesce(cut, F.array().cast("array<int>"))
    # each stretch that stays runs from the end of one removed window to the begin of the next
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda p: p + width))
    ends = F.concat(cuts, F.array(F.size(lines)))
    stretches = F.filter(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda r: r["e"] > r["b"])
    rows = rows.withColumn(keep, stretches)
    left = F.flatten(F.transform(keep, lambda r: F.slice(lines, r["b"] + 1, r["e"] - r["b"])))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    stays = F.aggregate(keep, F.lit(0), lambda total, r: total + r["e"] - r["b"])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(count).cast("bigint").alias("n_lines")
    n_removed = F.when(F.col(cut).isNull(), 0).otherwise(count - stays).cast("bigint").alias("n_removed")
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept]
    return rows.select(*columns, *([n_lines, n_removed] if counts else []))
