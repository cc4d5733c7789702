"""Fill-in-the-middle transformation as a pipeline of Arrow kernels.

A text is cut into units: white space with the word after it, or white space
at the end. For each batch the texts are split into list arrays of units, the lists are
flattened with the index of their parent, every unit gets its ordinal within
its parent and from that its role (prefix, middle or suffix), units are
filtered by role, rebuilt into one list per text and joined, and the pieces
are joined in the order of the row's form. Choices come from a hash of the id,
so they do not depend on order, partitions or the other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
WORD_RUN = rb"([^\x20\x09-\x0D]+)"  # a unit ends with each of these
BORDER = b"\xff"  # no byte of UTF-8 text
SLICE_BYTES = 16 << 20  # a batch is worked on in slices of about this many bytes, one text at least


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    rate: int = 50  # of 100 texts, those that are transformed
    spm: int = 80  # of 100 transformed texts, those in suffix-prefix-middle order


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def units(texts: pa.BinaryArray) -> pa.ListArray:
    """The units of each text, with one empty string behind texts that do not end in white space."""
    return pc.split_pattern(pc.replace_substring_regex(texts, WORD_RUN, rb"\1" + BORDER), BORDER)


def _remainder(values: pa.Array, divisors: pa.Array) -> pa.Array:
    return pc.subtract(values, pc.multiply(pc.divide(values, divisors), divisors))


def _joined(flat: pa.Array, keep: pa.Array, counts: pa.Array) -> pa.StringArray:
    """One string per parent from the kept units, which come ``counts`` to a parent."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(keep)), b"").cast(pa.string())


def pieces(texts: pa.StringArray, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, list[pa.StringArray]]:
    """Number of units of each text, and its prefix, middle and suffix, cut where the draws say."""
    lists = units(texts.cast(pa.binary()))
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    filled = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(filled), parents.filter(filled)
    n = pa.array(np.bincount(parents.to_numpy(), minlength=len(lists)))  # units come sorted by parent
    starts = pc.subtract(pc.cumulative_sum(n), n)
    ordinals = pc.subtract(pa.array(np.arange(len(flat))), starts.take(parents))
    one, other = (_remainder(h, pc.add(n, 1)) for h in (h1, h2))
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    before, until = low.take(parents), high.take(parents)
    in_prefix, in_suffix = pc.less(ordinals, before), pc.greater_equal(ordinals, until)
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    roles = ((in_prefix, low), (in_middle, pc.subtract(high, low)), (in_suffix, pc.subtract(n, high)))
    return n, [_joined(flat, keep, counts) for keep, counts in roles]


def _transformed(texts: pa.StringArray, h: list[pa.Array], settings: Settings) -> list[pa.Array]:
    """(n, form, output, prefix_chars, middle_chars) of a slice of texts without nulls."""
    n, (prefix, middle, suffix) = pieces(texts, h[0], h[1])
    hundred = pa.scalar(100, pa.int64())
    taken = pc.less(_remainder(h[2], hundred), settings.rate)
    marked = pc.match_substring_regex(texts, MARKER)
    plain = pc.or_(pc.or_(pc.equal(n, 0), marked), pc.invert(taken))
    spm = pc.less(_remainder(h[3], hundred), settings.spm)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    first = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    second = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, first, second))
    nothing = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, nothing, pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return [n.cast(pa.int64()), form, output, *sizes]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows that hold about ``SLICE_BYTES`` each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        begun = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begun + SLICE_BYTES, side="right")))
        yield at, end - at
        at = end


def transformed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars): one row per row of ``docs``.

    ``output`` is the text that goes into training, ``n`` its number of units, and
    the sizes count code points (null where the form is plain). A null text counts
    as empty and comes out empty; empty texts and texts that hold a marker stay plain. Rows that repeat
    an id get equal cuts, each for its own text; a null id draws as the empty id. Columns other than ``doc_id`` and
    ``text`` are ignored. One pass without any exchange.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), settings.seed))])
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, length in _slices(sizes):
                ids, texts, *h = batch.slice(start, length).columns
                yield pa.RecordBatch.from_arrays([ids, *_transformed(texts.cast(pa.string()), h, settings)], names=names)

    return rows.mapInArrow(work, f"doc_id {kind}, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Plain outputs are texts; others hold each marker once."""
    parts = F.split(output, MARKER)  # empty, first, second, middle
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``transformed`` with hashes of the output and of the text restored from it in place of the texts."""

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    made = transformed(docs, settings)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
