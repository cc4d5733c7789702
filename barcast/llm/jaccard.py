"""Jaccard join of word n-gram sets by universe partition and the pigeonhole principle.

Sets are cut into segments by a hash of their elements, with the number of
segments fixed by size band. Two sets of Jaccard similarity t or more differ in
at most H elements; a set that probes e segments exactly and d segments with
one deletion, e + 2d > H, meets every partner in at least one of them. Bands of
small sets use deletions, others exact segments, whichever costs less; within a
band a set probes its largest segments, so empty or tiny ones are last resort.

Sets that are equal form a class and join as one. Pairs that share a segment
are not written out: within each segment group a parity sketch, whose Hamming
distance never exceeds the true difference, rules out pairs, and what is left
is joined to a forest. The trees hold all links; within them the sets are
compared exactly, block by block, and again only a forest of links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, floor

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import map_lists, plain_columns, unused
from barcast.llm.graph import Forest, components
from barcast.session import staged

BLOCK = 2_000  # sets of a group that are compared at once
BLOCK_ELEMENTS = 1 << 21  # elements of the sets of a block, about
COUNTED = 1 << 21  # postings that are counted at once
SEEN = 100_000  # classes or pairs that a task remembers; it may forget them at any time
_BAND = 1.25
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values of a public 64-bit mixer
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80  # links need 100 * intersection >= percent * union

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def difference(self, one: int, other: int) -> int:
        """Most elements in which two linked sets of these sizes differ."""
        return (100 - self.percent) * (one + other) // (100 + self.percent)

    def linked(self, common: int, one: int, other: int) -> bool:
        return 100 * common >= self.percent * (one + other - common)


def word_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words are one shingle, no word is the empty set."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    each = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
    size = min(words, len(tokens))
    out = np.full(len(tokens) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mixed(out * _A + each[i : len(tokens) - size + 1 + i])
    return np.unique(out)


@dataclass(frozen=True)
class Plan:
    number: int
    segments: int
    deletions: bool
    bits: int  # of the parity sketch


@lru_cache(maxsize=None)
def bands(settings: Settings, upto: int) -> tuple[tuple[int, ...], tuple[Plan, ...]]:
    """Lower size bounds of the bands that reach ``upto``, and the plan of each."""
    lows, plans = [1], []
    while True:
        low = lows[-1]
        high = max(low + 1, floor(low * _BAND))  # first size of the next band
        most = settings.difference(high - 1, high - 1)
        exact, deleted = most + 1 + ceil(most / 12), most // 2 + 1
        # rows to write, and chance meetings, which fall to a quarter with each element of a segment
        cost_exact = exact + 100 * exact * 4 ** -(low / exact)
        cost_deleted = low + deleted + 100 * low * 4 ** -max(0, low / deleted - 1)
        deletions = cost_deleted < cost_exact
        bits = max(64, 1 << (high - 1).bit_length())
        plans.append(Plan(len(plans), deleted if deletions else exact, deletions, bits))
        if high > upto:
            return tuple(lows), tuple(plans)
        lows.append(high)


def band_of(settings: Settings, size: int) -> Plan:
    lows, plans = bands(settings, 1 << max(10, size.bit_length() + 1))
    return plans[int(np.searchsorted(lows, size, side="right")) - 1]


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the elements by hash bucket; folding halves it."""
    counts = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little")


def folded(packed: np.ndarray, bits: int) -> np.ndarray:
    while packed.shape[-1] * 8 > bits:
        half = packed.shape[-1] // 2
        packed = packed[..., :half] ^ packed[..., half:]
    return packed


def _segment_keys(elements: np.ndarray, plan: Plan, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set in a band, and which of them probe; with ``probes`` None all rows count as indexed only."""
    values = mixed(elements + _B)
    segment = (mixed(elements ^ _A) % np.uint64(plan.segments)).astype(np.int64)
    sizes = np.bincount(segment, minlength=plan.segments)
    order = np.argsort(segment, kind="stable")
    sums = np.zeros(plan.segments, dtype=np.uint64)
    full = np.nonzero(sizes)[0]
    sums[full] = np.add.reduceat(values[order], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
    chosen = np.zeros(plan.segments, dtype=bool)
    if probes is not None:
        chosen[np.argsort(-sizes, kind="stable")[:probes]] = True
    base = np.arange(plan.segments, dtype=np.uint64) * _A + np.array([plan.number], dtype=np.uint64) * _B
    keys, probing = mixed(mixed(sums) + base), chosen
    if plan.deletions:
        less = mixed(mixed(sums[segment] - values) + base[segment])
        keys, probing = np.concatenate([keys, less]), np.concatenate([probing, chosen[segment]])
    return keys, probing


def segment_rows(elements: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(key, probe) rows of a set: indexed in its own band, probing there and in the bands of larger partners."""
    size = len(elements)
    largest = settings.largest_partner(size)
    if settings.difference(size, largest) < 1 and largest <= size:
        smaller = size - 1
        if smaller < 1 or settings.largest_partner(smaller) < size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)  # only equal sets can be linked
    own, last = band_of(settings, size), band_of(settings, largest)
    keys, probing = [], []
    plan = own
    lows, plans = bands(settings, 1 << max(10, largest.bit_length() + 1))
    for plan in plans[own.number : last.number + 1]:
        high = min(largest, (lows[plan.number + 1] - 1) if plan.number + 1 < len(lows) else largest)
        most = settings.difference(size, high)
        probes = most // 2 + 1 if plan.deletions else most + 1
        k, p = _segment_keys(elements, plan, probes)
        if plan.number > own.number:
            k, p = k[p], p[p]
        keys.append(k)
        probing.append(p)
    return np.concatenate(keys), np.concatenate(probing)


_LAST = (1 << 63) - 1  # stands for a null id


def set_table(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, at, text_hash, n, class, digest, sketch) of every row; ``at`` is the id, the largest number for null."""

    def work(batches):
        for ids, hashes, texts in batches:
            out = []
            for text in texts:
                elements = word_set(text, settings.words)
                n, raw = len(elements), elements.tobytes()
                bits = band_of(settings, max(1, settings.largest_partner(n))).bits
                packed = sketch(elements, bits).tobytes() if n else b""
                out.append((n, xxhash.xxh3_64_intdigest(raw) >> 1, xxhash.xxh3_128_hexdigest(raw), packed))
            yield [ids, [_LAST if i is None else i for i in ids], hashes, *([list(c) for c in zip(*out)] or [[], [], [], []])]

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return map_lists(rows, work, "doc_id bigint, at bigint, text_hash bigint, n bigint, class bigint, digest string, sketch binary")


def segment_table(docs: DataFrame, settings: Settings) -> DataFrame:
    """(key, class, probe) of every class; a task writes the rows of a class once."""

    def work(batches):
        seen: set[int] = set()
        for (texts,) in batches:
            keys, classes, probing = [], [], []

            def out():
                return [np.concatenate(keys).astype(np.int64).tolist(), np.concatenate(classes).tolist(), np.concatenate(probing).tolist()]

            held = 0
            for text in texts:
                elements = word_set(text, settings.words)
                name = xxhash.xxh3_64_intdigest(elements.tobytes()) >> 1
                if not len(elements) or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                k, p = segment_rows(elements, settings)
                keys.append(k)
                probing.append(p)
                classes.append(np.full(len(k), name, dtype=np.int64))
                held += len(k)
                if held > 200_000:
                    yield out()
                    keys, classes, probing, held = [], [], [], 0
            if keys:
                yield out()

    return map_lists(docs.select("text"), work, "key bigint, class bigint, probe boolean")


def shared_segments(rows: DataFrame) -> DataFrame:
    """(key, class, probe, place) of the keys that at least two classes have; ``place`` counts the classes of a key."""
    ordered = rows.repartition("key").sortWithinPartitions("key", "class", F.desc("probe"))

    def work(batches):
        key = first = last = None
        place = 0
        for keys, classes, probing in batches:
            out: list[tuple] = []
            for k, c, p in zip(keys, classes, probing):
                if k != key:
                    key, first, last, place = k, (k, c, p, 0), c, 0
                elif c != last:
                    if first:
                        out.append(first)
                        first = None
                    last, place = c, place + 1
                    out.append((k, c, p, place))
            if out:
                yield [list(x) for x in zip(*out)]

    return map_lists(ordered, work, "key bigint, class bigint, probe boolean, place bigint")


def in_blocks(rows: DataFrame, group: str, place: str) -> DataFrame:
    """Rows with ``one`` and ``other``: each pair of blocks of a group gets the rows of both blocks.

    A group of up to ``BLOCK`` rows is a single block, and its rows stay as
    they are; larger ones are copied to the block pairs they belong to.
    """
    last = rows.groupBy(group).agg(F.max(place).alias("_last"))
    own = F.floor(F.col(place) / BLOCK)
    return (
        rows.join(last, group)
        .withColumn("_b", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / BLOCK))))
        .withColumn("one", F.least("_b", "_o"))
        .withColumn("other", F.greatest("_b", "_o"))
        .drop("_last", "_b", "_o")
    )


def _groups(batches, width: int) -> Iterator[list[list]]:
    """Columns of each group of rows that agree in the first ``width`` columns, from sorted batches."""
    held: list[list] | None = None
    for batch in batches:
        count = len(batch[0])
        start = 0
        keys = list(zip(*batch[:width]))
        while start < count:
            end = start + 1
            while end < count and keys[end] == keys[start]:
                end += 1
            part = [c[start:end] for c in batch]
            if held and tuple(c[0] for c in held[:width]) == keys[start]:
                for mine, more in zip(held, part):
                    mine.extend(more)
            else:
                if held:
                    yield held
                held = part
            start = end
    if held:
        yield held


def possible_links(rows: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Forest edges (a, b) over class numbers: each linked pair lies in one tree."""
    known = classes.select("class", "number", "n", "sketch")
    probed = rows.groupBy("key").agg(F.max("probe").alias("_any")).where("_any").select("key")
    dealt = in_blocks(rows.join(probed, "key").join(known, "class"), "key", "place").select("key", "one", "other", "number", "n", "probe", "sketch")
    ordered = dealt.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other", "number")

    def work(batches):
        ruled_out: set[tuple[int, int]] = set()
        forest = Forest()
        for _, _, _, names, sizes, probing, sketches in _groups(batches, 3):
            edges: list[tuple[int, int]] = []
            if len(names) == 2:
                pair = (names[0], names[1])
                if pair in ruled_out or forest.find(pair[0]) == forest.find(pair[1]):
                    continue
            if len(forest.parent) > SEEN:
                forest = Forest()
            for a, b in _close_pairs(names, sizes, probing, sketches, settings):
                if forest.join(a, b):
                    edges.append((a, b))
            if len(names) == 2 and not edges and any(probing):  # without a probing side nothing was compared
                if len(ruled_out) > SEEN:
                    ruled_out.clear()
                ruled_out.add(pair)
            if edges:
                yield [list(x) for x in zip(*edges)]

    return map_lists(ordered, work, "a bigint, b bigint")


def _close_pairs(names: list[int], sizes: list[int], probing: list[bool], sketches: list[bytes], settings: Settings) -> Iterator[tuple[int, int]]:
    """Pairs of which one side probes and that size and sketch don't rule out."""
    n = np.array(sizes, dtype=np.int64)
    probe = np.array(probing, dtype=bool)
    bits = min(len(s) for s in sketches) * 8
    packed = np.stack([folded(np.frombuffer(s, dtype=np.uint8), bits) for s in sketches])
    for i in range(len(names) - 1):
        small, large = np.minimum(n[i + 1 :], n[i]), np.maximum(n[i + 1 :], n[i])
        apart = np.bitwise_count(packed[i + 1 :] ^ packed[i]).sum(axis=1, dtype=np.int64)
        fine = (probe[i + 1 :] | probe[i]) & (100 * small >= settings.percent * large)
        fine &= (100 + settings.percent) * apart <= (100 - settings.percent) * (small + large)
        for j in np.nonzero(fine)[0].tolist():
            yield names[i], names[i + 1 + j]


def exact_links(trees: DataFrame, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Forest edges (a, b) over class numbers, each an exactly verified link."""
    chosen = classes.join(trees.select(F.col("node").alias("number"), "root"), "number").select("number", "root", "first.at", "first.text_hash")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("at"), F.xxhash64("text").alias("text_hash"), "text")

    def sets(batches):
        for roots, numbers, raw in batches:
            yield [roots, numbers, [word_set(t, settings.words).tobytes() for t in raw]]

    found = chosen.join(texts, ["at", "text_hash"]).select("root", "number", "text")
    with_sets = map_lists(found, sets, "root bigint, number bigint, elements binary")
    with_sets = staged(with_sets.dropDuplicates(["number"]), "sets")
    sizes = with_sets.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.length("elements") / 8).alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_ELEMENTS))
    numbered = with_sets.join(sizes, "root").withColumn("place", F.pmod(F.xxhash64("number"), blocks) * BLOCK).drop("members", "total")
    dealt = in_blocks(numbered, "root", "place").select("root", "one", "other", "number", "elements")
    ordered = dealt.repartition("root", "one", "other").sortWithinPartitions("root", "one", "other", "number")

    def work(batches):
        for _, _, _, names, elements in _groups(batches, 3):
            edges = list(_verified(names, [np.frombuffer(e, dtype=np.uint64) for e in elements], settings))
            if edges:
                yield [list(x) for x in zip(*edges)]

    return map_lists(ordered, work, "a bigint, b bigint")


def _verified(names: list[int], sets: list[np.ndarray], settings: Settings) -> Iterator[tuple[int, int]]:
    """Forest of the linked pairs, by counting common elements over an inverted index of the block."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, terms = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(terms, kind="stable")
    posting = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(terms))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    forest = Forest()
    for i in range(len(sets)):
        mine = terms[begin[i] : begin[i + 1]]
        common = np.zeros(len(sets), dtype=np.int64)
        step = max(1, COUNTED // len(sets))  # an element has at most one posting a set
        for k in range(0, len(mine), step):
            low, high = starts[mine[k : k + step]], starts[mine[k : k + step] + 1]
            counts = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            common += np.bincount(posting[at], minlength=len(sets))
        fine = 100 * common >= settings.percent * (sizes + sizes[i] - common)
        fine[: i + 1] = False
        for j in np.nonzero(fine)[0].tolist():
            if forest.join(i, j):
                yield names[i], names[j]


def joined(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    The component is named by its smallest doc_id. Texts without words have
    the empty set and are linked with nothing; equal sets are always linked.
    Null ids take part in links and never name a component, unless no other
    id is there. Repeated rows keep their rows; other columns are ignored.
    """
    table, named = _grouped(docs, settings)
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = named.select("digest", "root").join(names, "root").select("digest", "component_id")
    full = table.where("n > 0").join(by_class, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)


def _grouped(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The table of sets, and its classes (digest, doc_id, first) with the ``root`` of their component."""
    table = staged(set_table(docs, settings), "sets")
    classes = (
        table.where("n > 0")
        .groupBy("class", "digest")
        .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("at", "text_hash")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    # numbers are given once, as the table is written; later steps carry them in place of digests
    classes = staged(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    rows = staged(shared_segments(segment_table(docs, settings)), "segments")
    trees = components(possible_links(rows, classes, settings))
    roots = components(exact_links(trees, docs, classes, settings)).select(F.col("node").alias("number"), "root")
    return table, classes.join(roots, "number", "left").select("digest", "doc_id", "first", F.coalesce("root", "number").alias("root"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` for each component, the first one, with all its columns.

    First is the smallest id (null last), then the smallest hash of the
    text; of rows that repeat both one stays, whichever is met first. Rows
    without words are linked with nothing and all stay.
    """
    _, named = _grouped(docs, settings)
    key = unused(docs.columns, "_first_at", "_first_hash")
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias(key[0]), F.col("first.text_hash").alias(key[1]))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(has_words).withColumns({key[0]: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), key[1]: F.xxhash64("text")})
    # copies collapse before the exchange that the join uses too
    kept = keyed.dropDuplicates(key).join(chosen, key, "left_semi").select(*plain_columns(docs))
    return kept.unionByName(docs.where(~has_words))
