"""Removal of repeated byte strings by bucket-pointer refinement of suffix arrays.

Every window of ``length`` bytes has an anchor: the leftmost of its grams with the
smallest hash. Equal windows have equal anchors at equal places, so only
windows whose anchor gram occurs twice anywhere can repeat, and all equal
windows meet under one anchor. The bytes around those anchors are sorted per
anchor: suffixes fall into buckets by their first q bytes, and buckets are refined by the
bucket identifiers of later offsets; each pass uses the refined identifiers of
the pass before, so depth doubles. At full depth a bucket with two suffixes is a repeated window.
Contexts that a text holds several times go on once, with the ranges that they
cover there, so periodic text is as light as other text. Anchors with very
many occurrences are refined by Spark instead: their windows are grouped by
the identifiers of their bytes with map-side counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import map_lists

LENGTH = 200
GRAM = 64
CHUNK = 1 << 19  # bytes hashed at once
BLOCK = 1 << 20  # bytes of contexts whose suffixes are sorted at once
HOT = 5_000  # occurrences beyond which an anchor is refined by Spark
_LAST = (1 << 63) - 1  # stands for a null id
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values of a public 64-bit mixer


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` bytes, built from runs of doubling length."""
    out, width = data.astype(np.uint64) + np.uint64(1), 1
    power = _BASE
    parts: list[tuple[np.ndarray, int]] = []
    whole, done = None, 0
    while True:
        if gram & width:
            factor = np.uint64(pow(int(_BASE), width, 1 << 64))
            whole = out if whole is None else whole[: len(data) - done - width + 1] * factor + out[done : done + len(data) - done - width + 1]
            done += width
        if width * 2 > gram:
            break
        out = out[:-width] * power + out[width:]
        width *= 2
        power = np.uint64(pow(int(power), 2, 1 << 64))
    whole = (whole ^ (whole >> np.uint64(33))) * _M1
    whole = (whole ^ (whole >> np.uint64(33))) * _M2
    return whole ^ (whole >> np.uint64(33))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, position, first window, last window) of the anchors of a text, chunk by chunk.

    The windows first..last are those that the anchor stands for. A window
    always has the same anchor, so where chunks part its windows may be given
    in two pieces.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    span = length - gram + 1
    for low in range(0, max(0, len(whole) - length + 1), CHUNK):
        part = whole[low : low + CHUNK + length - 1]
        hashes = _gram_hashes(part, gram)
        # the place breaks ties to the left
        least, width = (hashes & ~np.uint64(0xFFFFF)) | np.arange(len(hashes), dtype=np.uint64), 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: width - span], least[span - width :])
        place = (least & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
        ends = np.concatenate([starts[1:], [len(place)]]) - 1
        yield hashes[place[starts]].astype(np.int64), place[starts] + low, starts + low, ends + low


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("at"), F.xxhash64("text").alias("text_hash"), "text")


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges joined where they touch."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > ends[:-1]])
    return begins[new], ends[np.concatenate([np.nonzero(new)[0][1:], [len(ends)]]) - 1]


def text_anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[list[int], list[int], list[int], list, list]:
    """(anchor, first window, last window, begins, ends) of the distinct contexts of a text.

    A context is the bytes of an anchor's windows. Where a text holds one
    several times, all of those windows are repeated: the context goes on once, with the
    byte ranges that its occurrences cover; otherwise the ranges are null.
    """
    parts = list(anchors(data, length, gram))
    if not parts:
        return [], [], [], [], []
    hashes, _, los, his = (np.concatenate(c) for c in zip(*parts))
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    begins: list = [None] * len(hashes)
    ends: list = [None] * len(hashes)
    again: dict[tuple[int, bytes], list[int]] = {}
    for i in np.nonzero(counts[inverse] > 1)[0].tolist():
        lo, hi = int(los[i]), int(his[i])
        again.setdefault((hi - lo, data[lo : hi + length]), []).append(i)
    stay = np.ones(len(hashes), dtype=bool)
    for same in again.values():
        if len(same) > 1:
            stay[same[1:]] = False
            b, e = merged(los[same], his[same] + length)
            begins[same[0]], ends[same[0]] = b.tolist(), e.tolist()
    kept = np.nonzero(stay)[0]
    return hashes[kept].tolist(), los[kept].tolist(), his[kept].tolist(), [begins[i] for i in kept], [ends[i] for i in kept]


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(at, text_hash, anchor, lo, hi, begins, ends) of the contexts of every text; windows lo..hi belong to the anchor."""

    def work(batches):
        for ids, hashes, texts in batches:
            held: list[list] = [[] for _ in range(7)]
            for at, text_hash, text in zip(ids, hashes, texts):
                found = text_anchors((text or "").encode(), length, gram)
                size = len(found[0])
                for column, values in zip(held, ([at] * size, [text_hash] * size, *found)):
                    column.extend(values)
                if len(held[0]) > 200_000:
                    yield held
                    held = [[] for _ in range(7)]
            if held[0]:
                yield held

    return map_lists(_keyed(docs), work, "at bigint, text_hash bigint, anchor bigint, lo bigint, hi bigint, begins array<bigint>, ends array<bigint>")


def refined(data: np.ndarray, length: int, q: int = 8) -> np.ndarray:
    """Bucket of each suffix of ``data`` by its first ``length`` bytes (suffixes near the end: by what there is)."""
    q = min(q, length)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(length + 1, dtype=np.uint64)])
    start = np.zeros(len(data), dtype=np.uint64)
    for i in range(min(q, 7)):  # 9 bits a byte fit seven times
        start = (start << np.uint64(9)) | padded[i : i + len(data)]
    # a bucket is named by its first place in the order of all suffixes
    _, inverse, counts = np.unique(start, return_inverse=True, return_counts=True)
    bucket = (np.cumsum(counts) - counts + 1)[inverse]
    size = counts[inverse]
    depth = min(q, 7)
    while depth < length:
        step = min(depth, length - depth)
        open_ = np.nonzero(size > 1)[0]  # a bucket of one suffix is final
        if not len(open_):
            break
        later = np.where(open_ + step < len(data), bucket[np.minimum(open_ + step, len(data) - 1)], 0)
        names, inverse, counts = np.unique(bucket[open_] * (len(data) + 2) + later, return_inverse=True, return_counts=True)
        owner = names // (len(data) + 2)
        before = np.cumsum(counts) - counts
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        start_of = before[np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))]
        bucket[open_] = (owner + before - start_of)[inverse]
        size[open_] = counts[inverse]
        depth += step
    return bucket


def repeated_starts(contexts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context which of its first ``windows`` windows equal another one; equal contexts are sorted once."""
    number: dict[bytes, int] = {}
    owner = [number.setdefault(c, len(number)) for c in contexts]
    times = np.bincount(owner)
    distinct = list(number)
    first = np.zeros(len(distinct), dtype=np.int64)
    count = np.zeros(len(distinct), dtype=np.int64)
    for o, w in zip(owner, windows):
        count[o] = w
    sizes = np.array([len(c) for c in distinct], dtype=np.int64)
    first[1:] = np.cumsum(sizes)[:-1]
    bucket = refined(np.frombuffer(b"".join(distinct), dtype=np.uint8), length)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    which = np.repeat(np.arange(len(distinct)), count)
    weight = np.bincount(bucket[at], weights=times[which])
    found = np.split(weight[bucket[at]] > 1, np.cumsum(count)[:-1])
    return [found[o] for o in owner]


def _spans(flags: np.ndarray, lo: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges covered by the runs of flagged windows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield lo + begin, lo + end - 1 + length


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(at, text_hash, begin, end) of byte ranges whose windows occur elsewhere too; ranges may overlap."""
    table = anchor_table(docs, length, gram)
    counts = table.groupBy("anchor").agg(F.count("*").alias("n"), F.count("begins").alias("own")).where("n > 1 or own > 0")
    place = F.struct("anchor", "lo", "hi", "begins", "ends", "n")
    wanted = table.join(counts, "anchor").groupBy("at", "text_hash").agg(F.collect_set(place).alias("places"))
    joined = _keyed(docs).join(wanted, ["at", "text_hash"])

    def cut(batches):
        for ids, hashes, texts, places in batches:
            out: list[tuple] = []
            for at, text_hash, text, own in zip(ids, hashes, texts, places):
                data = text.encode()
                for p in own:
                    out.append((p["anchor"], at, text_hash, p["lo"], p["hi"] - p["lo"] + 1, data[p["lo"] : p["hi"] + length]))
                    if len(out) >= 20_000:
                        yield [list(c) for c in zip(*out)]
                        out = []
            if out:
                yield [list(c) for c in zip(*out)]

    def contexts(hot_ones: bool) -> DataFrame:
        chosen = F.filter("places", lambda p: p["n"] > hot if hot_ones else (p["n"] > 1) & (p["n"] <= hot)).alias("places")
        some = joined.select("at", "text_hash", "text", chosen).where(F.size("places") > 0)
        return map_lists(some, cut, "anchor bigint, at bigint, text_hash bigint, lo bigint, windows int, bytes binary")

    def sort(batches):
        held: list[list] = [[] for _ in range(6)]
        size, last = 0, None

        def out():
            flags = repeated_starts(held[5], held[4], length)
            rows = [(a, h, b, e) for a, h, lo, f in zip(held[1], held[2], held[3], flags) for b, e in _spans(f, lo, length)]
            return [list(c) for c in zip(*rows)] if rows else None

        for batch in batches:
            for row in zip(*batch):
                if size >= BLOCK and row[0] != last:
                    if found := out():
                        yield found
                    held, size = [[] for _ in range(6)], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[5])
                last = row[0]
        if size and (found := out()):
            yield found

    cold = contexts(False).repartition("anchor").sortWithinPartitions("anchor")
    spans = map_lists(cold, sort, "at bigint, text_hash bigint, begin bigint, end bigint")
    own = wanted.select("at", "text_hash", F.explode(F.filter("places", lambda p: p["begins"].isNotNull())).alias("p"))
    own = own.select("at", "text_hash", F.explode(F.arrays_zip(F.col("p.begins").alias("begin"), F.col("p.ends").alias("end"))).alias("r"))
    own = own.select("at", "text_hash", F.col("r")["begin"].alias("begin"), F.col("r")["end"].alias("end"))
    return spans.unionByName(_by_identifiers(contexts(True), length)).unionByName(own)


def _by_identifiers(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of the contexts of frequent anchors: windows are grouped by identifier, equal contexts once."""
    kinds = contexts.groupBy("bytes", "windows").agg(F.count("*").alias("times"))

    def windows(batches):
        for texts, counts, times in batches:
            for data, count, n in zip(texts, counts, times):
                names = [xxhash.xxh3_128_digest(data[s : s + length]) for s in range(count)]
                yield [[xxhash.xxh3_128_digest(data)] * count, list(range(count)), names, [n] * count]

    each = map_lists(kinds, windows, "context binary, place int, window binary, times bigint")
    again = each.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    places = each.join(again, "window").groupBy("context").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def named(batches):
        for ats, hashes, los, texts in batches:
            yield [ats, hashes, los, [xxhash.xxh3_128_digest(t) for t in texts]]

    def ranges(batches):
        for ats, hashes, begins, found in batches:
            rows = []
            for at, text_hash, los, own in zip(ats, hashes, begins, found):
                flags = np.zeros(own[-1] + 1, dtype=bool)
                flags[own] = True
                rows += [(at, text_hash, lo + b, lo + e) for b, e in _spans(flags, 0, length) for lo in los]
            if rows:
                yield [list(c) for c in zip(*rows)]

    here = map_lists(contexts.select("at", "text_hash", "lo", "bytes"), named, "at bigint, text_hash bigint, lo bigint, context binary")
    here = here.groupBy("at", "text_hash", "context").agg(F.collect_set("lo").alias("los"))  # a text's own repeats go as one row
    return map_lists(here.join(places, "context").select("at", "text_hash", "los", "places"), ranges, "at bigint, text_hash bigint, begin bigint, end bigint")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes that stay.

    Bytes covered by a string of ``length`` bytes that starts anywhere else too, in
    the same text or another, are removed; strings are judged on the input.
    Null texts count as empty; rows that repeat a text remove each other's
    bytes. Other columns are ignored.
    """
    spans = repeated_spans(docs, length, gram, hot).groupBy("at", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    def work(batches):
        for ats, texts, spans_of in batches:
            out = []
            for text, spans in zip(texts, spans_of):
                data, end, kept, runs, removed = (text or "").encode(), 0, [], 0, 0
                for b, e in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if b > end or not runs:
                        kept.append(data[end:b])
                        runs += 1
                        removed += e - b
                        end = e
                    elif e > end:
                        removed += e - end
                        end = e
                kept.append(data[end:])
                out.append((len(data), removed, runs, b"".join(kept)))
            yield [[None if at == _LAST else at for at in ats], *([list(c) for c in zip(*out)] or [[], [], [], []])]

    # the same rows as those that contexts are cut from, so texts are exchanged once
    joined = _keyed(docs).join(spans, ["at", "text_hash"], "left").select("at", "text", "spans")
    return map_lists(joined, work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) at the standard length."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
