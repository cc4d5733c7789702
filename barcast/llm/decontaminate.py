"""Benchmark decontamination: suffix arrays of the training text, searched for every test suffix.

Documents are taken in shards of bounded length. A shard's words become numbers
(words that no test item has become 0), and its suffixes that begin with a
word pair of the benchmark, or with a test item of one word, are sorted. Each
suffix of each test item is found by binary search in full order: its neighbours
give the longest verbatim match. A window occurs where the match of its suffix is
as long as the window, and the run of suffixes that share its words gives all
its places. A document lies in one shard as a whole, so
its verdict needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import map_lists
from barcast.session import staged

WINDOW = 13
DEPTH = 16  # words of a suffix that are compared at once
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 8 << 20  # test text searched at once, and the bound on what is broadcast
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, letters and characters beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


@dataclass(frozen=True)
class TestSide:
    """A block of test items as word numbers, each item followed by zeros."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    items: list[str]  # item ids as text
    item_at: np.ndarray  # item of each word position, -1 between items
    offset_at: np.ndarray
    windows: np.ndarray  # first position of each distinct window
    lengths: np.ndarray
    window_items: list[list[int]]  # items with each window
    pairs: np.ndarray  # sorted codes of word pairs that begin a suffix
    singles: np.ndarray  # word numbers that are whole items


def test_side(items: list[tuple[str, str | None]], window: int = WINDOW) -> TestSide:
    vocabulary: dict[bytes, int] = {}
    words: list[int] = []
    item_at: list[int] = []
    offset_at: list[int] = []
    places: dict[tuple[int, ...], tuple[int, list[int]]] = {}
    singles: set[int] = set()
    for number, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        start = len(words)
        if len(ids) == 1:
            singles.add(ids[0])
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            known = places.setdefault(tuple(ids[at : at + window]), (start + at, []))[1]
            if not known or known[-1] != number:
                known.append(number)
        words += [*ids, 0]
        item_at += [*[number] * len(ids), -1]
        offset_at += [*range(len(ids)), -1]
    if len(vocabulary) >= 1 << 21:
        raise ValueError("a block of test items has too many distinct words; lower block_bytes")
    array = np.array([*words, *[0] * (DEPTH + 1)], dtype=np.int64)
    both = (array[:-1] > 0) & (array[1:] > 0)
    codes = array[:-1][both] * (len(vocabulary) + 1) + array[1:][both]
    return TestSide(
        vocabulary,
        array,
        [i for i, _ in items],
        np.array(item_at, dtype=np.int64),
        np.array(offset_at, dtype=np.int64),
        np.array([p for p, _ in places.values()], dtype=np.int64),
        np.array([len(w) for w in places], dtype=np.int64),
        [found for _, found in places.values()],
        np.unique(codes),
        np.array(sorted(singles), dtype=np.int64),
    )


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


class Shard:
    """Suffix array of the documents of a shard, for one block of test items."""

    def __init__(self, docs: list[list[int]], test: TestSide) -> None:
        self.test = test
        self.sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        flat: list[int] = []
        for ids in docs:
            flat += ids
            flat.append(0)
        flat += [0] * (DEPTH + 1)
        self.words = np.array(flat, dtype=np.int64)
        body = self.words[: len(self.words) - DEPTH - 1]
        after = self.words[1 : len(body) + 1]
        known = np.nonzero(body)[0]
        begins = _is_in(body[known], test.singles)
        pair = np.nonzero(after[known])[0]
        begins[pair] |= _is_in(body[known[pair]] * (len(test.vocabulary) + 1) + after[known[pair]], test.pairs)
        suffixes = known[begins]
        # no match goes on behind a word pair that the benchmark doesn't have
        follows = np.zeros(len(body), dtype=bool)
        follows[known[pair]] = _is_in(body[known[pair]] * (len(test.vocabulary) + 1) + after[known[pair]], test.pairs)
        ends = np.nonzero(~follows)[0]
        reach = ends[np.searchsorted(ends, suffixes)] - suffixes + 1
        self.keys = self._keys(self.words, suffixes, reach)
        order = np.lexsort(self.keys[::-1])
        self.array, self.reach = suffixes[order], reach[order]
        self.keys = [k[order] for k in self.keys]
        self._sort_ties()

    def _sort_ties(self) -> None:
        """Puts suffixes with equal first words in order of their next ones, as far as a test item can reach."""
        tied = np.arange(len(self.array))
        changed = np.ones(len(tied), dtype=bool)
        changed[1:] = np.any([k[1:] != k[:-1] for k in self.keys], axis=0)
        depth, most = DEPTH, int(self.test.offset_at.max(initial=-1)) + 1
        while depth < most and len(tied):
            group = np.cumsum(changed) - 1
            goes_on = np.bincount(group, self.reach[tied] > depth) > 0
            held = ((np.bincount(group) > 1) & goes_on)[group]
            tied, group = tied[held], group[held]
            at, reach = self.array[tied], self.reach[tied]
            keys = self._keys(self.words, at + depth, reach - depth)
            order = np.lexsort((*keys[::-1], group))
            self.array[tied], self.reach[tied] = at[order], reach[order]
            changed = np.ones(len(tied), dtype=bool)
            changed[1:] = np.any([k[order][1:] != k[order][:-1] for k in (group, *keys)], axis=0)
            depth += DEPTH

    def _keys(self, words: np.ndarray, at: np.ndarray, lengths: np.ndarray | None = None, fill: int = 0) -> list[np.ndarray]:
        """The first DEPTH words from each position, packed three to a number; from ``lengths`` on ``fill``."""
        keys = []
        for low in range(0, DEPTH, 3):
            key = np.zeros(len(at), dtype=np.int64)
            for i in range(low, min(low + 3, DEPTH)):
                word = words[np.minimum(at + i, len(words) - 1)]
                if lengths is not None:
                    word = np.where(i < lengths, word, fill)
                key = (key << 21) | word
            keys.append(key)
        return keys

    def _search(self, keys: list[np.ndarray], low=None, high=None, depth: int = 0, right: bool = False) -> np.ndarray:
        """For each key the number of suffixes below it (``right``: or equal to it), by binary search.

        The words from ``depth`` on are compared, between ``low`` and ``high``.
        """
        low = np.zeros(len(keys[0]), dtype=np.int64) if low is None else low
        high = np.full(len(keys[0]), len(self.array), dtype=np.int64) if high is None else high
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            below = np.zeros(len(low), dtype=bool)
            equal = np.ones(len(low), dtype=bool)
            if depth:
                values = self._keys(self.words, self.array[mid] + depth, self.reach[mid] - depth)
            else:
                values = [own[mid] for own in self.keys]
            for value, key in zip(values, keys):
                below |= equal & (value < key)
                equal &= value == key
            if right:
                below |= equal
            low = np.where(open_ & below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence of the windows that the longest matches cover."""
        test = self.test
        suffixes, length, _ = self.matches()
        reached = np.zeros(len(test.words), dtype=np.int64)
        reached[suffixes] = length
        present = np.nonzero(reached[test.windows] >= test.lengths)[0]
        begin, size = test.windows[present], test.lengths[present]
        first = self._search(self._keys(test.words, begin, size))
        last = self._search(self._keys(test.words, begin, size, (1 << 21) - 1))
        counts = last - first
        window = np.repeat(present, counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return window, self.array[np.repeat(first, counts) + within]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def verdicts(self) -> tuple[np.ndarray, list[list[int]]]:
        """For each document the words within any occurrence of a window, and the items with occurring windows."""
        window, at = self.places()
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.test.lengths[window], -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
        hits = total[self.starts + self.sizes] - total[self.starts]
        items: list[set[int]] = [set() for _ in self.sizes]
        pairs = np.unique(self.document(at) * (len(self.test.windows) + 1) + window)
        for doc, found in zip(*(x.tolist() for x in np.divmod(pairs, len(self.test.windows) + 1))):
            items[doc].update(self.test.window_items[found])
        return hits, [sorted(i) for i in items]

    def _insertion(self, suffixes: np.ndarray) -> np.ndarray:
        """For each test suffix its place among the sorted suffixes, by all its words."""
        test = self.test
        ends = np.nonzero(test.words == 0)[0]
        left = ends[np.searchsorted(ends, suffixes)] - suffixes
        keys = self._keys(test.words, suffixes, left)
        at = self._search(keys)
        open_, depth = np.nonzero(left > DEPTH)[0], DEPTH
        low = at[open_]
        high = self._search([k[open_] for k in keys], low, right=True)
        while True:
            goes_on = (low < high) & (left[open_] > depth)
            open_, low, high = open_[goes_on], low[goes_on], high[goes_on]
            if not len(open_):
                return at
            keys = self._keys(test.words, suffixes[open_] + depth, left[open_] - depth)
            low = self._search(keys, low, high, depth)
            high = self._search(keys, low, high, depth, right=True)
            at[open_] = low
            depth += DEPTH

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, length, word position) of the longest match of each test suffix; position -1 without any."""
        test = self.test
        suffixes = np.nonzero(test.item_at >= 0)[0] if len(self.array) else np.zeros(0, dtype=np.int64)
        at = self._insertion(suffixes)
        best = np.zeros(len(suffixes), dtype=np.int64)
        where = np.full(len(suffixes), -1, dtype=np.int64)
        for beside in (at, at - 1):
            valid = (beside >= 0) & (beside < len(self.array))
            start = self.array[np.clip(beside, 0, max(0, len(self.array) - 1))] if len(self.array) else beside
            length = np.zeros(len(suffixes), dtype=np.int64)
            open_ = np.nonzero(valid)[0]
            while len(open_):
                ours = test.words[suffixes[open_] + length[open_]]
                open_ = open_[(ours > 0) & (ours == self.words[np.minimum(start[open_] + length[open_], len(self.words) - 1)])]
                length[open_] += 1
            better = (length > best) | ((length == best) & (length > 0) & (start < where))
            best, where = np.where(better, length, best), np.where(better, start, where)
        return suffixes, best, where

    def longest(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, offset, length, document, word position) of the longest match of each test suffix."""
        test = self.test
        suffixes, best, where = self.matches()
        alone = (test.offset_at[suffixes] == 0) & (test.words[suffixes + 1] == 0)
        found = np.nonzero((best > 1) | ((best > 0) & alone))[0]
        docs = self.document(where[found])
        yield from zip(
            test.item_at[suffixes[found]].tolist(),
            test.offset_at[suffixes[found]].tolist(),
            best[found].tolist(),
            docs.tolist(),
            (where[found] - self.starts[docs]).tolist(),
        )


def _shards(batches, at: int, test: TestSide, shard_words: int) -> Iterator[tuple[list[list], list[list[int]]]]:
    """Rows as columns and their word numbers, in shards of about ``shard_words`` words."""
    number = test.vocabulary.get
    columns: list[list] | None = None
    docs: list[list[int]] = []
    size = 0
    for batch in batches:
        for row in zip(*batch):
            ids = [number(w, 0) for w in words_of(row[at])]
            if columns is None:
                columns = [[] for _ in row]
            for column, value in zip(columns, row):
                column.append(value)
            docs.append(ids)
            size += len(ids) + 1
            if size >= shard_words:
                yield columns, docs
                columns, docs, size = None, [], 0
    if columns is not None:
        yield columns, docs


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")


def _block_count(items: DataFrame, block_bytes: int) -> int:
    """Number of blocks of at most about ``block_bytes`` of text each."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-2 * total // block_bytes) if total > block_bytes else 1)


def _block(items: DataFrame, number: int, blocks: int, window: int) -> Broadcast:
    """One block of the test items, broadcast."""
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
    side = test_side(sorted((r["item_id"] or "", r["text"]) for r in part.collect()), window)
    return items.sparkSession.sparkContext.broadcast(side)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A null or empty text has no words and is clean; so is everything where
    the benchmark is empty. Rows with a null item id count under the empty
    id, repeated items count once, repeated documents keep their rows. A
    benchmark above ``block_bytes`` is searched block by block, each pass
    adding what it found to the rows.
    """
    items = _items(benchmark)
    blocks = _block_count(items, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", "text")
    if blocks == 1:
        return _verdict_pass(held, _block(items, 0, 1, window), kind)
    return _merged(_searched(held, items, blocks, window), kind)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _is_bad(size: int, hit: int) -> bool:
    return hit > 0 and 20 * hit >= size


_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _result(size: int, hit: int, items: set[str]) -> tuple:
    return size, hit, len(items), _digest(list(items)), _is_bad(size, hit)


def _verdict_pass(docs: DataFrame, block: Broadcast, kind: str) -> DataFrame:
    def work(batches):
        test = block.value
        for (ids, _), words in _shards(batches, 1, test, SHARD_WORDS):
            hits, found = Shard(words, test).verdicts()
            rows = [_result(len(w), h, {test.items[i] for i in f}) for w, h, f in zip(words, hits.tolist(), found)]
            yield [ids, *(list(c) for c in zip(*rows))]

    return map_lists(docs, work, f"doc_id {kind}, {_RESULT}")


def _searched(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """All columns of ``docs``, then the covered spans (begin, end, begin, end, ...) and the items of all blocks.

    One block is on the driver and the executors at a time.
    """
    spans, found = (next(n for n in (name + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("_spans", "_found"))
    rows = docs.select("*", F.lit(None).cast("array<int>").alias(spans), F.lit(None).cast("array<string>").alias(found))
    for number in range(blocks):
        block = _block(items, number, blocks, window)
        rows = staged(_collect_pass(rows, block), "contamination")
        block.destroy()
    return rows


def _collect_pass(rows: DataFrame, block: Broadcast) -> DataFrame:
    """Adds the spans and the items of one block to the last two columns of the rows."""
    at_text = rows.columns.index("text")

    def work(batches):
        test = block.value
        for (*kept, spans, items), words in _shards(batches, at_text, test, SHARD_WORDS):
            shard = Shard(words, test)
            window, at = shard.places()
            doc = shard.document(at)
            begin = at - shard.starts[doc]
            more: list[list[int]] = [[] for _ in words]
            for d, b, e in zip(doc.tolist(), begin.tolist(), (begin + test.lengths[window]).tolist()):
                more[d] += (b, e)
            _, found = shard.verdicts()
            yield [
                *kept,
                [(s or []) + m for s, m in zip(spans, more)],
                [sorted({*(i or []), *(test.items[n] for n in f)}) for i, f in zip(items, found)],
            ]

    return map_lists(rows, work, _schema(rows))


def _covered(spans: list[int]) -> int:
    """Words within any of the spans."""
    end = hit = 0
    for low, high in sorted(zip(spans[::2], spans[1::2])):
        hit += max(0, high - max(low, end))
        end = max(end, high)
    return hit


def _merged(rows: DataFrame, kind: str) -> DataFrame:
    def work(batches):
        for ids, texts, spans, items in batches:
            out = [_result(len(words_of(text)), _covered(flat), set(found)) for text, flat, found in zip(texts, spans, items)]
            yield [ids, *(list(c) for c in zip(*out))]

    return map_lists(rows, work, f"doc_id {kind}, {_RESULT}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; each row is judged by its own text."""
    items = _items(benchmark)
    blocks = _block_count(items, block_bytes)
    at, schema = docs.columns.index("text"), _schema(docs)

    def without(columns: list[list], hits: list[int], sizes: list[int]) -> list[list]:
        keep = [not _is_bad(n, h) for n, h in zip(sizes, hits)]
        return [[v for v, k in zip(column, keep) if k] for column in columns]

    if blocks > 1:

        def merged(batches):
            for *columns, spans, _ in batches:
                yield without(columns, [_covered(s) for s in spans], [len(words_of(t)) for t in columns[at]])

        return map_lists(_searched(docs, items, blocks, window), merged, schema)
    block = _block(items, 0, 1, window)

    def work(batches):
        test = block.value
        for columns, words in _shards(batches, at, test, SHARD_WORDS):
            hits, _ = Shard(words, test).verdicts()
            yield without(columns, hits.tolist(), [len(w) for w in words])

    return map_lists(docs, work, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, word_offset, length, doc_id, position): the longest verbatim match of every test suffix.

    Matches of one word count only for items of one word; a suffix without a
    match has no row. Of several places of that length one is given: each
    shard reports the neighbour in its suffix array, and one aggregation takes
    the longest, then the smallest (doc_id, position) of those, null ids last.
    """
    parts = None
    items = _items(benchmark)
    blocks = _block_count(items, block_bytes)
    for number in range(blocks):
        block = _block(items, number, blocks, WINDOW)

        def work(batches, block=block):
            test = block.value
            for (ids, _), words in _shards(batches, 1, test, SHARD_WORDS):
                rows = [(test.items[i], o, n, ids[d], p) for i, o, n, d, p in Shard(words, test).longest()]
                if rows:
                    yield [list(c) for c in zip(*rows)]

        found = map_lists(docs.select(F.col("doc_id").cast("long"), "text"), work, "item_id string, word_offset int, length int, doc_id bigint, position int")
        if blocks > 1:
            found = staged(found, "matches")
            block.destroy()
        parts = found if parts is None else parts.unionByName(found)
    best = F.max_by(F.struct("length", "doc_id", "position"), F.struct("length", -F.coalesce("doc_id", F.lit((1 << 62))), -F.col("position")))
    return parts.groupBy("item_id", "word_offset").agg(best.alias("b")).select("item_id", "word_offset", "b.length", "b.doc_id", "b.position")
