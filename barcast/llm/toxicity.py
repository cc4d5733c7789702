"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Terms are the character n-grams of the words, within word borders. Those that
tell the classes of the examples apart (log-likelihood ratio), whichever class
they speak for, make up the vocabulary; vectors and cosines are over it. The inverted index holds the examples in blocks; each list has the
largest weight per block, so whole blocks whose best possible cosine stays
below the k-th best of the most promising ones are skipped. What is left is
computed in single precision, the longest lists from dense tables, and what its error
leaves open exactly.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import held_out, labelled_sample, map_lists, row_map

THRESHOLD = 0.3
FIRST = 16  # the blocks computed first hold so many times k examples
DENSE = 64  # terms in at least 1 / DENSE of the examples are kept as dense tables,
DENSE_BYTES = 32 << 20  # those of the longest lists first, up to so many bytes


@dataclass(frozen=True)
class Settings:
    per_class: int = 1_500  # bound on labelled rows of a class used as examples
    sizes: tuple[int, ...] = (4, 5, 6)
    min_gain: float = 12.0  # log-likelihood ratio of a term; a term independent of the label reaches it in about 1 of 1,900 cases
    min_examples: int = 4  # examples a term must occur in
    max_terms: int = 20_000  # the strongest terms are kept
    neighbours: int = 15
    block: int = 64
    power: float = 4.0  # votes weigh cosine ** power
    prior: float = 0.25  # weight of the base rate in a vote


def grams(word: str, settings: Settings) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for n in settings.sizes for i in range(len(framed) - n + 1)]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Blocks:
    """Weights by block: the largest of each (term, block), and those of the terms with the longest lists as one dense table per block."""

    tops: np.ndarray  # (term, block), never below the weights
    dense: np.ndarray  # (block, dense term, example of the block)
    place: np.ndarray  # number of each term among the dense ones, -1 for the others

    @staticmethod
    def of(index: Index) -> Blocks:
        size, n = index.settings.block, len(index.ids)
        blocks, lengths = -(-n // size), np.diff(index.lists)
        terms = np.repeat(np.arange(len(lengths)), lengths)
        tops = np.zeros((len(lengths), blocks), dtype=np.float32)
        np.maximum.at(tops, (terms, index.rows // size), np.nextafter(index.weights.astype(np.float32), np.float32(2)))
        long = np.nonzero(lengths * DENSE >= n)[0]
        long = long[np.argsort(-lengths[long], kind="stable")][: max(1, DENSE_BYTES // (4 * size * blocks))]
        place = np.full(len(lengths), -1)
        place[long] = np.arange(len(long))
        dense = np.zeros((blocks, len(long), size), dtype=np.float32)
        use = place[terms] >= 0
        dense[index.rows[use] // size, place[terms[use]], index.rows[use] % size] = index.weights[use]
        return Blocks(tops, dense, place)

    def query(self, index: Index, terms: np.ndarray, weights: np.ndarray) -> Query:
        place = self.place[terms]
        long = place >= 0
        short, rest = terms[~long], weights[~long]
        begins, lengths = index.lists[short], index.lists[short + 1] - index.lists[short]
        at = _spread(begins, lengths)
        blocks, _, size = self.dense.shape
        others = np.bincount(index.rows[at], np.repeat(rest, lengths) * index.weights[at], minlength=blocks * size).astype(np.float64)
        return Query(self, terms, weights.astype(np.float32), place[long], weights[long].astype(np.float32), others.reshape(blocks, size))


@dataclass
class Query:
    blocks: Blocks
    terms: np.ndarray
    weights: np.ndarray
    places: np.ndarray  # of its dense terms
    heavy: np.ndarray  # their weights
    others: np.ndarray  # (block, example): sums over the terms that are not dense

    def bounds(self) -> np.ndarray:
        """Of each block, what no cosine exceeds."""
        return (self.weights @ self.blocks.tops[self.terms]).astype(np.float64) * (1 + (len(self.terms) + 4) * 2.0**-23)

    def sums(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The examples of some blocks and their cosines in single precision."""
        size, out = self.others.shape[1], self.others[chosen]
        if len(self.places):
            table = np.empty((len(self.places), size), dtype=np.float32)
            for at, block in enumerate(chosen.tolist()):
                self.blocks.dense[block].take(self.places, 0, table, "clip")
                out[at] += self.heavy @ table
        return (chosen[:, None] * size + np.arange(size)).ravel(), out.ravel()


@dataclass
class Index:
    """Examples in blocks: inverted lists, with the largest weight of each list in each block."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    settings: Settings
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # weight of an example's vote, by class
    base: float  # share of label 1 among examples without any term, smoothed
    # postings, sorted by term and example, and where each term's begin
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lists: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    # the same by example and term
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    examples: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    blocked: Blocks | None = None  # made where it is used, so it is never sent

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length TF-IDF weights of term counts (empty without any term)."""
        terms = np.array(sorted(counts), dtype=np.int64)
        tf = np.array([counts[t] for t in terms.tolist()], dtype=np.float64)
        weights = (1 + np.log(tf)) * self.idf[terms] if len(terms) else tf
        norm = np.sqrt((weights**2).sum())
        return terms, weights / norm if norm else weights

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0, dtype=np.int64)])
        self.values = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        sizes = [len(t) for t, _ in vectors]
        self.examples = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        rows = np.repeat(np.arange(len(vectors)), sizes)
        order = np.lexsort((rows, self.terms))
        self.rows, self.weights = rows[order], self.values[order]
        self.lists = np.searchsorted(self.terms[order], np.arange(len(self.vocabulary) + 1))
        self.blocked = None

    def nearest(self, terms: np.ndarray, weights: np.ndarray, leave_out: int = -1) -> list[tuple[int, float]]:
        """The k examples of largest positive cosine, exactly; equal cosines go by example number.

        The blocks of largest bound are computed first; of the others only
        those whose bound reaches the k-th best cosine found there. This is in
        single precision, so all examples that its error could hide are computed once more in double.
        """
        if not len(self.terms):
            return []
        if self.blocked is None:
            self.blocked = Blocks.of(self)
        size, k = self.settings.block, self.settings.neighbours
        slack = (len(terms) + 4) * 2.0**-23  # twice the error of a sum of so many products, as the vectors have length one
        near = self.blocked.query(self, terms, weights)
        bounds = near.bounds()

        def cosines(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows, sums = near.sums(chosen)
            found = (sums > 0) & (rows != leave_out)
            return rows[found], sums[found]

        first = np.zeros(len(bounds), dtype=bool)
        head = max(1, FIRST * k // size)
        first[np.argpartition(-bounds, head - 1)[:head] if len(bounds) > head else slice(None)] = True
        rows, sums = cosines(np.nonzero(first)[0])
        floor = np.partition(sums, -k)[-k] - 2 * slack - 1e-9 if len(sums) >= k else 0.0
        others = np.nonzero(~first & (bounds > 0) & (bounds >= floor))[0]
        if len(others):
            more, larger = cosines(others)
            rows, sums = np.concatenate([rows, more]), np.concatenate([sums, larger])
        if len(sums) > k:
            rows = rows[sums >= np.partition(sums, -k)[-k] - 2 * slack - 1e-9]
        rows = np.sort(rows)
        values = self.exact(terms, weights, rows)
        best = np.lexsort((rows, -values))[:k]
        return list(zip(rows[best].tolist(), values[best].tolist()))

    def exact(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines with some examples, rounded to 12 digits."""
        query = np.zeros(len(self.vocabulary))
        query[terms] = weights
        begins, lengths = self.examples[rows], self.examples[rows + 1] - self.examples[rows]
        at = _spread(begins, lengths)
        return np.round(np.bincount(np.repeat(np.arange(len(rows)), lengths), query[self.terms[at]] * self.values[at], minlength=len(rows)), 12)

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Distance-weighted share of label 1, drawn to the base rate where the neighbours are far."""
        top, bottom = self.settings.prior * self.base, self.settings.prior
        for row, cosine in near:
            weight = self.votes[row] * cosine**self.settings.power
            top += weight * self.labels[row]
            bottom += weight
        return top / bottom


def build(examples: list[tuple[int, int, float, dict[str, int]]], settings: Settings) -> Index:
    """Index over (id, label, weight, n-gram counts), the counts holding vocabulary terms only."""
    examples = sorted(examples, key=lambda e: (e[0], e[1]))
    terms = sorted({g for e in examples for g in e[3]})
    vocabulary = {g: i for i, g in enumerate(terms)}
    df = Counter(g for e in examples for g in e[3])
    idf = np.array([np.log((1 + len(examples)) / (1 + df[g])) + 1 for g in terms])
    labels = np.array([e[1] for e in examples], dtype=np.int64)
    votes = np.array([e[2] for e in examples], dtype=np.float64)
    bare = np.array([not e[3] for e in examples], dtype=bool)
    positive = (votes * labels)[bare].sum() if len(examples) else 0.0
    base = float((positive + 0.05) / (votes[bare].sum() + 1.0)) if len(examples) else 0.05
    index = Index(vocabulary, idf, settings, np.array([e[0] for e in examples], dtype=np.int64), labels, votes, base)
    index.add([index.vector(Counter({vocabulary[g]: c for g, c in e[3].items()})) for e in examples])
    return index


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Index:
    """Index of a bounded sample of rows with ``labels.toxic``, outside the held-out quarter.

    Term statistics are one aggregation over the examples; the driver gets
    at most ``max_terms`` terms and ``2 * per_class`` term lists.
    """
    sample = labelled_sample(docs, labels, "toxic", settings.per_class).dropDuplicates(["text", "label"])

    def present(batches):
        for texts, values in batches:
            yes: Counter = Counter()
            no: Counter = Counter()
            for text, value in zip(texts, values):
                (yes if value else no).update({g for w in set(words_of(text)) for g in grams(w, settings)})
            both = list(yes.keys() | no.keys())
            yield [[g for g in both], [yes[g] for g in both], [no[g] for g in both]]

    kinds = {r["label"]: float(r["count"]) for r in sample.groupBy("label").count().collect()}
    p, n = kinds.get(1, 0.0), kinds.get(0, 0.0)
    yes, no = F.col("yes").cast("double"), F.col("no").cast("double")
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / ((yes + no) * of / (p + n)))).otherwise(0.0)
    rest = lambda seen, of: F.when(of > seen, (of - seen) * F.log((of - seen) / ((p + n - yes - no) * of / (p + n)))).otherwise(0.0)
    gain = 2 * (part(yes, p) + part(no, n) + rest(yes, p) + rest(no, n))
    strong = []
    if p and n:
        strong = (
            map_lists(sample.select("text", "label"), present, "term string, yes long, no long")
            .groupBy("term")
            .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
            .where((yes + no >= settings.min_examples) & (yes + no < p + n))
            .withColumn("gain", gain)
            .where(F.col("gain") >= settings.min_gain)
            .orderBy(F.desc("gain"), "term")
            .limit(settings.max_terms)
            .select("term")
            .collect()
        )
    vocabulary = {r["term"] for r in strong}

    def counted(batches):
        for ids, texts, values, weights in batches:
            bags = [Counter(g for w in words_of(t) for g in grams(w, settings) if g in vocabulary) for t in texts]
            yield [ids, values, weights, [list(b) for b in bags], [list(b.values()) for b in bags]]

    rows = map_lists(sample.select("doc_id", "text", "label", "weight"), counted, "id long, label int, weight double, terms array<string>, counts array<int>").collect()
    return build([(r[0], r[1], r[2], dict(zip(r[3], r[4]))) for r in rows], settings)


class Scorer:
    """Finds the terms of a text in one pass of an automaton over its words, set apart by single spaces."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.terms = ahocorasick.Automaton()
        for gram, term in index.vocabulary.items():
            self.terms.add_word(gram, term)
        self.terms.make_automaton()

    def counts(self, text: str | None) -> Counter:
        # a gram has spaces at its ends only, so each match lies in one framed word
        found = self.terms.iter(f" {' '.join(words_of(text))} ") if self.index.vocabulary else ()
        return Counter(map(itemgetter(1), found))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Score of a text and its evidence: (id of the example, cosine)."""
        counts = self.counts(text)
        near = self.index.nearest(*self.index.vector(counts)) if counts else []
        return self.index.vote(near), [(int(self.index.ids[row]), cosine) for row, cosine in near]


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence): every row of ``docs``, null and empty texts included.

    ``evidence`` lists the nearest examples (doc_id, cosine), empty where the
    text has no term of the vocabulary; such a text gets the base rate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by per_class and max_terms

    def start():
        scorer = Scorer(shared.value)

        def one(doc_id, text):
            value, near = scorer.score(text)
            return doc_id, value, [{"doc_id": i, "cosine": c} for i, c in near]

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return row_map(docs.select("doc_id", "text"), start, f"doc_id {kind}, score double, evidence array<struct<doc_id: bigint, cosine: double>>")


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row, by examples from ``labels``."""
    return score(docs, fit(docs, labels, settings)).select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )
