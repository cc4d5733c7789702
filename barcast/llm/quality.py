"""Quality classifier: averaged vectors of words and character n-grams, softmax output, trained by numpy SGD.

Every word of a text gives features: the word, its character n-grams within
word borders, and a mark where it repeats the word before it. Each is
hashed to a row of a learned matrix; a text is the mean of its rows, and a
softmax layer gives the class probabilities. Averaging and the layer are
linear, so for two classes a trained model folds into one number per row, and
scoring is a sum of remembered numbers per distinct word.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import held_out, labelled_sample, map_lists, row_map

THRESHOLD = 0.7
MAX_WORDS = 300_000  # remembered words and n-grams per worker
MAX_WORD_CHARS = 64  # longer words are not remembered


@dataclass(frozen=True)
class Settings:
    per_class: int = 2_000  # bound on labelled rows of a class used in training
    buckets: int = 1 << 17
    dim: int = 8
    steps: int = 750  # mini-batches, whatever the number of rows
    rate: float = 2.0
    batch: int = 32
    size: int = 3  # of character n-grams
    seed: int = 7


REPEAT = 0  # row of the mark for a word equal to the one before


class Features:
    """Hashed rows of words; n-grams and words met before are looked up."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.rows_of_grams: dict[str, int] = {}

    def _row(self, gram: str) -> int:
        found = self.rows_of_grams.get(gram)
        if found is None:
            if len(self.rows_of_grams) >= MAX_WORDS:
                self.rows_of_grams.clear()
            found = self.rows_of_grams[gram] = self.hashed(gram)
        return found

    def hashed(self, text: str) -> int:
        return xxhash.xxh3_64_intdigest(text) % (self.settings.buckets - 1) + 1

    def word(self, word: str) -> list[int]:
        """Rows of the word and of its character n-grams."""
        framed, n = f"<{word}>", self.settings.size
        known, row = self.rows_of_grams, self._row
        grams = [framed[i : i + n] for i in range(len(framed) - n + 1)]
        return [self.hashed(word), *[known[g] if g in known else row(g) for g in grams]]

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows of a text and how often each occurs."""
        words = (text or "").split()
        rows: list[int] = [REPEAT] * sum(map(eq, words, words[1:]))
        for word, times in Counter(words).items():
            rows += self.word(word) * times
        return np.unique(np.array(rows, dtype=np.int32), return_counts=True)


@dataclass(frozen=True)
class Model:
    """Weight per row (difference of the two classes) and bias, after folding."""

    weights: np.ndarray
    bias: float
    settings: Settings


def train(rows: list[tuple[int, float, np.ndarray, np.ndarray]], settings: Settings) -> Model:
    """Fit on (label, weight, features, counts) by mini-batch SGD with a linearly falling rate."""
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1 / settings.dim, 1 / settings.dim, (settings.buckets, settings.dim)).astype(np.float32)
    layer = np.zeros((settings.dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    order: list[int] = []
    for step in range(settings.steps if rows else 0):
        if len(order) < settings.batch:
            order += rng.permutation(len(rows)).tolist()
        chosen, order = [rows[i] for i in order[: settings.batch]], order[settings.batch :]
        rate = settings.rate * (1 - step / settings.steps)
        sizes = np.array([len(r[2]) for r in chosen])
        full = sizes > 0
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(int)
        where = np.concatenate([r[2] for r in chosen])
        share = np.concatenate([r[3] / max(1, r[3].sum()) for r in chosen]).astype(np.float32)
        hidden = np.zeros((len(chosen), settings.dim), np.float32)
        if len(where):
            hidden[full] = np.add.reduceat(table[where] * share[:, None], starts)
        logits = hidden @ layer + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        slope = odds / odds.sum(1, keepdims=True)
        slope[np.arange(len(chosen)), [r[0] for r in chosen]] -= 1
        slope *= (np.array([r[1] for r in chosen], np.float32) / len(chosen))[:, None]
        back = slope @ layer.T
        layer -= rate * hidden.T @ slope
        bias -= rate * slope.sum(0)
        if len(where):
            step_by_row = np.repeat(back, sizes, axis=0) * share[:, None] * np.float32(rate * settings.batch)
            np.subtract.at(table, where, step_by_row)
    change = layer[:, 1] - layer[:, 0]
    return Model((table @ change).astype(np.float32), float(bias[1] - bias[0]), settings)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model of ``labels.quality`` from a bounded sample of labelled rows outside the held-out quarter.

    Features are made by the executors; the driver gets at most ``2 *
    per_class`` rows of at most ``buckets`` numbers. Without any usable label
    the model scores 0.5 everywhere.
    """
    sample = labelled_sample(docs, labels, "quality", settings.per_class)

    def work(batches):
        features = Features(settings)
        for texts, values, weights in batches:
            made = [features.text(t) for t in texts]
            yield [values, weights, [f.astype("<i4").tobytes() for f, _ in made], [c.astype("<i4").tobytes() for _, c in made]]

    rows = map_lists(sample.select("text", "label", "weight"), work, "label int, weight double, features binary, counts binary").collect()
    rows = sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in rows)  # training does not depend on arrival
    return train([(y, w, np.frombuffer(f, "<i4"), np.frombuffer(c, "<i4").astype(np.float32)) for y, w, f, c in rows], settings)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.features = Features(model.settings)
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        total = float(sum(map(self.model.weights.item, self.features.word(word))))
        if len(word) <= MAX_WORD_CHARS:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[word] = total
        return total

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        known, word = self.known, self._word
        repeats = sum(map(eq, words, words[1:]))
        total = sum([known[w] if w in known else word(w) for w in words]) + repeats * float(self.model.weights[REPEAT])
        # a word of n characters has n + 3 - size n-grams (none below 0)
        extra = 4 - self.model.settings.size
        size = repeats + sum(max(1, len(w) + extra) for w in words)
        logit = self.model.bias + (total / size if size else 0.0)
        return float(1 / (1 + np.exp(-logit))) if logit > -700 else 0.0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of class 1 for every row of ``docs``, null and empty texts included.

    Rows are scored one by one, so repeated rows and ids keep their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * 4 bytes

    def start():
        scorer = Scorer(shared.value)
        return lambda doc_id, text: (doc_id, scorer.score(text))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return row_map(docs.select("doc_id", "text"), start, f"doc_id {kind}, score double")


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model fitted on ``labels``."""
    scored = score(docs, fit(docs, labels, settings))
    return scored.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))
    names = docs.columns
    at = names.index("text")

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            good = [scorer.score(t) >= THRESHOLD for t in batch[at]]
            yield [[v for v, g in zip(column, good) if g] for column in batch]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_lists(docs, work, schema)
