"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule looks at one trait of a text and votes good or bad, or abstains where the
trait is unclear. Nobody has labelled the texts: a latent class, good or one of a few kinds of
bad, explains the votes, which are independent given the class. Expectation-maximisation estimates the
share of each class and, for every rule, how often it is right on good texts and on
each kind of bad ones where it votes at all. It needs the texts only as counts of
vote patterns, one aggregation over all rows with at most 3 ** rules results. A
text stays where the posterior probability of a good text reaches a threshold,
whatever single rules say, and where the base rules don't rule it out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from math import log
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import row_map
from barcast.session import staged

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30  # of the base rules

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_NO_LETTER = bytes(b for b in range(128) if b not in SPACES + _UPPER + _LOWER)
_CLOSING = re.compile(rb"[#*$%&|<>](?=[\x20\x09-\x0D]|\Z)")


@dataclass(frozen=True)
class Traits:
    """What the rules look at."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int  # with a word
    n_dup_lines: int
    n_repeat_words: int
    n_distinct: int
    n_stutter: int  # words equal to the one before
    n_closing: int  # words that end in a symbol
    n_shouts: int  # exclamation marks
    n_lettered: int  # words with a letter, any byte beyond ASCII included
    n_upper: int  # of ASCII letters
    n_letters: int


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more. Hashes find candidates, the words decide."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(count, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + count]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    windows = {i: tuple(words[i : i + width]) for i in at} if len(at) * width <= 4 * len(words) else _numbered(words, at, width)
    seen = Counter(windows.values())
    covered = np.zeros(len(words) + 1, np.int64)
    begins = np.array([i for i, window in windows.items() if seen[window] > 1], np.int64)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def _numbered(words: list[bytes], at: list[int], width: int) -> dict[int, bytes]:
    """Windows as packed word numbers, smaller than tuples of words where most of a long text repeats."""
    number: dict[bytes, int] = {}
    packed = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)).tobytes()
    return {i: packed[4 * i : 4 * (i + width)] for i in at}


def traits(text: bytes) -> Traits:
    words = text.split()  # bytes split at ASCII white space only
    lines = [line for line in text.split(b"\n") if line.strip()]
    kept = text.translate(None, SPACES + _CONTINUED)
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lower, upper = (len(text) - len(text.translate(None, letters)) for letters in (_LOWER, _UPPER))
    return Traits(
        n_words=len(words),
        word_chars=len(kept),
        n_symbols=n_symbols,
        n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_distinct=len(set(words)),
        n_stutter=sum(map(eq, words, words[1:])),
        n_closing=len(_CLOSING.findall(text)) if n_symbols else 0,
        n_shouts=text.count(b"!"),
        n_lettered=len(text.translate(None, _NO_LETTER).split()),
        n_upper=upper,
        n_letters=upper + lower,
    )


ABSTAIN, BAD, GOOD = 0, 1, 2


def _upto(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad beyond the other."""
    return GOOD if value <= good else BAD if value > bad else ABSTAIN


def _variety(t: Traits) -> int:
    """Distinct words grow with a power of the text's words; a low power means that few words fill it."""
    if t.n_words < MIN_WORDS:
        return ABSTAIN
    return _upto(-log(t.n_distinct) / log(t.n_words), -0.85, -0.75)


def _word_length(t: Traits) -> int:
    if not t.n_words:
        return BAD
    mean = t.word_chars / t.n_words
    return BAD if not 3 <= mean <= 10 else GOOD if 3.5 <= mean <= 9 else ABSTAIN


# The ways in which a text can be bad, each with the rules that speak of it; all take a text's traits and vote.
KINDS: dict[str, dict[str, Callable[[Traits], int]]] = {
    "fragment": {
        "length": lambda t: BAD if t.n_words < MIN_WORDS else GOOD if t.n_words >= 50 else ABSTAIN,
        "word length": _word_length,
    },
    "symbols": {
        "symbols": lambda t: _upto(t.n_symbols / max(1, t.n_words), 0.02, 0.1),
        "words that end in symbols": lambda t: _upto(t.n_closing / max(1, t.n_words), 0.02, 0.1),
        "words without letters": lambda t: _upto(1 - t.n_lettered / max(1, t.n_words), 0.1, 0.2),
    },
    "shouting": {
        "exclamation marks": lambda t: _upto(t.n_shouts / max(1, t.n_words), 0.02, 0.1),
        "capitals": lambda t: _upto(t.n_upper / t.n_letters, 0.15, 0.4) if t.n_letters else ABSTAIN,
    },
    "repetition": {
        "repeated windows": lambda t: _upto(t.n_repeat_words / max(1, t.n_words), 0.1, 0.3),
        "repeated lines": lambda t: _upto(t.n_dup_lines / t.n_lines, 0.1, 0.3) if t.n_lines > 2 else ABSTAIN,
    },
    "stutter": {
        "stutter": lambda t: _upto(t.n_stutter / max(1, t.n_words), 0.05, 0.15),
        "variety": _variety,
    },
}
RULES = {name: rule for rules in KINDS.values() for name, rule in rules.items()}
# which rules speak of each kind: one row per kind, one column per rule
SPEAKS = np.array([[name in rules for name in RULES] for rules in KINDS.values()])


def pattern(t: Traits) -> int:
    """The votes of all rules as one number, a digit to base 3 each."""
    code = 0
    for rule in RULES.values():
        code = code * 3 + rule(t)
    return code


def votes(patterns: np.ndarray) -> np.ndarray:
    """One row per pattern, one column per rule."""
    powers = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return patterns[:, None] // powers % 3


@dataclass(frozen=True)
class Settings:
    threshold: float = 1 / 3  # of the posterior probability of a good text: it goes where bad is more than twice as likely
    rounds: int = 500
    tolerance: float = 1e-10  # change of the share of good texts at which rounds end
    # what is believed before any vote is seen, and its weight as a share of all texts
    prior_good: float = 0.8
    right_on_good: float = 0.95
    right_on_own_kind: float = 0.9
    bad_on_other_kind: float = 0.1
    prior_weight: float = 0.01
    least_right: float = 0.6  # of a rule on good texts and on its own kind, or classes could change places


@dataclass(frozen=True)
class Model:
    """Shares of good texts and of each kind of bad ones, and the chance of a bad vote per class and rule, where it votes."""

    shares: np.ndarray
    says_bad: np.ndarray

    @property
    def right_on_good(self) -> dict[str, float]:
        return dict(zip(RULES, (1 - self.says_bad[0]).tolist()))

    @property
    def right_on_bad(self) -> dict[str, float]:
        """Per rule, how often it is right on the kind of bad text that it speaks of."""
        return dict(zip(RULES, np.where(SPEAKS, self.says_bad[1:], 0).max(0).tolist()))

    def classes(self, cast: np.ndarray) -> np.ndarray:
        """Probability of each class for rows of votes, the good one first; abstentions say nothing."""
        logs = np.log(self.shares) + (cast == BAD) @ np.log(self.says_bad).T + (cast == GOOD) @ np.log1p(-self.says_bad).T
        odds = np.exp(logs - logs.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of a good text."""
        return self.classes(cast)[:, 0]


def estimate(patterns: np.ndarray, counts: np.ndarray, settings: Settings = Settings()) -> Model:
    """Expectation-maximisation over vote patterns with their counts.

    The prior counts as ``prior_weight`` of all texts, so shares decide and
    not the size of the table. Without any text the prior is the model.
    """
    kinds = len(KINDS)
    bad = (1 - settings.prior_good) / kinds
    prior_shares = np.array([settings.prior_good, *[bad] * kinds])
    prior_bad = np.vstack([np.full(len(RULES), 1 - settings.right_on_good), np.where(SPEAKS, settings.right_on_own_kind, settings.bad_on_other_kind)])
    least = np.vstack([np.full(len(RULES), 1e-6), np.where(SPEAKS, settings.least_right, 1e-6)])
    most = np.vstack([np.full(len(RULES), 1 - settings.least_right), np.full((kinds, len(RULES)), 1 - 1e-6)])
    model = Model(prior_shares, prior_bad)
    if not len(patterns):
        return model
    cast, share = votes(patterns), counts / counts.sum()
    voted, prior = cast != ABSTAIN, settings.prior_weight * prior_shares
    for _ in range(settings.rounds):
        mass = model.classes(cast) * share[:, None]
        says_bad = (mass.T @ (cast == BAD) + prior[:, None] * prior_bad) / (mass.T @ voted + prior[:, None])
        moved = Model((mass.sum(0) + prior) / (1 + settings.prior_weight), says_bad.clip(least, most))
        ended = abs(moved.shares - model.shares).max() < settings.tolerance
        model = moved
        if ended:
            break
    return model


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes) of every row; a null text has no words."""

    def start():
        def one(doc_id, text):
            t = traits(bytes(text) if text else b"")
            return doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, pattern(t)

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, votes bigint"
    return row_map(docs.select("doc_id", F.col("text").cast("binary").alias("text")), start, schema)


def fit(rows: DataFrame, settings: Settings = Settings()) -> tuple[Model, dict[int, float]]:
    """The model of all rows of ``measured``, and the posterior of each vote pattern (at most 3 ** rules of them)."""
    found = sorted(map(tuple, rows.groupBy("votes").count().collect()))
    patterns, counts = np.array(found, np.int64).reshape(-1, 2).T
    model = estimate(patterns, counts, settings)
    return model, dict(zip(patterns.tolist(), model.posterior(votes(patterns)).tolist()))


def judged(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: base counts, ``base_failed``, ``kept`` and the posterior.

    Null and empty texts have no words and fail the base rules. Rows that repeat an id or a text
    are judged each for itself and count each in the model. An empty table gives none. Columns other than
    ``doc_id`` and ``text`` are ignored. Texts are read once; no exchange carries them.
    """
    rows = staged(measured(docs), "rules")
    _, posterior = fit(rows, settings)
    spark = docs.sparkSession
    table = spark.createDataFrame(list(posterior.items()), "votes bigint, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # at most 3 ** rules rows of two numbers
    return rows.join(F.broadcast(table), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= settings.threshold)).alias("kept"),
        "posterior",
    )
