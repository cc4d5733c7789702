"""Subword lattice likelihood: all segmentations of a word into vocabulary pieces, summed in log space.

The pieces and their scores come from an existing vocabulary. Its scores are
ranks, so a piece starts with a weight of one over its rank; a few rounds of
expectation over the distinct words of the training texts adapt the
weights. A word is a first piece, further pieces and a stop, so that all words
together have probability one. In the lattice of a training word there is one
more arc, the word as a whole, weighted by its discounted count; the mass of
the discounts goes to the pieces. The discount is estimated from how many
words occur once and twice. The rounds run over distinct words, not over
tokens, since the pieces stand for the words that have no count. A text is the product over its words and its
end. Probabilities of all words sum to one, whereas the base score gives every
unseen word the same half count, so on texts with many unseen words the base
is the larger number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from math import exp, inf, log, log1p, log10

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import held_out, map_lists
from barcast.session import staged

DISCOUNT = 0.75  # where no word occurs once, or none twice
ROUNDS = 3  # of expectation; the fourth and fifth gained 0.1 % and less on held-out texts
FREQUENT = 3e-6  # words of at least this share of all tokens, at most 1 / FREQUENT of them, are sent to all tasks
FLUSH = 300_000  # distinct words a task counts before it writes them
_LAST = (1 << 63) - 1  # stands for a null id
_MARK = "▁"  # begins the first piece of a word
_STOP = ""


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, after lower-casing A-Z."""
    return (text or "").encode().lower().split()


@lru_cache(maxsize=1)
def piece_ranks(path: str) -> dict[str, int]:
    """Piece → rank by falling score; byte pieces stand for characters without a piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    order = sorted(ids, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): rank for rank, i in enumerate(order, 1)}


@dataclass(frozen=True)
class Pieces:
    """Log weights of first pieces (with the mark, or the mark alone), of further pieces and of the stop."""

    first: dict[str, float]
    further: dict[str, float]
    slots: dict[tuple[bool, str], int]  # number of each (is first, piece)
    first_trie: dict  # by character; the piece's number, alone in a tuple, and its weight under the empty string
    further_trie: dict

    @staticmethod
    def of(counts: dict[tuple[bool, str], float]) -> "Pieces":
        """Normalised log weights of (is first, piece) counts."""
        parts: tuple[dict[str, float], dict[str, float]] = ({}, {})
        for is_first in (False, True):
            own = {p: c for (f, p), c in counts.items() if f == is_first}
            total = log(sum(own.values()))
            parts[is_first].update({p: log(c) - total for p, c in own.items()})
        slots = {key: slot for slot, key in enumerate(counts)}
        return Pieces(parts[1], parts[0], slots, *(_trie({p: (slots[f, p], w) for p, w in parts[f].items()}) for f in (True, False)))


def _trie(pieces: dict[str, tuple[int, float]]) -> dict:
    root: dict = {}
    for piece, (slot, weight) in pieces.items():
        node = root
        for char in piece:
            node = node.setdefault(char, {})
        if piece:
            node[_STOP] = ((slot,), weight)
    return root


def prior(ranks: dict[str, int]) -> dict[tuple[bool, str], float]:
    """Weights by rank; all 256 byte pieces are there, so every word has a segmentation."""
    counts = {(p.startswith(_MARK), p): 1 / r for p, r in ranks.items()}
    for byte in range(256):
        counts.setdefault((False, f"<0x{byte:02X}>"), 1 / len(ranks))
    counts.setdefault((True, _MARK), 1 / len(ranks))
    counts[(False, _STOP)] = 1.0
    return counts


def log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + log(sum([exp(t - top) for t in terms]))


def log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + log1p(exp(b - a))


class Lattice:
    """The forward recursion over words given one after the other; what a word shares with the one before is kept.

    In sorted words, each prefix is thus worked on once. With ``into``, a number
    per piece, the expected counts of all words' pieces are added to it, a position at a time as it is
    left: the words that end behind a position share the arcs into it. The
    mark alone is always an arc and so are the bytes of any character, so each
    end is reached.
    """

    def __init__(self, pieces: Pieces, into: list[float] | None = None) -> None:
        self.pieces, self.into = pieces, into
        self.word = ""
        self.reached = [0.0]  # log probability of reaching each position
        self.behind = [-inf]  # log of the summed shares of the words' probabilities behind each position
        self.open: list[list[tuple[int, dict]]] = []  # pieces begun: (begin, trie node) after each character
        self.arcs: list[list[tuple[int, tuple[int, ...], float]]] = []  # (begin, numbers of pieces, log weight) into each position

    def total(self, word: str) -> float:
        """Log of the summed probability of all segmentations of the marked word."""
        marked, shared = _MARK + word, 0
        for old, new in zip(self.word, marked):
            if old != new:
                break
            shared += 1
        self._leave(shared)
        for at in range(shared, len(marked)):
            self._extend(at, marked[at])
        self.word = marked
        return self.reached[-1]

    def learn(self, word: str) -> None:
        """Like ``total``, and counts the word's expected pieces."""
        total = self.total(word)
        before = self.behind[-1]
        self.behind[-1] = -total if before == -inf else log_add(before, -total)
        self.into[self.pieces.slots[False, _STOP]] += 1.0

    def close(self) -> None:
        self._leave(0)
        self.word = ""

    def _extend(self, at: int, char: str) -> None:
        live, arcs, terms = [], [], []
        begun = self.pieces.further_trie if at else self.pieces.first_trie
        for begin, node in [*self.open[-1], (at, begun)] if at else [(at, begun)]:
            node = node.get(char)
            if node is not None:
                live.append((begin, node))
                found = node.get(_STOP)
                if found is not None:
                    arcs.append((begin, *found))
                    terms.append(self.reached[begin] + found[1])
        if at and not (arcs and arcs[-1][0] == at):  # its bytes, as one arc
            names = [f"<0x{b:02X}>" for b in char.encode("utf-8", "replace")]
            weight = sum(self.pieces.further[n] for n in names)
            arcs.append((at, tuple(self.pieces.slots[False, n] for n in names), weight))
            terms.append(self.reached[at] + weight)
        self.open.append(live)
        self.reached.append(log_sum(terms))
        if self.into is not None:
            self.arcs.append(arcs)
            self.behind.append(-inf)

    def _leave(self, size: int) -> None:
        """Gives up all positions beyond ``size``."""
        into, reached = self.into, self.reached
        if into is not None:
            while len(self.arcs) > size:
                rest = self.behind.pop()
                for begin, slots, weight in self.arcs.pop():
                    step = weight + rest
                    if begin:
                        before = self.behind[begin]
                        self.behind[begin] = step if before == -inf else log_add(before, step)
                    share = exp(reached[begin] + step)
                    for slot in slots:
                        into[slot] += share
        del reached[size + 1 :], self.open[size:]


def word_log(word: bytes, pieces: Pieces, lattice: Lattice | None = None) -> float:
    """Natural log of the marginal probability of a word over all its segmentations."""
    return (lattice or Lattice(pieces)).total(word.decode("utf-8", "replace")) + pieces.further[_STOP]


def expected(words: Iterable[bytes], pieces: Pieces, into: dict[tuple[bool, str], float]) -> None:
    """Adds the expected pieces of words (forward-backward); quickest where the words are sorted."""
    shares = [0.0] * len(pieces.slots)
    lattice = Lattice(pieces, shares)
    for word in words:
        lattice.learn(word.decode("utf-8", "replace"))
    lattice.close()
    for key, slot in pieces.slots.items():
        if shares[slot]:
            into[key] = into.get(key, 0.0) + shares[slot]


def word_counts(docs: DataFrame, training: str = "training") -> DataFrame:
    """(word, c): every distinct word of ``docs`` with its count in the rows marked ``training``."""

    def work(batches):
        counts: Counter = Counter()
        for texts, marks in batches:
            for text, mark in zip(texts, marks):
                words = words_of(text)
                counts.update(words if mark else dict.fromkeys(words, 0))
                if len(counts) >= FLUSH:
                    yield [list(counts), list(counts.values())]
                    counts = Counter()
        yield [list(counts), list(counts.values())]

    return map_lists(docs.select("text", training), work, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def adapted(table: DataFrame, path: str, rounds: int = ROUNDS) -> Pieces:
    """Weights after ``rounds`` of expectation over the distinct training words, smoothed by the vocabulary's own; quickest where ``table`` is sorted."""
    begin = prior(piece_ranks(path))
    words = table.where("c > 0").select("word")
    pieces = Pieces.of(begin)
    for _ in range(rounds):
        sent = table.sparkSession.sparkContext.broadcast(pieces)  # one number per vocabulary piece

        def work(batches, sent=sent):
            counts: dict[tuple[bool, str], float] = {}
            expected((word for (words,) in batches for word in words), sent.value, counts)
            yield [[f for f, _ in counts], [p for _, p in counts], list(counts.values())]

        shares = map_lists(words, work, "first boolean, piece string, n double").groupBy("first", "piece").agg(F.sum("n").alias("n"))
        # at most two numbers per vocabulary piece
        counts = {(r["first"], r["piece"]): r["n"] for r in shares.collect()}
        pieces = Pieces.of({k: counts.get(k, 0.0) + w for k, w in begin.items()})
        sent.unpersist()
    return pieces


def discount(once: int, twice: int) -> float:
    """What each count gives up for words not seen, from the numbers of words that occur once and twice."""
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def scored(docs: DataFrame, path: str, divisor: int = 5, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Learns from the rows that are not held out; null and empty texts consist
    of their end alone. Without any training row the counts are zero and all
    mass is with the pieces (the end keeps the smoothing of the base). Repeated rows
    count and stay as they are; a null id is never held out; other columns are ignored.
    """
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("at"),
        F.xxhash64("text").alias("text_hash"),
        "text",
        (~held_out("doc_id", divisor, remainder)).alias("training"),
    )
    # by ranges and in order, so that words next to each other share their prefixes in all passes
    table = staged(word_counts(keyed).repartitionByRange("word").sortWithinPartitions("word"), "words")
    ends = keyed.where("training").count()
    sums = table.agg(
        F.sum("c").alias("n"), *[F.count_if(condition).alias(name) for name, condition in (("v", F.col("c") > 0), ("once", F.col("c") == 1), ("twice", F.col("c") == 2))]
    ).first()
    total, known = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    pieces = table.sparkSession.sparkContext.broadcast(adapted(table, path))
    below = total + 0.5 * (known + 1)
    less = discount(sums["once"], sums["twice"])
    mass = (less * sums["v"] / total) if sums["v"] else 1.0

    def each(batches):
        shared = Lattice(pieces.value)
        for words, counts in batches:
            base = [log10((c + 0.5) / below) for c in counts]
            score = []
            for word, c in zip(words, counts):
                lattice = word_log(word, pieces.value, shared) + log(mass)
                score.append((log_sum([lattice, log((c - less) / total)]) if c else lattice) / log(10))
            yield [words, [int(c > 0) for c in counts], base, score]

    by_word = staged(map_lists(table, each, "word binary, known int, base double, score double"), "words")
    frequent = table.where(F.col("c") >= FREQUENT * total).select("word")  # at most 1 / FREQUENT words
    rows = by_word.join(frequent, "word").collect()
    common = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): (r["known"], r["base"], r["score"]) for r in rows})
    end_base = log10((ends + 0.5) / below)
    end_score = log10(ends / total) if ends else end_base

    def parts(batches):
        """One row per rare word of a text, and one for all the rest of it; its key is no word, as words hold no space."""
        known_words = common.value
        for ats, hashes, texts in batches:
            keys, words, numbers, here = [], [], [], []
            for row, text in enumerate(texts):
                counts = Counter(words_of(text))
                known, base, score, rare = int(ends > 0), end_base, end_score, len(words)
                for word, n in counts.items():
                    found = known_words.get(word)
                    if found is None:
                        words.append(word)
                        numbers.append(n)
                    else:
                        known += n * found[0]
                        base += n * found[1]
                        score += n * found[2]
                keys += [row] * (len(words) - rare)
                here.append((counts.total() + 1, known, base, score))
                if len(words) >= 200_000 or row == len(texts) - 1:
                    done = range(row + 1 - len(here), row + 1)
                    yield [[ats[r] for r in done], [hashes[r] for r in done], [b" %d %d" % (ats[r], hashes[r]) for r in done], [None] * len(here), [dict(zip(names[1:], h)) for h in here]]
                    yield [[ats[r] for r in keys], [hashes[r] for r in keys], words, numbers, [None] * len(words)]
                    keys, words, numbers, here = [], [], [], []

    names = ["rows", "n_tokens", "n_known", "base_score", "score"]
    here = "here struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>"
    dealt = map_lists(keyed.select("at", "text_hash", "text"), parts, f"at bigint, text_hash bigint, word binary, n bigint, {here}").join(by_word.withColumnRenamed("score", "word_score"), "word", "left")
    rest, no = F.col("here").isNotNull(), F.lit(0).cast("bigint")
    whole = dealt.groupBy("at", "text_hash").agg(
        F.sum(rest.cast("bigint")).alias("rows"),
        F.sum(F.when(rest, F.col("here.n_tokens")).otherwise(no)).alias("n_tokens"),
        F.sum(F.when(rest, F.col("here.n_known")).otherwise(F.col("n") * F.col("known"))).alias("n_known"),
        F.sum(F.when(rest, F.col("here.base_score")).otherwise(F.col("n") * F.col("base"))).alias("base_score"),
        F.sum(F.when(rest, F.col("here.score")).otherwise(F.col("n") * F.col("word_score"))).alias("score"),
    )
    # rows that repeat both id and text were summed together
    doc_id = F.when(F.col("at") < _LAST, F.col("at"))
    one = [(F.col(c) / F.col("rows")) for c in names[1:]]
    return whole.select(
        doc_id.alias("doc_id"),
        *[c.cast("bigint" if n.startswith("n_") else "double").alias(n) for c, n in zip(one, names[1:])],
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("_copy"),
    ).select("doc_id", held_out("doc_id", divisor, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score")
