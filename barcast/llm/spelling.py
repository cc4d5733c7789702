"""Spelling variant grouping: a trie of letter-group counts, searched with a surplus and a deficit of one each.

Letters fall into ``groups`` groups. A word is the vector of its counts, and
the vectors form a trie, one group a level. One replaced letter moves at most one count
up and one down, one inserted or deleted letter moves one count. So the search for the near words of
a word goes down the trie and may take, once each, a child with one letter more
and a child with one letter less; words at the leaves it reaches are verified.

Spark deals the trie out by its first ``top`` levels, together with the begin or the end of the
word (one of the two is untouched by any one edit). A word goes to the branch of its
own counts and, once per group, to the branch with one letter less there: two
words whose counts differ in the first levels meet where each has spent its
surplus. Each task builds and searches the lower levels of one branch after
the other. Branches of more than ``branch`` entries are dealt out by all levels instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import ne

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import Lists, map_lists
from barcast.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
WHOLE = -1  # an entry that has spent nothing
OUT_ROWS = 10_000  # rows per batch sent back


@dataclass(frozen=True)
class Settings:
    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10  # a form occurs at least this many times as often
    drop_of: int = 31  # a run loses a letter where this divides its hash
    groups: int = 12
    top: int = 4
    branch: int = 20_000


def vocabulary(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n): the distinct words of all texts that are long and frequent enough.

    Runs of letters are matched whole: a match of at least ``min_chars`` letters
    is greedy, so it is a maximal run. A null text has no runs, and a null id is hashed as the empty id.
    """
    pattern = f"{LETTERS}{{{settings.min_chars},}}"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % settings.drop_of == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= settings.min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= settings.min_count)


def one_edit(a: str, b: str) -> bool:
    """True if the words differ by exactly one inserted, deleted or replaced code point."""
    more = len(b) - len(a)
    if not more:
        return sum(map(ne, a, b)) == 1
    if more < 0:
        a, b = b, a
    if abs(more) > 1:
        return False
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[i:] == b[i + 1 :]
    return True


def counts(word: str, groups: int) -> list[int]:
    """Letters of the word in each group."""
    found = [0] * groups
    for letter in word:
        found[ord(letter) % groups] += 1
    return found


def places(word: str, settings: Settings) -> Iterator[tuple[str, int]]:
    """(key, spent) of the branches a word goes to; ``spent`` is the group that gave up a letter."""
    begin = settings.min_chars // 2
    ends = (f"<{word[:begin]}", f">{word[begin - settings.min_chars :]}")
    vector = counts(word, settings.groups)[: settings.top]
    for spent in (WHOLE, *range(settings.top)):
        if spent == WHOLE or vector[spent]:
            own = ",".join([str(c - (g == spent)) for g, c in enumerate(vector)])
            for end in ends:
                yield f"{end}{own}", spent


def lower_places(key: str, word: str, spent: int, settings: Settings) -> Iterator[tuple[str, int]]:
    """The same for the levels below, within one branch; a surplus is spent once only."""
    vector = counts(word, settings.groups)
    for lower in (spent, *(range(settings.top, settings.groups) if spent == WHOLE else ())):
        if lower == spent or vector[lower]:
            yield f"{key}/" + ",".join([str(c - (g == lower)) for g, c in enumerate(vector) if g >= settings.top]), lower


class Branch:
    """The lower levels of the trie for the entries of one branch."""

    def __init__(self, levels: range, groups: int) -> None:
        self.levels, self.groups = levels, groups
        self.root: dict = {}

    def entered(self, word: str) -> tuple[list[int], list]:
        """The word's counts on these levels, and the list of entries at its leaf."""
        whole = counts(word, self.groups)
        vector = [whole[g] for g in self.levels]
        node = self.root
        for c in vector[:-1]:
            node = node.setdefault(c, {})
        return vector, node.setdefault(vector[-1] if vector else 0, [])

    def reached(self, vector: list[int], surplus: int, deficit: int) -> Iterator[tuple[list, int]]:
        """Leaves within the budget, with the surplus that was spent on the way."""
        depth = max(1, len(vector))
        stack = [(self.root, 0, surplus, deficit)]
        while stack:
            node, level, more, less = stack.pop()
            if level == depth:
                yield node, surplus - more
                continue
            c = vector[level] if vector else 0
            below = node.get(c)
            if below is not None:
                stack.append((below, level + 1, more, less))
            if more:
                below = node.get(c + 1)
                if below is not None:
                    stack.append((below, level + 1, 0, less))
            if less:
                below = node.get(c - 1)
                if below is not None:
                    stack.append((below, level + 1, more, 0))


def near_in_branch(key: str, entries: list[tuple[str, int, int]], settings: Settings) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best of them, that word) for the (word, n, spent) of one branch.

    Every pair of near words is counted in just one branch: at the end of the
    word only if the begins differ, and where both spent a letter only if
    it was of different groups. Each entry searches those before it.
    """
    at_end, begin = key[0] == ">", settings.min_chars // 2
    branch = Branch(range(settings.groups if "/" in key else settings.top, settings.groups), settings.groups)
    near, best = [0] * len(entries), [(0, "")] * len(entries)
    for i, (word, n, spent) in enumerate(entries):
        vector, mine = branch.entered(word)
        # one that has spent its surplus meets those with one letter more below, or equal ones
        for leaf, used in branch.reached(vector, 1, int(spent == WHOLE)):
            for j in leaf:
                other, other_n, other_spent = entries[j]
                if spent == WHOLE:
                    if other_spent != WHOLE and used:
                        continue
                elif other_spent != WHOLE and (used or other_spent == spent):
                    continue
                if (at_end and word[:begin] == other[:begin]) or not one_edit(word, other):
                    continue
                near[i] += 1
                near[j] += 1
                best[i] = min(best[i], (-other_n, other))
                best[j] = min(best[j], (-n, word))
        mine.append(i)
    for i, (word, _, _) in enumerate(entries):
        if near[i]:
            yield word, near[i], -best[i][0], best[i][1]


def _placed(words: DataFrame, settings: Settings) -> DataFrame:
    def work(batches: Iterator[Lists]) -> Iterable[Lists]:
        for rows in batches:
            made = [(key, word, n, spent) for word, n in zip(*rows) for key, spent in places(word, settings)]
            yield list(zip(*made)) or [[]] * 4

    return map_lists(words.select("word", "n"), work, "key string, word string, n bigint, spent int")


def _lowered(entries: DataFrame, settings: Settings) -> DataFrame:
    def work(batches: Iterator[Lists]) -> Iterable[Lists]:
        for rows in batches:
            made = [(low, word, n, lower) for key, word, n, spent in zip(*rows) for low, lower in lower_places(key, word, spent, settings)]
            yield list(zip(*made)) or [[]] * 4

    return map_lists(entries.select("key", "word", "n", "spent"), work, "key string, word string, n bigint, spent int")


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has a near word."""
    placed = _placed(words, settings)
    large = placed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > settings.branch).select("key", F.lit(True).alias("large"))
    marked = placed.join(large, "key", "left")
    usual = marked.where("large is null").drop("large")
    entries = usual.unionByName(_lowered(marked.where("large"), settings))

    def work(batches: Iterator[Lists]) -> Iterable[Lists]:
        rows = (row for columns in batches for row in zip(*columns))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            branch = [r[1:] for r in group]
            if len(branch) > 1:
                out += near_in_branch(key, branch, settings)
            if len(out) >= OUT_ROWS:
                yield list(zip(*out))
                out = []
        if out:
            yield list(zip(*out))

    dealt = entries.repartition("key").sortWithinPartitions("key", "word")
    found = map_lists(dealt, work, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each pass doubles the steps taken, and counts rise along a chain, so few are needed."""
    links = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not links.where("moved").isEmpty():
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = links.join(ahead, "root", "left")
        links = staged(moved.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
    return links.select("word", "root")


def variants(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of all texts with the more frequent word it is a variant of.

    Null and empty texts have no words, an empty table gives none. Repeated rows
    count as often as they occur. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    words = staged(vocabulary(docs, settings), "words")
    near = words.join(near_words(words, settings), "word", "left")
    has_form: Column = F.col("best_n") >= settings.ratio * F.col("n")
    judged = staged(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = _followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
