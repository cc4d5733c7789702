"""Quality rules: base counts and verdicts against plain versions, and labels that the rules never see."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barcast.llm import rules

SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def plain_posterior(cast, settings):
    """Expectation-maximisation text by text with plain loops and products."""
    kinds, names = list(rules.KINDS.values()), list(rules.RULES)
    own = [[n in k for n in names] for k in kinds]
    start = [[1 - settings.right_on_good] * len(names)] + [[settings.right_on_own_kind if o else settings.bad_on_other_kind for o in row] for row in own]
    prior = [settings.prior_good] + [(1 - settings.prior_good) / len(kinds)] * len(kinds)
    shares, says = prior[:], [row[:] for row in start]

    def classes(row):
        odds = [s * math.prod(b if v == rules.BAD else 1 - b for v, b in zip(row, bad) if v != rules.ABSTAIN) for s, bad in zip(shares, says)]
        return [o / sum(odds) for o in odds]

    w = settings.prior_weight
    for _ in range(settings.rounds):
        mass = [classes(row) for row in cast]
        for c in range(len(shares)):
            for r in range(len(names)):
                bad = sum(m[c] for m, row in zip(mass, cast) if row[r] == rules.BAD) / len(cast)
                voted = sum(m[c] for m, row in zip(mass, cast) if row[r] != rules.ABSTAIN) / len(cast)
                value = (bad + w * prior[c] * start[c][r]) / (voted + w * prior[c])
                low, high = (1e-6, 1 - settings.least_right) if c == 0 else (settings.least_right if own[c - 1][r] else 1e-6, 1 - 1e-6)
                says[c][r] = min(max(value, low), high)
        shares = [(sum(m[c] for m in mass) / len(cast) + w * prior[c]) / (1 + w) for c in range(len(shares))]
    return [classes(row)[0] for row in cast]


def fixture():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnü", k=rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(w + rng.choice(["", "", "", ".\n", ","]) for w in rng.choices(vocabulary, k=n))

    rows = [prose(rng.randint(15, 120)) for _ in range(120)]
    rows += [re.sub(r"(\w) ", r"\1*** ", prose(80)) for _ in range(12)]
    rows += [prose(60).upper().replace(" ", "!! ") for _ in range(8)]
    rows += ["\n".join([prose(12)] * 9) for _ in range(8)]
    rows += [" ".join(w for w in rng.choices(vocabulary, k=12) for _ in range(7)) for _ in range(8)]
    rows += [None, "", " \n ", "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g h a", "x" * 60, "ü\x1c\x85\xa0ü é", "| " * 40, "w " * 30_000, prose(20_000)]
    return [(i, t) for i, t in enumerate(rows)] + [(None, "null id"), (3, rows[3]), (3, rows[3]), (3, "other")]


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, votes int, posterior double").repartition(4)
    settings = rules.Settings(rounds=25, tolerance=0)
    got = rules.judged(docs, settings).collect()
    assert sorted(repr(tuple(r)[:7]) for r in got) == sorted(repr((i, *base(t))) for i, t in rows)
    cast = [rules.votes(np.array([rules.pattern(rules.traits((t or "").encode()))]))[0].tolist() for _, t in rows]
    posterior = plain_posterior(cast, settings)
    want = sorted((repr(i), base(t)[0], round(p, 9), not base(t)[5] and p >= settings.threshold) for (i, t), p in zip(rows, posterior))
    assert sorted((repr(r.doc_id), r.n_words, round(r.posterior, 9), r.kept) for r in got) == want
    assert {r.kept for r in got} == {True, False}


@pytest.mark.parametrize("width", [2, 8])
def test_repeated_words_both_ways(width):
    rng = random.Random(width)
    for alphabet in ("ab", "abcdefgh"):
        for n in (0, width - 1, width, width + 1, 40, 300):
            words = [rng.choice(alphabet).encode() for _ in range(n)]
            if n > 100:
                words[n - 60 :] = words[:60]
            windows = Counter(tuple(words[i : i + width]) for i in range(n - width + 1))
            covered = {i + k for i in range(n - width + 1) if windows[tuple(words[i : i + width])] > 1 for k in range(width)}
            assert rules.repeated_words(words, width) == len(covered)


def test_labels_not_seen(spark):
    """On the given tables nearly all labelled rows get the verdict of their label."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in rules.judged(docs).collect() if r.doc_id in known and not r.base_failed]
    assert len(got) > 60 and all(r.kept == bool(known[r.doc_id]) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert rules.judged(docs.limit(0)).count() == 0
    assert [r.kept for r in rules.judged(docs).collect()] == [False, False]


def test_shares_do_not_depend_on_size():
    patterns, counts = np.array([0, 5, 88_572, 177_146]), np.array([3, 5, 9, 400])
    one, ten = rules.estimate(patterns, counts), rules.estimate(patterns, counts * 10)
    assert np.allclose(one.shares, ten.shares) and np.allclose(one.says_bad, ten.says_bad)
