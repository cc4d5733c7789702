"""Longest matches beyond the words that are compared at once, and windows derived from them."""

import random

from test_decontaminate import brute

from barcast.llm import decontaminate as D


def longest(words, docs):
    best = 0
    for text in docs:
        other = D.words_of(text)
        for p in range(len(other)):
            n = 0
            while n < len(words) and p + n < len(other) and words[n] == other[p + n]:
                n += 1
            best = max(best, n)
    return best


def test_copies_that_share_many_words(spark):
    rng = random.Random(8)
    item = [rng.choice("abcdefgh") * 2 for _ in range(90)]
    docs = [" ".join([*item[a:b], "other", end]) for a, b, end in ((0, 17, "x"), (0, 20, "y"), (0, 90, "z"), (0, 40, "aa bb"), (0, 55, "x"), (5, 60, "hh"), (0, 33, "x"), (0, 32, "x"), (0, 48, "x"), (0, 16, "x"))]
    docs += ["aa " * 200, " ".join(item[:31] + ["aa"] * 50)]
    bench = [(1, " ".join(item)), (2, "aa " * 70), (3, " ".join(item[:50] + ["hh"] * 30)), (4, "solo")]
    for order in range(4):
        rows = list(enumerate(docs))
        rng.shuffle(rows)
        test = D.test_side([(str(i), t) for i, t in bench])
        shard = D.Shard([[test.vocabulary.get(w, 0) for w in D.words_of(t)] for _, t in rows], test)
        got = {(i, o): n for i, o, n, _, _ in shard.longest()}
        for at, (_, text) in enumerate(bench):
            words = D.words_of(text)
            for o in range(len(words)):
                want = longest(words[o:], docs)
                assert got.get((at, o), 0) == (want if want > 1 else 0)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(str(tuple(r)) for r in D.contamination(frame, items).collect()) == sorted(map(str, brute(list(enumerate(docs)), bench)))


def test_verdicts_come_from_the_longest_matches(monkeypatch):
    test = D.test_side([("1", " ".join(f"w{i}" for i in range(30)))])
    shard = D.Shard([[test.vocabulary.get(f"w{i}".encode(), 0) for i in range(30)]], test)
    assert shard.verdicts()[0].tolist() == [30]
    suffixes, length, where = shard.matches()
    monkeypatch.setattr(shard, "matches", lambda: (suffixes, length * 0, where))
    assert shard.verdicts()[0].tolist() == [0]
