"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from barcast.llm import spelling

FOLD = {65 + i: 97 + i for i in range(26)}


def brute(rows, min_chars=7, min_count=2, ratio=10):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                found[run] += 1
    words = {w: n for w, n in found.items() if n >= min_count}

    def around(w):
        letters = sorted({c for x in words for c in x})
        made = {w[:i] + w[i + 1 :] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return [x for x in made if x != w and x in words]

    form, near = {}, {}
    for w, n in words.items():
        near[w] = around(w)
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(repr((w, form[w], root(w), n, len(near[w]), words.get(form[w]))) for w, n in words.items())


def fixture():
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdeéÿ×", k=rng.randint(6, 12))) for _ in range(60)] + ["a" * 9, "a" * 8, "abababab", "babababa"]
    heavy = [w for w in base for _ in range(rng.choice([1, 1, 3, 30, 400]))]

    def typo(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        c = rng.choice("abcdeéÿxyz")
        return (w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w)[kind]

    rows = []
    for i in range(300):
        words = [rng.choice(heavy) for _ in range(30)]
        words = [typo(w) if rng.random() < 0.3 else w for w in words]
        words = [typo(w) if rng.random() < 0.1 else w for w in words]
        rows.append((i, rng.choice([" ", "-", "\n", "日"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    rows += [(301, None), (302, ""), (None, rows[0][1]), (None, rows[0][1]), (5, rows[5][1]), (303, "y" * 400), (304, "y" * 400 + " " + "y" * 401 + " " + "y" * 401)]
    rows += [(305, "chainedword " * 2000 + "chainedwort " * 100 + "chaineswort " * 5)]
    return rows


@pytest.mark.parametrize("settings", [spelling.Settings(), spelling.Settings(branch=3), spelling.Settings(groups=5, top=2, branch=10)])
def test_against_brute_force(spark, settings):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.variants(docs, settings)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(repr(tuple(r)) for r in got.collect())
    assert got == brute(rows)
    assert sum("None" not in r for r in got) > 30


def test_root_follows_the_chain(spark):
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(fixture(), "doc_id long, text string")).collect()}
    assert got["chainesworT".lower()].root == "chainedword" and got["chainesworT".lower()].form == "chainedwort"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(docs.limit(0)).count() == 0


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "ab") and spelling.one_edit("bc", "abc")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "a")
