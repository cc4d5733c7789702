import zlib
from collections import Counter
from math import exp, isclose, log10

import public_tokenizers as P
import pytest

from barcast.llm import subwords

PATH = P.path("piece_bpe_32k.model")
PIECES = subwords.Pieces.of(subwords.prior(subwords.piece_ranks(PATH)))


def segmentations(text, first):
    """All cuts of a marked word into pieces, by plain recursion."""
    if not text:
        return [[]]
    out = []
    table = PIECES.first if first else PIECES.further
    for n in range(1, len(text) + 1):
        if text[:n] in table:
            out += [[table[text[:n]], *rest] for rest in segmentations(text[n:], False)]
    if not first and text[0] not in PIECES.further:
        own = sum(PIECES.further[f"<0x{b:02X}>"] for b in text[0].encode())
        out += [[own, *rest] for rest in segmentations(text[1:], False)]
    return out


@pytest.mark.parametrize("word", ["the", "therein", "é", "zß日", "a", "x" * 9])
def test_sum_over_all_segmentations(word):
    want = sum(exp(sum(s)) for s in segmentations("▁" + word, True)) * exp(PIECES.further[""])
    assert isclose(exp(subwords.word_log(word.encode(), PIECES)), want, rel_tol=1e-9)


def test_weights_sum_to_one_and_long_word():
    assert isclose(sum(map(exp, PIECES.first.values())), 1) and isclose(sum(map(exp, PIECES.further.values())), 1)
    assert subwords.word_log(b"ab" * 20_000, PIECES) < -1000
    counts = {}
    subwords.expected([b"therein"], PIECES, counts)
    assert isclose(sum(c for (first, _), c in counts.items() if first), 1, rel_tol=1e-9)


def test_shared_prefixes_change_nothing():
    words = [b"", b"a", b"the", b"the", b"then", b"therein", "thé".encode(), "日本".encode(), b"there", b"x\xff\x00y"]
    apart, together = {}, {}
    for word in words:
        subwords.expected([word], PIECES, apart)
    lattice = subwords.Lattice(PIECES)
    for order in (words, sorted(words)):
        together = {}
        subwords.expected(order, PIECES, together)
        assert apart.keys() == together.keys() and all(isclose(apart[k], together[k], rel_tol=1e-9, abs_tol=1e-12) for k in apart)
        assert [subwords.word_log(w, PIECES, lattice) for w in order] == [subwords.word_log(w, PIECES) for w in order]


def test_expected_pieces_by_plain_recursion():
    def cuts(text, first):
        if not text:
            return [[]]
        own = PIECES.first if first else PIECES.further
        return [[(first, text[:n]), *rest] for n in range(1, len(text) + 1) if text[:n] in own for rest in cuts(text[n:], False)]

    weight = lambda cut: exp(sum((PIECES.first if f else PIECES.further)[p] for f, p in cut))
    want = Counter()
    for word in ("then", "there", "thing"):
        found = cuts("▁" + word, True)
        whole = sum(map(weight, found))
        for cut in found:
            for key in cut:
                want[key] += weight(cut) / whole
    counts = {}
    subwords.expected([b"then", b"there", b"thing"], PIECES, counts)
    assert counts.pop((False, "")) == 3
    assert counts.keys() == want.keys() and all(isclose(counts[k], want[k], rel_tol=1e-9) for k in want)


def test_scores(spark):
    rows = [(i, f"The theme w{i} Then\tthe END x{i % 3}") for i in range(40)]
    rows += [(50, None), (51, ""), (None, "the é"), (52, " the"), (7, "again the"), (7, "again the"), (60, "the " * 3000)]
    docs = spark.createDataFrame([(*r, 3, "w") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = subwords.scored(docs, PATH).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    bag = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for i, t in rows if not held(i) for w in bag(t))
    ends = sum(not held(i) for i, _ in rows)
    total, v = counts.total() + ends, len(counts) + 1
    want = []
    for i, t in rows:
        base = sum(log10((counts[w] + 0.5) / (total + 0.5 * (v + 1))) for w in bag(t)) + log10((ends + 0.5) / (total + 0.5 * (v + 1)))
        want.append((i, held(i), len(bag(t)) + 1, sum(counts[w] > 0 for w in bag(t)) + 1, total, round(base, 6)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got)
    assert all(r.score < 0 for r in got)
    assert subwords.scored(docs.limit(0), PATH).count() == 0


def test_adapted_weights_fit_held_out_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("crc32(cast(doc_id AS string)) % 5 <> 1"), docs.where("crc32(cast(doc_id AS string)) % 5 = 1")
    table = subwords.word_counts(train.selectExpr("text", "true AS training"))
    pieces = subwords.adapted(table, PATH)
    unseen = {w for r in test.collect() for w in subwords.words_of(r.text)} - {bytes(r.word) for r in table.collect()}
    assert len(unseen) > 1000
    assert sum(subwords.word_log(w, pieces) for w in unseen) > sum(subwords.word_log(w, PIECES) for w in unseen) + len(unseen)


def test_score_of_the_whole_query(spark):
    """Scores by a plain loop: rounds of expectation word by word, discounts from counts of counts, sums per text."""
    rows = [(i, " ".join(["the", "then", f"word{i % 7}", f"pair{i // 2}", f"other{i}", "again"][: 2 + i % 5])) for i in range(60)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "unseen theorems \u65e5")], "doc_id long, text string").repartition(4)
    train = [(i, t) for i, t in [*rows, (90, ""), (91, "unseen theorems \u65e5")] if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for _, t in train for w in t.encode().split())
    begin = subwords.prior(subwords.piece_ranks(PATH))
    pieces = subwords.Pieces.of(begin)
    for _ in range(subwords.ROUNDS):
        found = {}
        for word in counts:
            subwords.expected([word], pieces, found)
        pieces = subwords.Pieces.of({k: found.get(k, 0.0) + w for k, w in begin.items()})
    once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
    less = once / (once + 2 * twice)
    assert once and twice and 0 < less < 1
    total = counts.total() + len(train)
    mass = less * len(counts) / total

    def word_score(w):
        seen = (counts[w] - less) / total if counts[w] else 0.0
        return log10(exp(subwords.word_log(w, pieces)) * mass + seen)

    texts = dict([*rows, (90, ""), (91, "unseen theorems \u65e5")])
    for r in subwords.scored(docs, PATH).collect():
        want = sum(word_score(w) for w in texts[r.doc_id].encode().split()) + log10(len(train) / total)
        assert isclose(r.score, want, rel_tol=1e-6), r


def test_discount():
    assert subwords.discount(0, 3) == subwords.discount(3, 0) == subwords.DISCOUNT
    assert subwords.discount(4, 2) == 0.5
