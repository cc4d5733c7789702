"""The whole toxicity query, recomputed without Spark, index or automaton."""

import math
from collections import Counter

from test_labels import fixture

from barcast.llm import toxicity


def brute(rows, labels, s=toxicity.Settings()):
    """Chosen terms, dense cosines against all examples, votes and scores of all rows."""
    import zlib

    value = {}
    for doc_id, _, toxic, *_ in labels:
        if doc_id is not None and toxic in (0, 1) and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            value[doc_id] = max(toxic, value.get(doc_id, 0))
    examples = sorted({(i, t, value[i]) for i, t in rows if i in value})  # fewer than per_class: all of them, weight 1
    assert max(Counter(v for _, _, v in examples).values()) < s.per_class

    def bag(text):
        framed = [f" {w} " for w in (text or "").lower().split()]
        return Counter(w[i : i + n] for w in framed for n in s.sizes for i in range(len(w) - n + 1))

    bags = [bag(t) for _, t, _ in examples]
    classes = Counter(v for _, _, v in examples)
    seen = {v: Counter(g for b, e in zip(bags, examples) if e[2] == v for g in set(b)) for v in (0, 1)}
    total = len(examples)
    terms = set()
    for g in seen[0].keys() | seen[1].keys():
        df = seen[0][g] + seen[1][g]
        gain = 0.0
        for v in (0, 1):
            for got, expected in ((seen[v][g], df * classes[v] / total), (classes[v] - seen[v][g], (total - df) * classes[v] / total)):
                gain += 2 * got * math.log(got / expected) if got else 0.0
        if df >= s.min_examples and df < total and gain >= s.min_gain:
            terms.add(g)
    idf = {g: math.log((1 + total) / (1 + seen[0][g] + seen[1][g])) + 1 for g in terms}

    def vector(counts):
        v = {g: (1 + math.log(c)) * idf[g] for g, c in counts.items() if g in terms}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    vectors = [vector(b) for b in bags]
    bare = [e[2] for e, v in zip(examples, vectors) if not v]
    base = (sum(bare) + 0.05) / (len(bare) + 1.0)
    out = []
    for doc_id, text in rows:
        own = vector(bag(text))
        near = sorted((-round(sum(x * v.get(g, 0.0) for g, x in own.items()), 12), i) for i, v in enumerate(vectors))
        near = [(-c, i) for c, i in near[: s.neighbours] if c < 0]
        weights = [c**s.power for c, _ in near]
        score = (s.prior * base + sum(w * examples[i][2] for w, (_, i) in zip(weights, near))) / (s.prior + sum(weights))
        out.append((doc_id, text, score, [round(c, 9) for c, _ in near]))
    return out


def test_whole_query(spark):
    docs, labels, known = fixture(spark)
    one = docs.where("doc_id is null or doc_id not in (1)").unionByName(docs.where("doc_id = 1").limit(1))
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = {(i, t): (score, near) for i, t, score, near in brute(rows, [r for r in labels.collect()])}
    texts = {r[0]: r[1] for r in rows}
    got = toxicity.judged(one, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        score, near = want[r.doc_id, texts[r.doc_id]]
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.3)
        assert [round(e.cosine, 9) for e in r.evidence] == near
    assert sum(bool(near) for _, near in want.values()) > 50


def test_terms_of_a_text():
    """The automaton counts what cutting every word by itself counts, also overlapping and nested grams."""
    s = toxicity.Settings(sizes=(3, 4))
    grams = {g for w in ("abab", "xx", "a<b", "ü!") for g in toxicity.grams(w, s)}
    index = toxicity.build([(1, 1, 1.0, dict.fromkeys(sorted(grams), 1))], s)
    for text in ("abab ababab\n\nxx  xx abxx", "", None, "A<B a<b> <", "ü!  xx", "ab ab"):
        want = Counter(index.vocabulary[g] for w in toxicity.words_of(text) for g in toxicity.grams(w, s) if g in index.vocabulary)
        assert toxicity.Scorer(index).counts(text) == want
    assert toxicity.Scorer(toxicity.build([], s)).score("abab") == (0.05, [])
