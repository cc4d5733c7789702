"""Classifiers of toxicity and quality on small made tables with odd rows."""

import random

import numpy as np

from barcast.llm import quality, toxicity


def fixture(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        text = [rng.choice(words) + ("" if good else "!!!") for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["zorkxyz", "zorkqut"])
        rows.append((i, " ".join(text), 1.0))
        labels.append((i, int(good), int(toxic), "q"))
    rows += [(900, None, 1.0), (901, "", 1.0), (None, "zorkxyz", 1.0), (1, rows[1][1], 1.0), (902, "y" * 100_000, 1.0)]
    labels += [(None, 1, 1, "q"), (5, None, None, "q"), (7, labels[7][1], labels[7][2], "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, label double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), labels


def test_held_out_accuracy(spark):
    docs, labels, known = fixture(spark)
    for found, at in ((quality.judged(docs, labels), 1), (toxicity.judged(docs, labels), 2)):
        got = found.collect()
        assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
        held = {r.doc_id: r.predicted for r in got if r.held_out}
        right = [held[r[0]] == r[at] for r in known if r[0] in held and r[at] is not None]
        assert len(right) > 60 and np.mean(right) > 0.95
        assert not next(r.held_out for r in got if r.doc_id is None)


def test_no_labels(spark):
    docs, labels, _ = fixture(spark)
    for judged in (quality.judged, toxicity.judged):
        assert judged(docs, labels.limit(0)).count() == 405
        assert judged(docs.limit(0), labels).count() == 0


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    settings = toxicity.Settings(neighbours=5, block=8)
    bags = [(i, int(i % 2), 1.0, {f"t{t}": int(rng.integers(1, 4)) for t in rng.integers(0, 30, rng.integers(1, 6))}) for i in range(100)]
    index = toxicity.build(bags, settings)
    vectors = []
    for _, _, _, bag in bags:
        terms, weights = index.vector(toxicity.Counter({index.vocabulary[g]: c for g, c in bag.items()}))
        dense = np.zeros(len(index.vocabulary))
        dense[terms] = weights
        vectors.append((terms, weights, dense))
    for terms, weights, dense in vectors:
        cosines = np.round([dense @ v[2] for v in vectors], 12)
        want = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[:5]
        assert [i for i, _ in index.nearest(terms, weights)] == [i for _, i in want]
