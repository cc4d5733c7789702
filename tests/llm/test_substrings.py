import random
from collections import Counter

import numpy as np

from barcast.llm import substrings


def brute(rows, length):
    """Counts every string of the length, over all rows."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(map(str, out))


def fixture(length):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdé\n ", k=n))
    passage = [text(3 * length) for _ in range(4)] + [text(length), text(length + 1)]
    rows = [(i, text(rng.randint(0, 200)) + rng.choice(passage)[rng.randint(0, 20) :] + text(rng.randint(0, 90))) for i in range(50)]
    rows += [(50, None), (51, ""), (52, "x" * 500), (53, "ab" * 300), (54, passage[0]), (54, passage[0]), (None, rows[3][1]), (55, text(length))]
    rows += [(56, text(4000) + passage[1] + text(2000) + passage[1])]
    period = text(23)  # periodic runs of several lengths and phases, alone and between other bytes
    rows += [(60 + i, text(i) + (period * 40)[i : 200 + 90 * i] + text(3 * i)) for i in range(5)] + [(65, text(61) * 9), (66, "x" * 700)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    for length, gram, hot in ((40, 12, 5000), (40, 12, 2), (37, 13, 5000)):
        rows = fixture(length)
        docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, n_bytes int, anchor string").repartition(4)
        got = substrings.deduplicated(docs, length, gram, hot)
        assert sorted(str((r[0], r[1], r[2], r[3], bytes(r[4]))) for r in got.collect()) == brute(rows, length)
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_standard_length(spark):
    rows = fixture(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.deduplicated(docs)
    assert sorted(str((r[0], r[1], r[2], r[3], bytes(r[4]))) for r in got.collect()) == brute(rows, 200)


def test_own_repeats_go_on_once():
    data = b"head" + b"a run of words " * 400 + b"tail"
    anchor, lo, hi, begins, ends = substrings.text_anchors(data, 60, 16)
    assert len(anchor) < 12
    assert sum(1 for b in begins if b) == 1 and max(e[-1] for e in ends if e) > 5900
    assert substrings.text_anchors(b"short", 60, 16) == ([], [], [], [], [])


def test_chunks(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choices(b"abc", k=5000))
    whole = {w: h for hs, _, lo, hi in substrings.anchors(data, 30, 8) for h, a, b in zip(hs.tolist(), lo, hi) for w in range(a, b + 1)}
    monkeypatch.setattr(substrings, "CHUNK", 700)
    parts = {w: h for hs, _, lo, hi in substrings.anchors(data, 30, 8) for h, a, b in zip(hs.tolist(), lo, hi) for w in range(a, b + 1)}
    assert whole == parts and len(whole) == 5000 - 29


def test_refined_buckets():
    rng = random.Random(6)
    data = bytes(rng.choices(b"ab", k=400)) * 2
    bucket = substrings.refined(np.frombuffer(data, dtype=np.uint8), 50)
    order = sorted(range(len(data)), key=lambda p: data[p : p + 50])
    for a, b in zip(order, order[1:]):
        assert (bucket[a] == bucket[b]) == (data[a : a + 50] == data[b : b + 50])
        assert bucket[a] <= bucket[b]
