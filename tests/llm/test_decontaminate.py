import hashlib
import random

from barcast.llm import decontaminate as D

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi".split()


def brute(docs, bench):
    items = [(str(i) if i is not None else "", D.words_of(t)) for i, t in bench if t is not None]
    out = []
    for doc_id, text in docs:
        words, covered, found = D.words_of(text), set(), set()
        for item, iw in items:
            n = min(13, len(iw))
            for a in range(len(iw) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == iw[a : a + n]:
                        covered.update(range(p, p + n))
                        found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(covered), len(found), sha, bool(covered) and 20 * len(covered) >= len(words)))
    return out


def fixture():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    bench = [(i, text(rng.randint(14, 40))) for i in range(12)] + [(20, "Solo!"), (21, "two words"), (22, ""), (23, None), (None, text(15)), (5, text(20))]
    bench.append((0, bench[0][1]))
    docs = [(i, text(rng.randint(0, 60))) for i in range(20)]
    for i in range(20, 60):
        item = bench[rng.randrange(12)][1].split()
        a = rng.randrange(len(item))
        docs.append((i, f"{text(rng.randint(0, 30))} {' '.join(item[a : a + rng.randint(1, 40)]).upper()}, {text(rng.randint(0, 300))}"))
    docs += [(60, None), (61, ""), (62, "a solo b"), (63, "TWO-words"), (None, bench[1][1]), (64, bench[1][1] * 50), (64, bench[1][1] * 50), (65, "Übermäßig solo")]
    return docs, bench


def frames(spark):
    docs, bench = fixture()
    return (
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int").repartition(3),
        spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, spans string"),
    )


def test_against_brute_force(spark):
    docs, bench = frames(spark)
    want = sorted(map(str, brute(*fixture())))
    assert sorted(str(tuple(r)) for r in D.contamination(docs, bench).collect()) == want
    assert sorted(str(tuple(r)) for r in D.contamination(docs, bench, block_bytes=400).collect()) == want


def test_small_shards(spark, monkeypatch):
    docs, bench = fixture()
    test = D.test_side([(str(i), t) for i, t in bench if t is not None])
    rows = list(D._shards([[[d for d, _ in docs], [t for _, t in docs]]], 1, test, 50))
    assert len(rows) > 10 and sum(len(c[0]) for c, _ in rows) == len(docs)


def test_longest_matches(spark):
    docs, bench = frames(spark)
    got = {(r.item_id, r.word_offset): (r.length, r.doc_id, r.position) for r in D.longest_matches(docs, bench).collect()}
    drows, brows = fixture()
    for item in range(1, 12):
        if item == 5:
            continue
        words = D.words_of(brows[item][1])
        for at in range(len(words)):
            best, places = None, {}
            for doc_id, text in drows:
                dw = D.words_of(text)
                for p in range(len(dw)):
                    n = 0
                    while at + n < len(words) and p + n < len(dw) and words[at + n] == dw[p + n]:
                        n += 1
                    places[(doc_id, p)] = n
                    best = max(best or 0, n) if n >= 2 else best
            found = got.get((str(item), at))
            assert (found and found[0]) == best
            assert found is None or places[found[1:]] == best


def test_removal_and_empty(spark):
    docs, bench = frames(spark)
    bad = {r[0] for r in brute(*fixture()) if r[5]}
    for size in (1 << 24, 400):
        kept = D.decontaminated(docs, bench, block_bytes=size)
        assert kept.schema == docs.schema
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in fixture()[0] if i not in bad)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.longest_matches(docs, bench.limit(0)).count() == 0
