"""Fill-in-the-middle against a plain regex version, with odd rows."""

import hashlib
import random
import re

from barcast.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    parts = UNIT.findall(text)
    n = len(parts)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", text, None, None)
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m))
    return (doc_id, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def fixture():
    rng = random.Random(11)
    alphabet = ["a", "ß", "é", "日", "𝄞", " ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", " ", "<", "P", ">", "S", "M", "\\1", "\x00"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " "), (403, "  \n "), (404, "<P>"), (405, "< P> <S"), (None, "null id here"), (None, None)]
    rows += [(i, "repeated row with some words") for i in (7, 7, 7, 500)]
    rows += [(600 + i, "long ü " * 300_000 + "end") for i in range(4)]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, form string, n int, h0 int").repartition(3)
    got = middle.transformed(docs)
    assert got.columns == ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = got.collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_restored_from_output_and_form(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = middle.digest(docs).select("doc_id", "restored_sha256").collect()
    want = [(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_slices_and_settings(spark, monkeypatch):
    texts = ["one two three ", "", "x" * 50, " four"] * 20
    monkeypatch.setattr(middle, "SLICE_BYTES", 40)
    assert [s for s in middle._slices(middle.np.array([10, 20, 10, 90, 0, 5]))] == [(0, 3), (3, 1), (4, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    all_psm = middle.transformed(docs, middle.Settings(seed=1, rate=100, spm=0)).collect()
    assert {r.form for r in all_psm} == {"plain", "psm"} and sum(r.form == "plain" for r in all_psm) == 20
    assert middle.transformed(docs.limit(0)).count() == 0


def test_ids_as_text(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", None)], "doc_id string, text string")
    assert [tuple(r) for r in middle.transformed(docs).orderBy("doc_id").collect()] == [brute("a", "x y z"), brute("b", None)]
