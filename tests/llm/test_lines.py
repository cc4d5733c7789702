import random

from barcast.llm import lines


def brute(rows, width=3):
    """Windows in a dictionary by their text, first seen by (id, position)."""
    first = {}
    last = (1 << 63) - 1
    for doc_id, text in rows:
        parts = (text or "").split("\n") if text is not None else []
        for pos in range(len(parts) - width + 1):
            key, place = tuple(parts[pos : pos + width]), (last if doc_id is None else doc_id, pos)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        parts = text.split("\n")
        covered = set()
        for pos in range(len(parts) - width + 1):
            if first[tuple(parts[pos : pos + width])] != (last if doc_id is None else doc_id, pos):
                covered.update(range(pos, pos + width))
        out.append((doc_id, "\n".join(p for i, p in enumerate(parts) if i not in covered), len(parts), len(covered)))
    return sorted(map(str, out))


def fixture():
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(12)] + ["", "Ü"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n\n\n\n"), (63, "a\nb\nc\na\nb\nc\na\nb"), (None, "x\ny\nz"), (64, "x\ny\nz"), (64, "x\ny\nz"), (65, "\n".join(["same"] * 3000))]
    return rows


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 5, "p") for r in fixture()], "doc_id long, text string, n_lines long, pos string").repartition(4)
    got = lines.deduplicated(docs)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect()) == brute(fixture())
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_text_is_split_once(spark):
    """The lines are made before the ranges are cut out of them, not once per range."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.deduplicated(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("slice(split(" in line.replace(" ", "") and "lambda" in line for line in plan.splitlines())
