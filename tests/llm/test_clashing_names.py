"""Stages on odd rows: null ids and texts, repeated rows, one long text, and columns named like the helpers'."""

from collections import Counter

from pyspark.sql import functions as F
from test_lines import brute, fixture

import corpus_pipeline
from barcast.llm import jaccard, lines, quality
from barcast.llm.common import unused

SF = "/root/testdata/sf0.001"
EXTRA = ["_at", "_hash", "_cut", "_LINES", "_keep", "n_lines", "n_removed", "_first_at", "_first_hash", "pos", "h1", "first", "n", "digest", "root", "a.b"]


def with_extra(docs):
    """Every extra column holds its name and the row's mark."""
    return docs.select("*", *[F.concat(F.lit(name + "="), F.col("mark").cast("string")).alias(name) for name in EXTRA])


def test_unused():
    assert unused(["A", "_b"], "a", "_B", "c") == ["_a", "__B", "c"]
    assert unused(["x"], "x", "x") == ["_x", "__x"]


def test_lines_keep_other_columns(spark):
    rows = [(i, t, n) for n, (i, t) in enumerate(fixture())]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string, mark long"))
    got = lines.deduplicated(docs)
    assert sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_removed"])) for r in got.collect()) == brute(fixture())
    bare = lines.deduplicated(docs, counts=False)
    assert bare.columns == docs.columns
    for r in bare.collect():
        assert [r[name] for name in EXTRA] == [f"{name}={r['mark']}" for name in EXTRA]


def odd_rows(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [tuple(r) for r in documents.collect()]
    at = {c: i for i, c in enumerate(documents.columns)}

    def row(doc_id, text, like=rows[0]):
        out = list(like)
        out[at["doc_id"]], out[at["text"]], out[at["n_chars"]] = doc_id, text, len(text or "")
        return tuple(out)

    text = max((r[at["text"]] for r in rows), key=len)
    rows += [row(None, text), row(None, text), row(None, None), row(900_001, None), row(900_002, ""), rows[3], rows[3], row(900_003, "\n".join([text] * 40)), row(900_004, None, (None,) * len(at))]
    schema = documents.schema
    marked = spark.createDataFrame(rows, schema).withColumn("mark", F.monotonically_increasing_id())
    return with_extra(corpus_pipeline.staged(marked, "marked"))


def test_stages_keep_other_columns(spark):
    docs = odd_rows(spark)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = quality.Scorer(model)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["mark"]: r for r in docs.collect()}
        out = corpus_pipeline.staged(stage(spark, docs, SF), "odd")
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        after = {r["mark"]: r for r in out.collect()}
        assert len(after) == out.count() and after.keys() <= before.keys()
        for mark, r in after.items():
            changed = {c for c in docs.columns if r[c] != before[mark][c]}
            assert changed <= ({"text", "n_chars"} if name == "line dedup" else set())
        if name == "quality classifier":
            assert after.keys() == {m for m, r in before.items() if scorer.score(r["text"]) >= quality.THRESHOLD}
            # all odd rows go on, whatever the classifier says of them
            out = docs
        elif name == "line dedup":
            assert after.keys() == before.keys()
            want = Counter(eval(r)[1] for r in brute([(r["doc_id"], r["text"]) for r in before.values()]))
            assert Counter(r["text"] for r in after.values()) == want
        elif name == "n-gram Jaccard join":
            ids = {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()}
            with_words = [r for r in after.values() if (r["text"] or "").split()]
            assert len({ids[r["doc_id"]] for r in with_words}) == len(with_words)
            assert {ids[r["doc_id"]] for r in before.values() if (r["text"] or "").split()} == {ids[r["doc_id"]] for r in with_words}
            assert sum(not (r["text"] or "").split() for r in after.values()) == sum(not (r["text"] or "").split() for r in before.values())
        docs = out
    last = corpus_pipeline.token_ids(spark, docs, SF).collect()
    assert len(last) == docs.count()
