"""One row stays of each group of near copies, also where ids and texts repeat."""

from barcast.llm import jaccard, lines


def test_repeated_rows_collapse(spark):
    text = "one two three four five six seven eight nine ten eleven"
    other = "quite another text that shares no words with it or so"
    rows = [(1, text), (1, text), (2, text + " "), (None, other), (None, other), (None, other), (None, None), (None, ""), (None, ""), (5, " \n")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(4)
    kept = jaccard.one_of_each(docs)
    assert kept.schema == docs.schema
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, text), (None, other), *rows[6:]]))


def test_header_of_different_texts_with_one_id(spark):
    """Different texts without an id, or with the same one, share a header at the same place: it stays once."""
    rows = [(i, f"h1\nh2\nh3\ntail {k}") for k, i in enumerate([None, None, None])] + [(7, f"g1\ng2\ng3\ntail {k}") for k in range(3)]
    got = [r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sum(t.startswith("h1") for t in got) == 1 and sum(t.startswith("g1") for t in got) == 1
    assert sum(t.startswith("tail") for t in got) == 4
