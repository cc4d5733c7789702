"""Rows are judged one by one, whatever their ids and the number of blocks of the benchmark."""

from test_decontaminate import brute, fixture

from barcast.llm import decontaminate as D


def test_repeated_and_null_ids_in_blocks(spark):
    docs, bench = fixture()
    leak = bench[3][1]
    docs = [*docs, (None, "clean text without an id"), (None, leak), (7, leak), (7, "clean text of a repeated id"), (None, "another clean one")]
    frame = spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id long, text string, _spans int").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(k for k, row in enumerate(brute(docs, bench)) if not row[5])
    for size in (1 << 24, 400):
        kept = D.decontaminated(frame, items, block_bytes=size)
        assert kept.schema == frame.schema
        assert sorted(r["_spans"] for r in kept.collect()) == want
    assert D.longest_matches(frame, items, block_bytes=400).count() == D.longest_matches(frame, items).count()
