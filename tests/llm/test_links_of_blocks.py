"""A pair that no side probes in one block is still looked at where one side probes."""

from barcast.llm import jaccard


def test_pair_without_prober_is_not_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rows = [(1, 10, True, 0), (1, 11, False, 1), (1, 12, False, 2), (1, 13, False, 3), (2, 12, True, 0), (2, 13, False, 1)]
    classes = [(10, 5, 9000, b"\0" * 8), (11, 6, 9, b"\0" * 8), (12, 1, 100, b"\0" * 8), (13, 2, 100, b"\0" * 8)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = jaccard.possible_links(
            spark.createDataFrame(rows, "key long, class long, probe boolean, place long"),
            spark.createDataFrame(classes, "class long, number long, n long, sketch binary"),
            jaccard.Settings(),
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [tuple(r) for r in got] == [(1, 2)]
