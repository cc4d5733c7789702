"""The vocabulary of the toxicity examples holds terms of either class."""

from barcast.llm import toxicity


def test_terms_need_not_lean_to_toxic(spark):
    """``shared`` is in every toxic row and in more clean ones; ``calm`` speaks for clean rows only."""
    rows = [(i, f"filler{i % 7} " + ("zshared" if i % 6 == 0 or i % 5 < 2 else "qcalm")) for i in range(600)]
    docs = spark.createDataFrame([(i, f"{t} n{i}") for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i, _ in rows], "doc_id long, toxic int, quality int")
    terms = set(toxicity.fit(docs, labels).vocabulary)
    assert set(toxicity.grams("zshared", toxicity.Settings())) <= terms
    assert set(toxicity.grams("qcalm", toxicity.Settings())) <= terms
