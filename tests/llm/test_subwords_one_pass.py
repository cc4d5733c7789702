"""Texts are cut into words twice in all: once for the counts, once for all scores."""

import public_tokenizers
from barcast.llm import subwords

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_texts_are_read_once_for_their_scores(spark, tmp_path, monkeypatch):
    """Only one Arrow pass reads the texts for scores, and rare and frequent words, copies and null ids all count once."""
    monkeypatch.setattr(subwords, "FREQUENT", 0.05)
    rows = [(i, f"the the end w{i} x{i % 2} ") for i in range(30)] + [(None, "the q"), (None, "the q"), (None, None), (4, ""), (5, "the w5"), (5, "the w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    passes, plain = [], subwords.map_lists
    monkeypatch.setattr(subwords, "map_lists", lambda df, work, schema: passes.append(df.columns) or plain(df, work, schema))
    got = subwords.scored(docs, PATH).collect()
    assert sum("text" in columns for columns in passes) == 2
    want = sorted((str(i), len((t or "").split()) + 1) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert all(1 <= r.n_known <= r.n_tokens and r.score < 0 > r.base_score for r in got)
