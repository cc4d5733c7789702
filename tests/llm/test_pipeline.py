import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from test_decontaminate import brute as contaminated
from test_jaccard import brute as groups
from test_lines import brute as deduplicated

import corpus_pipeline
from barcast.llm import bpe, quality
from barcast.llm.jaccard import Settings

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    model = quality.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = quality.Scorer(model)
    rows = [(i, t) for i, t in rows if scorer.score(t) >= quality.THRESHOLD]
    rows = [eval(r)[:2] for r in deduplicated(rows)]
    first = {i: c for i, n, c in map(eval, groups(rows, Settings())) if n}
    rows = [(i, t) for i, t in rows if first.get(i, i) == i]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated(rows, bench) if r[5]}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = set()
    for i, t in rows:
        if i not in bad:
            ids = known.encode_ordinary(t)
            packed = np.array(ids, "<u4").tobytes()
            want.add((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), packed))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(*r[:4], bytes(r[4])) for r in got} == want and len(got) == len(want) > 50


def test_columns_and_empty(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.dtypes == documents.dtypes
        docs = spark.createDataFrame([], docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
