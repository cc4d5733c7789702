import base64
import codecs
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barcast.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(bpe.Transducer(RANKS), P.PATTERN)


def ids(text):
    return np.frombuffer(ENCODER.encode(text), dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c 　'stéß日本👍🏽é"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_same_as_library(text):
    assert ids(text) == KNOWN.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "   x", "a  b", "a \n b", "it's we'll", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the" * 5000, "é" * 3000, "x " * 4000, "1234567 89"])
def test_edge_texts(text):
    assert ids(text) == KNOWN.encode_ordinary(text)


def test_small_state_table():
    small = bpe.Transducer(RANKS, max_states=3)
    for word in ("internationalisation", "ununbelievable", "donaudampfschiff" * 20):
        assert small.encode(word.encode()) == KNOWN.encode_ordinary(word)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_stream(data, step):
    stream, library = bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace")
    out = "".join(stream.push(data[i : i + step]) for i in range(0, len(data), step)) + stream.finish()
    assert out == "".join(library.decode(data[i : i + step]) for i in range(0, len(data), step)) + library.decode(b"", True)


def test_round_trip(spark):
    rows = [(1, "Über the café\n\n it's", 1), (2, None, 2), (3, "", 3), (None, "x", 4), (1, "Über the café\n\n it's", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(bpe.round_trip(docs, PATH, P.PATTERN).collect(), key=str)
    want = sorted(
        (
            (i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
            for i, x, _ in rows
            for t in [KNOWN.encode_ordinary(x or "")]
        ),
        key=str,
    )
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    for r in docs.collect():
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == KNOWN.encode_ordinary(r.text)
