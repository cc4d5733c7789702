"""Corpus preparation in five stages: quality, repeated lines, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again for
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcast.llm import bpe, decontaminate, jaccard, lines, quality
from barcast.llm.common import table
from barcast.session import staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, each judged by its own text; null and empty texts get the model's bias."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; ``n_chars`` follows the text.

    All rows stay, null texts as they are (0 characters); rows that repeat id and text get the same result.
    """
    length = F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return lines.deduplicated(docs, counts=False).withColumn("n_chars", length)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8).

    Of repeated rows one stays; rows without words all stay, and null ids come last within a group.
    """
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passages to speak of, each judged by its own text; those without words stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text with digests of the ids and of the text decoded from them; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

# The classifier is not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0])
    return docs
