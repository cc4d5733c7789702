"""Registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcast.llm import bpe, decontaminate, html, jaccard, lines, middle, quality, rules, spelling, subwords, substrings, syncmers, toxicity
from barcast.llm.common import table

PIECE_FILE = "piece_bpe_32k.model"
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.scored(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), jaccard.Settings(words=3, percent=90))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(table(spark, sf_dir, "documents"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity_scores,
        "op2_decontamination": contamination,
        "op3_byte_pairs": bpe_round_trip,
        "op4_syncmers": fingerprints,
        "op5_line_dedup": line_dedup,
        "op6_subword_lattice": language_model,
        "op7_main_text": main_text,
        "op8_repeated_strings": repeated_strings,
        "op9_jaccard_join": jaccard_join,
        "op10_quality": quality_scores,
        "op11_fill_in_middle": fill_in_middle,
        "op12_spelling_variants": spelling_variants,
        "op13_quality_rules": quality_rules,
    }
