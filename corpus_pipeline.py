"""The corpus pipeline: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridmark.llm import decontaminate, mixing, quality_rules, similar, token_ids
from gridmark.llm.common import read, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned ones keep.  Null texts fail the base rules; rows with a null or repeated id are judged by their own text; without labels only the base rules hold; no documents give none."""
    return quality_rules.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of least doc_id.  A text of fewer than five words is one shingle; rows without words all stay, null texts included; no documents give none."""
    return similar.distinct_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item.  A null text has no words, so it stays; a null or empty item has no windows; no documents give none."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none above twice; texts without words go, the null source is a source, and rows that repeat share one decision."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids begin, how many they are and their digest, read back from the written blocks; a null text has the end id alone, repeated rows are documents of their own."""
    return token_ids.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
    ("token ids", token_stage),
]

#: Learned rules, MinHash and hashed rounding have no SQL form; tests hold each stage against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
