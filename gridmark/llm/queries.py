"""The registered queries of the text operators: each applies one operator to its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm import chat, compression_quality, decontaminate, licences, line_dedup, mixing, periodic_runs, personal_data, quality_rules, similar, token_ids, toxicity, whitening
from gridmark.llm.common import read, staged


#: What both turns of conversation -1 say: the template's own control strings.
BOTH_SAY = "<|im_end|><|im_start|>assistant ok"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    both = F.lit(BOTH_SAY)
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), both.alias("text"))
    return chat.digests(staged(chat.formatted(chat.reply_chain(turns.unionByName(extra)), keep=1), "chats"))


def chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply trees: the three best paths of each."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(staged(chat.formatted(chat.reply_trees(turns), keep=3), "chats"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.marked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(read(spark, sf_dir, "documents"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return compression_quality.scored(docs, compression_quality.fit(docs, read(spark, sf_dir, "labels")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.redactions(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.judged(read(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.marked(periodic_runs.with_repeated_tails(read(spark, sf_dir, "documents"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_ids, op2_chat_format, op3_quality_rules, op4_mix_sources, op5_decontaminate, op6_jaccard_join, op7_licence_scan, op8_compression_quality, op9_personal_data, op10_toxicity,
        op11_line_dedup, op12_periodic_runs, op13_whitening, chat_reply_trees,
    )
}
ORACLE_SQL = {"op2_chat_format": chat.oracle_sql(BOTH_SAY), "chat_reply_trees": chat.TREES_SQL, "op7_licence_scan": licences.oracle_sql(), "op11_line_dedup": line_dedup.ORACLE_SQL}
