"""The registered queries of this subpackage: thin forms that return what their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    chat, conversations, debruijn, decontaminate, licenses, lm_scoring, mixing, quality, rules, sentencepiece_scan, simhash,
    token_counts, whitening)
from tallyhouse.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose fold of five is not 1, and the mixture weights on fold 0."""
    part = lm_scoring.fold("doc_id", 5)
    scored = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), part != 1, part == 0)
    return scored.withColumn("held_out", part == 1)


TOKENIZERS = "/opt/tokenizers"


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Encodes every text, decodes the pieces and compares."""
    encoded = sentencepiece_scan.encode(table(spark, sf_dir, "documents"), model)
    back = sentencepiece_scan.decode(encoded, model)
    return back.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_pieces"), "ids",
                       (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", "found", F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["license"]))).alias("licenses"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds 0 and 1 of four teach, fold 3 calibrates, fold 2 is held out."""
    part = lm_scoring.fold("doc_id", 4)
    scored = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part < 2, part == 3)
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the rows labelled as good and not toxic."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return rules.judge(table(spark, sf_dir, "documents"), trusted)


def op10_token_counts(spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), ranks)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations by a rule and repairs them."""
    talk = table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.repair(conversations.damage(talk)), talk)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_lm_scoring, op2_sentencepiece, op3_simhash, op4_license_scan, op5_quality_classifier,
    op6_decontamination, op7_chat_rotation,
    op8_substring_dedup, op9_quality_rules, op10_token_counts,
    op11_conversation_repair, op12_whitening, op13_source_mix,
)}
