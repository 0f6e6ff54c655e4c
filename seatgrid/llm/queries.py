"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatgrid.llm import (
    chat_format,
    decontaminate,
    hard_negatives,
    license_scan,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    run_dedup,
    sharding,
    token_alignment,
    toxicity,
)
from seatgrid.llm.common import read_table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents")).drop("text_key")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).drop("text_key")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), wrapped=True))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", clash), (-7, 1, "assistant", clash)],
                                 "conv_id bigint, turn bigint, role string, text string")
    return chat_format.conversation_digest(chat_format.format_conversations(rows.unionByName(more)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_pairs(decontaminate.find_contained(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.contract_rows(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_chat_format": op4_chat_format,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_run_dedup": op13_run_dedup,
}

ORACLE: dict[str, str] = {
    "op3_license_scan": license_scan.oracle(),
    "op4_chat_format": chat_format.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
