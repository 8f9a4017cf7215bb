"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kalmia.llm import chat, exact_dedup, filter_audit, harmonic, mixing, ngram_join, packing, pii, repair, sharding, spotsigs, tokens, toxicity
from kalmia.llm._common import documents, prepare


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.query(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(documents(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.query(documents(spark, sf_dir))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chat.query(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.query(documents(spark, sf_dir))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(documents(spark, sf_dir))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.query(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.query(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_token_counts, op3_toxicity, op4_poisson_mixing, op5_ngram_jaccard_join, op6_chat_formatting, op7_exact_dedup, op8_rendezvous_sharding, op9_pii, op10_spotsigs,
        op11_conversation_repair, op12_filter_audit, op13_harmonic_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_poisson_mixing": mixing.SQL, "op7_exact_dedup": exact_dedup.SQL, "op11_conversation_repair": repair.SQL, "op12_filter_audit": filter_audit.SQL}
