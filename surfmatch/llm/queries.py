"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surfmatch.llm import bpe, conversations, decontaminate, html_extract, langid, merkle, minhash_dedup, oracles, packing, paragraph_dedup, quality, secrets, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.remove_paragraphs(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary() -> str:
    """Where the public vocabulary of the packing query lies."""
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_proofs(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_secret_scan": op2_secret_scan,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_paragraph_dedup": op5_paragraph_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_url_filter": op7_url_filter,
        "op8_decontamination": op8_decontamination,
        "op9_language_id": op9_language_id,
        "op10_quality_rules": op10_quality_rules,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_bpe_round_trip": op13_bpe_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_filter.ORACLE_SQL, "op11_merkle_manifest": oracles.MANIFEST, "op12_conversation_repair": oracles.CONVERSATIONS}
