"""Queries of the training-data operators: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from riskweave.sources.tables import read_table

from . import alignment, fmindex, htmltext, langid, licenses, mixing, negatives, quality, sharding, simhash, suffixdedup, tokencount, toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: counts, base rules and line-first verdict of every document."""
    out = quality.judge(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.drop("clean_text", "loss")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: toxicity score of every document."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                             read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: licence sentences and licences of every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: words the mix takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])).drop("source", "copies")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: slot and shard of every document."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id"])
    return sharding.place(docs, slot_col="slot")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: main text of every page."""
    return htmltext.main_text(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: predicted language of every document."""
    return langid.identify(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: benchmark windows in every document."""
    return fmindex.decontaminate(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                 read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: bytes of every document that repeat earlier ones."""
    return suffixdedup.remove_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: tokens, groups and links of every document by two tokenizers."""
    return alignment.align(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: hard negatives of every anchor and positive."""
    return negatives.mine(read_table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"]))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: tokens of every document."""
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID, near-dedup, decontamination, mixing and sharding of all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_license_scans": op3_license_scans,
    "op4_mixing": op4_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sharding": op6_sharding,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op12_hard_negatives": negatives.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
