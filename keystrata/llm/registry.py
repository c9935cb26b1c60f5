"""Queries of the corpus operators with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_model, licenses, mixing, passages, quality, simhash, token_counts, toxicity
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Four domains of sources by number; weights of domains, and of languages within each.
DOMAIN_WEIGHTS = {("dom0",): 4, ("dom1",): 3, ("dom2",): 2, ("dom3",): 1, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 1}


def source_domain() -> Column:
    """The domain of ``source``: its number modulo four; sources without one form their own."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("dom"), (number.cast("long") % 4).cast("string"))).otherwise("other")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), {**licenses.TEMPLATES, **licenses.full_texts()})


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), source_domain(), DOMAIN_WEIGHTS, budget_share=0.6)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict:
    found = (op1_license_scans, op2_quality_rules, op3_html_extraction, op4_toxicity, op5_source_mixing, op6_lm_scoring, op7_simhash_near_dedup, op8_benchmark_decontamination, op9_substring_dedup, op10_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": licenses.ORACLE, "op5_source_mixing": mixing.ORACLE, "op8_benchmark_decontamination": decontaminate.ORACLE}
