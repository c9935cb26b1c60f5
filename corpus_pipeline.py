"""A training corpus from raw documents: quality, near-dedup, repeated passages, benchmark leaks, mix.

Each stage takes the session, the documents that its predecessor kept, and the
folder of the other tables; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import decontaminate, mixing, passages, quality, simhash
from keystrata.llm.common import shared_table, table
from keystrata.llm.registry import DOMAIN_WEIGHTS, source_domain

#: No SQL: the forest, the fuzzy alignment and seeded epochs can't be put in it; tests hold the stages to brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest identifier."""
    return simhash.keep_one_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; their first occurrence stays."""
    return passages.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut out; documents that mostly are benchmark go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by epoch under the weights of domains and languages; as many tokens as came in."""
    return mixing.mix(docs, source_domain(), DOMAIN_WEIGHTS, budget_share=1.0, max_epochs=2)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
