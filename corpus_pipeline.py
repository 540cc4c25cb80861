"""From raw documents to shards: five operators, each stage written and read again.

quality rules -> near-duplicates -> benchmark decontamination -> source mixture -> shards
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import chosen_path, feistel_shards, line_quality, mixture, qgram_leaks
from evenkeel.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted of lines of their own go."""
    return line_quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return chosen_path.keep_documents(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return qgram_leaks.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, per document and epoch."""
    return mixture.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot."""
    return feistel_shards.sharded_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
    ("sharding", sharding),
]

# hash permutations and approximate matching have no SQL form: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
