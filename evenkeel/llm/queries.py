"""One query per operator over its whole table, and DuckDB checks where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import (
    arc_convert, byte_pairs, chosen_path, collocations, feistel_shards, licences, line_quality,
    mixture, qgram_leaks,
    subword_toxicity, suffix_levels, token_spans, word_runs,
)
from evenkeel.llm.common import table
from evenkeel.llm.oracles import ORACLES as ORACLES  # noqa: PLC0414 - registered with the queries


def op1_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_tokens(table(spark, sf_dir, "documents"))


def op2_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.without_repeats(table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_quality.line_verdicts(documents).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op4_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.shard(table(spark, sf_dir, "documents"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return arc_convert.read_archives(arc_convert.archive_pages(pages))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mixture(documents).select(
        "doc.doc_id", "size", "source_size", "target", "taken"
    )


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_toxicity.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op10_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return byte_pairs.coding_report(table(spark, sf_dir, "documents"), vocabulary)


QUERIES = {
    "op1_token_spans": op1_token_spans,
    "op2_suffix_levels": op2_suffix_levels,
    "op3_line_frequency": op3_line_frequency,
    "op4_qgram_leaks": op4_qgram_leaks,
    "op5_feistel_shards": op5_feistel_shards,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_source_mixture": op7_source_mixture,
    "op8_chosen_path": op8_chosen_path,
    "op9_subword_toxicity": op9_subword_toxicity,
    "op10_licence_paragraphs": op10_licence_paragraphs,
    "op11_word_runs": op11_word_runs,
    "op12_collocations": op12_collocations,
    "op13_byte_pairs": op13_byte_pairs,
}
