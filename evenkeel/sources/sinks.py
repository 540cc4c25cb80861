"""Report, mismatch, plan and log sinks.

Every sink writes a directory that Spark appends to, so a lost executor only repeats its
own files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import (
    DataFrame, Observation, SparkSession, functions as F, types as T,
)

from evenkeel.operators.numbering import numbered
from evenkeel.operators.windows import latest_per_key
from evenkeel.schema import schema

CONFIRMED_SCHEMA = schema(
    "source_table string, target_table string, confirmed_by string, "
    "confirmed_at timestamp_ntz, source_connection string"
)
LEARNED_SCHEMA = schema(
    "source_column string, target_column string, source_type string, target_type string, "
    "correct_rule string, reason string, table_name string, corrected_at timestamp_ntz"
)


def append_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Summary and coverage reports: append, each part file with its header."""
    report.write.mode("append").option("header", True).format(fmt).save(path)


def write_mismatches(diff: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write the mismatches and say whether there were any.

    The difference is evaluated once and kept nowhere else: the write counts its rows.
    """
    seen = Observation("mismatches")
    counted = diff.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").option("header", True).format(fmt).save(path)
    return seen.get["rows"] > 0


def write_plan(mapping: DataFrame, path: str) -> None:
    """Mapping plan, one directory per layer and table, latest write wins per table."""
    (
        mapping.repartition("layer", "table")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("layer", "table")
        .parquet(path)
    )


def read_plan(
    spark: SparkSession, path: str, schema: T.StructType, table: str | None = None
) -> DataFrame:
    plan = spark.read.schema(schema).parquet(path)
    return plan if table is None else plan.filter(F.col("table") == table)


def confirm_mapping(confirmed: DataFrame, path: str) -> None:
    """Append to the confirmed table-mapping log."""
    confirmed.write.mode("append").parquet(path)


def confirmed_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Latest confirmation per source table; an absent log is an empty log."""
    log = _read_log(spark, path, CONFIRMED_SCHEMA)
    return latest_per_key(log, ["source_table"], [F.desc("confirmed_at")])


def _read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log that was never written is empty; any other failure to read it is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_learned(corrections: DataFrame, path: str) -> None:
    """Append corrections to the learned log."""
    corrections.select(*LEARNED_SCHEMA.names).write.mode("append").parquet(path)


def learned(spark: SparkSession, path: str) -> DataFrame:
    """Latest correction per (source, target) pair of the log, with a stable ``seq``.

    ``seq`` orders the pairs by the time of their correction, then by names.
    """
    log = _read_log(spark, path, LEARNED_SCHEMA)
    pair = [F.upper("source_column").alias("s_key"), F.upper("target_column").alias("t_key")]
    newest = latest_per_key(log.select("*", *pair), ["s_key", "t_key"], [F.desc("corrected_at")])
    order = [F.asc_nulls_first("corrected_at"), F.asc("s_key"), F.asc("t_key")]
    return numbered(newest, order).drop("s_key", "t_key")


def upsert_learned(stored: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections replace stored rows of the same (source, target) pair, whatever the case.

    Several corrections of one pair keep the latest.
    """
    pair = [F.upper("source_column").alias("s_key"), F.upper("target_column").alias("t_key")]
    newest = latest_per_key(
        corrections.select("*", *pair), ["s_key", "t_key"], [F.desc("corrected_at")]
    )
    kept = stored.select("*", *pair).join(newest.select("s_key", "t_key"), ["s_key", "t_key"],
                                          "left_anti")
    return kept.unionByName(newest).drop("s_key", "t_key")


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Audit export of exclusion decisions."""
    decisions.write.mode("overwrite").json(path)
