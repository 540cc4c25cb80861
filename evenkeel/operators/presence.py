"""Presence of tables and columns on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel import fixed_values as fv
from evenkeel.operators.policy import ExclusionPolicy, decide_exclusions, target_only_category
from evenkeel.schema import RESULT_SCHEMA


def table_presence(
    source: DataFrame, target: DataFrame, exclusions: DataFrame | None = None
) -> DataFrame:
    """Status of every table by upper-case name.

    ``source`` and ``target`` have ``table``; ``exclusions`` has ``table_name, reason``.  MATCHED,
    MISSING_EXCLUDED, MISSING_CRITICAL, or TARGET_ONLY.
    """
    s = source.select(F.col("table").alias("source_table"), F.upper("table").alias("u_table"))
    t = target.groupBy(F.upper("table").alias("u_table")).agg(
        F.max("table").alias("target_table")
    )
    both = s.join(t, ["u_table"], "full_outer")
    if exclusions is None:
        both = both.withColumn("exclusion_reason", F.lit(None).cast("string"))
    else:
        reasons = (
            exclusions.filter(F.trim("table_name") != "")
            .groupBy(F.upper(F.trim("table_name")).alias("u_table"))
            .agg(F.max(F.trim(F.coalesce("reason", F.lit("Excluded by config"))))
                 .alias("exclusion_reason"))
        )
        both = both.join(reasons, ["u_table"], "left")
    status = (
        F.when(F.col("source_table").isNull(), "TARGET_ONLY")
        .when(F.col("target_table").isNotNull(), "MATCHED")
        .when(F.col("exclusion_reason").isNotNull(), "MISSING_EXCLUDED")
        .otherwise("MISSING_CRITICAL")
    )
    return both.withColumn("status", status).select(
        "source_table",
        "target_table",
        "status",
        F.when(F.col("status") == "MISSING_EXCLUDED",
               F.concat(F.lit("Excluded: "), "exclusion_reason"))
        .when(
            F.col("status") == "MISSING_CRITICAL",
            F.concat(F.lit("Table '"), "source_table",
                     F.lit("' exists in source but was NOT found in target. "
                           "Migration may be incomplete or table name changed.")),
        )
        .otherwise("")
        .alias("message"),
    )


def presence_failures(presence: DataFrame) -> DataFrame:
    """Missing tables as FAIL results with the columns of a run's results, to be put under them."""
    known = {
        "table": F.col("source_table"), "validation_type": F.lit("table_presence"),
        "status": F.lit("FAIL"), "error": F.col("message"),
    }
    return presence.filter(F.col("status") == "MISSING_CRITICAL").select(
        *[
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RESULT_SCHEMA.fields
        ]
    )


def schema_presence(
    source: DataFrame,
    target: DataFrame,
    policy: ExclusionPolicy | None = None,
    source_db: str = "postgresql",
) -> DataFrame:
    """Every column of both catalogs: matched, excluded, source_only or target_only.

    Columns pair up by table and upper-case name; names that differ in case only count once,
    the last one standing for them.
    """

    def side(frame: DataFrame, tag: str) -> DataFrame:
        return frame.groupBy("table", F.upper("name").alias("u_name")).agg(
            F.max_by(F.struct("name", "type"), "ordinal").alias(tag)
        )

    both = side(source, "s").join(side(target, "t"), ["table", "u_name"], "full_outer")
    rows = both.select(
        "table",
        F.coalesce("s.name", "t.name").alias("column_name"),
        F.col("t.name").alias("target_column"),
        F.col("s.type").alias("source_type"),
        F.col("t.type").alias("target_type"),
        F.lit(source_db).alias("source_db"),
        F.when(F.col("t").isNull(), "source_only")
        .when(F.col("s").isNull(), "target_only")
        .otherwise("matched")
        .alias("side"),
    )
    decided = decide_exclusions(rows, policy or ExclusionPolicy.default())
    extra = target_only_category(F.col("column_name"))
    side_is = F.col("side")
    excluded = (side_is == "matched") & F.col("excluded")
    return decided.select(
        "table", "column_name", "target_column", "source_type", "target_type",
        F.when(excluded, "excluded").otherwise(side_is).alias("presence"),
        F.when(side_is == "target_only", extra["category"])
        .when(side_is == "source_only", F.lit(fv.SOURCE_ONLY[0]))
        .when(excluded, F.lit("Excluded"))
        .alias("category"),
        F.when(side_is == "target_only", extra["reason"])
        .when(side_is == "source_only", F.lit(fv.SOURCE_ONLY[1]))
        .when(excluded, F.col("reason"))
        .alias("reason"),
        F.when(excluded, F.col("rule_type")).alias("rule_type"),
    )


def all_column_names(source: DataFrame, target: DataFrame) -> DataFrame:
    """Distinct upper-case column names of both sides per table."""
    return (
        source.select("table", F.upper("name").alias("column_name"))
        .unionByName(target.select("table", F.upper("name").alias("column_name")))
        .distinct()
    )
