"""Semantic groups of columns and the checks they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel import fixed_values as fv
from evenkeel.functions.binding import ends_with_any, let, starts_with_any
from evenkeel.functions.names import has_word

NUMERIC_GROUPS = ["numeric_financial", "numeric_quantity", "numeric_generic"]
GROUPS = [
    "skipped", "temporal", "identifier", "status_flag", *NUMERIC_GROUPS, "text_enum",
    "text_generic",
]
CHECKS = [
    "row_count", "data_validation", "null_pct", "distinct_count", "min_max", "sum",
    "duplicate_check", "value_distribution",
]


def column_group(name: Column, type_name: Column) -> Column:
    """First matching group: type decides skip and temporal, then names, then types."""
    base = F.trim(F.regexp_replace(F.trim(F.lower(type_name)), r"\s*\([^)]*\)", ""))
    return let(F.struct(F.lower(name).alias("n"), base.alias("t")), _group_of)


def _group_of(column: Column) -> Column:
    n, t = column["n"], column["t"]
    numeric = starts_with_any(t, fv.NUMERIC_TYPE_PREFIXES)
    last_word = F.element_at(F.split(n, "_"), -1)
    return (
        F.when(t.isin(fv.SKIP_TYPES), "skipped")
        .when(t.isin(fv.TEMPORAL_TYPES), "temporal")
        .when(t.contains("uuid") | (n == "id") | ends_with_any(n, fv.ID_SUFFIXES), "identifier")
        .when(
            t.isin("boolean", "bool") | starts_with_any(n, fv.FLAG_PREFIXES) | n.isin(fv.FLAG_NAMES),
            "status_flag",
        )
        .when(numeric & has_word(n, fv.FINANCIAL_WORDS), "numeric_financial")
        .when(numeric & has_word(n, fv.QUANTITY_WORDS), "numeric_quantity")
        .when(numeric, "numeric_generic")
        .when(
            starts_with_any(t, fv.TEXT_TYPE_PREFIXES)
            & (last_word.isin(fv.ENUM_WORDS) | n.isin(fv.ENUM_WORDS)),
            "text_enum",
        )
        .otherwise("text_generic")
    )


def classify(catalog: DataFrame) -> DataFrame:
    """Catalog with ``column_group``, ``business_key`` and ``has_precision``."""
    group = column_group(F.col("name"), F.col("type"))
    return (
        catalog.withColumn("column_group", group)
        .withColumn(
            "business_key", (F.col("column_group") == "identifier") & ~F.col("nullable")
        )
        .withColumn(
            "has_precision",
            F.col("column_group").isin(NUMERIC_GROUPS)
            & (F.coalesce(F.col("scale"), F.lit(0)) > 0),
        )
    )


def select_checks(classified: DataFrame) -> DataFrame:
    """Checks each table needs, with the number and names of their columns.

    One grouping per table: the four basic checks always, the others when a column calls for
    them.  Names are in catalog order.
    """
    group = F.col("column_group")
    active = group != "skipped"
    wanted = {
        "row_count": F.lit(False),
        "data_validation": F.lit(False),
        "null_pct": active,
        "distinct_count": active,
        "min_max": group.isin(NUMERIC_GROUPS),
        "sum": group.isin("numeric_financial", "numeric_quantity"),
        "duplicate_check": F.col("business_key"),
        "value_distribution": group.isin("status_flag", "text_enum"),
    }
    part = F.struct(F.col("ordinal"), F.col("name"))
    wide = classified.groupBy("table").agg(
        *[F.collect_list(F.when(cond, part)).alias(check) for check, cond in wanted.items()]
    )
    rows = [
        F.struct(
            F.lit(i).alias("check_order"),
            F.lit(check).alias("check"),
            F.lit(i >= 4).alias("is_conditional"),
            F.size(check).alias("column_count"),
            F.array_join(
                F.transform(F.array_sort(check), lambda p: p["name"]), ","
            ).alias("columns"),
        )
        for i, check in enumerate(CHECKS)
    ]
    return wide.select("table", F.inline(F.array(*rows))).filter(
        ~F.col("is_conditional") | (F.col("column_count") > 0)
    )


def table_profile(classified: DataFrame) -> DataFrame:
    """Columns per semantic group, flags and business keys of every table."""
    group = F.col("column_group")
    counts = [F.count_if(group == g).alias(f"{g}_columns") for g in GROUPS]
    keys = F.collect_list(F.when(F.col("business_key"), F.struct("ordinal", "name")))
    return (
        classified.groupBy("table")
        .agg(F.count(F.lit(1)).alias("total_columns"), *counts, keys.alias("k"))
        .withColumn(
            "numeric_columns", F.col("numeric_financial_columns")
            + F.col("numeric_quantity_columns") + F.col("numeric_generic_columns")
        )
        .withColumn("has_financial", F.col("numeric_financial_columns") > 0)
        .withColumn("has_temporal", F.col("temporal_columns") > 0)
        .withColumn("has_identifiers", F.col("identifier_columns") > 0)
        .withColumn("has_enums", F.col("text_enum_columns") > 0)
        .withColumn("has_business_keys", F.size("k") > 0)
        .withColumn(
            "business_keys",
            F.array_join(F.transform(F.array_sort("k"), lambda p: p["name"]), ","),
        )
        .drop("k")
    )
