"""The mapping plan: one row per source column, its checks, status and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel import fixed_values as fv
from evenkeel.plans.rules import RuleBook
from evenkeel.schema import schema

MAPPING_SCHEMA = schema(
    "layer string, table string, ordinal int, source_column string, source_type string, "
    "target_column string, target_type string, match_method string, fuzzy_score double, "
    "confidence double, decision string, needs_review boolean, skip boolean, "
    "skip_reason string, reason string, rule string, is_key boolean, key_ordinal int"
)


def build_mapping(
    decisions: DataFrame,
    layer: str = "bronze",
    source_keys: DataFrame | None = None,
    book: RuleBook | None = None,
) -> DataFrame:
    """Plan rows from match decisions: adds the rule of every pair and the key columns.

    ``source_keys``: ``table, name, key_ordinal``.
    """
    book = book or RuleBook()
    rows = decisions.withColumn("layer", F.lit(layer)).withColumn(
        "rule",
        F.when(
            F.col("target_column").isNotNull(),
            book.assign(F.col("source_type"), F.col("target_type")),
        ).otherwise("text"),
    )
    if source_keys is None:
        rows = rows.withColumn("key_ordinal", F.lit(None).cast("int"))
    else:
        keys = source_keys.select("table", F.upper("name").alias("u_name"), "key_ordinal")
        rows = rows.withColumn("u_name", F.upper("source_column")).join(
            keys, ["table", "u_name"], "left"
        )
    rows = rows.withColumn("is_key", F.col("key_ordinal").isNotNull())
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in MAPPING_SCHEMA.fields])


def plan_status(mapping: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """``ambiguous`` over ``partial`` (an unmatched column) over ``complete``.

    ``ambiguous``: ``table, column_name``.  Load-metadata columns never make a plan partial.
    """
    is_metadata = F.lower("source_column").startswith(fv.LOAD_METADATA_PREFIX)
    loose = (F.coalesce("skip", F.lit(False)) | F.col("target_column").isNull()) & ~is_metadata
    rows = mapping.groupBy("table").agg(F.count_if(loose).alias("unmatched"))
    if ambiguous is None:
        rows = rows.withColumn("ambiguities", F.lit(0).cast("long"))
    else:
        counts = ambiguous.groupBy("table").agg(F.count(F.lit(1)).alias("ambiguities"))
        rows = rows.join(counts, ["table"], "left").withColumn(
            "ambiguities", F.coalesce("ambiguities", F.lit(0).cast("long"))
        )
    return rows.withColumn(
        "plan_status",
        F.when(F.col("ambiguities") > 0, "ambiguous")
        .when(F.col("unmatched") > 0, "partial")
        .otherwise("complete"),
    )


def plan_statistics(mapping: DataFrame) -> DataFrame:
    """Active, skipped, exact, fuzzy, reviewed and unmatched columns per table."""
    skip = F.coalesce("skip", F.lit(False))
    active = ~skip & F.col("target_column").isNotNull()
    method = F.col("match_method")
    return mapping.groupBy("table").agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(active).alias("active_columns"),
        F.count_if(skip).alias("skipped_columns"),
        F.count_if(active & method.isin("exact", "normalized_exact", "configured")).alias(
            "exact_columns"
        ),
        F.count_if(active & (method == "fuzzy")).alias("fuzzy_columns"),
        F.count_if(active & F.coalesce("needs_review", F.lit(False))).alias("review_columns"),
        F.count_if(F.col("decision") == "unmatched").alias("unmatched_columns"),
    )


def check_plans(
    header: DataFrame,
    mapping: DataFrame,
    ambiguous: DataFrame | None = None,
    book: RuleBook | None = None,
) -> DataFrame:
    """Issues and warnings of every plan; a plan with an issue is invalid.

    ``header``: ``table, source_schema, source_table, target_table, status``.
    """
    known = [r.name for r in (book or RuleBook()).rules]
    skip = F.coalesce("skip", F.lit(False))
    rule = F.lower(F.coalesce("rule", F.lit("")))
    source, target = (F.coalesce(c, F.lit("")) for c in ("source_column", "target_column"))
    rows = mapping.withColumn("active", ~skip & F.col("target_column").isNotNull())

    def repeated(side: str) -> DataFrame:
        """Columns of one side that occur in several active rows."""
        return (
            rows.filter("active")
            .groupBy("table", F.upper(side).alias("column"))
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1)
            .groupBy("table")
            .agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias(f"dup_{side}"))
        )

    def names(condition: Column) -> Column:
        hit = F.when(F.col("active") & condition, F.col("source_column"))
        return F.array_join(F.array_sort(F.collect_list(hit)), ", ")

    is_metadata = F.lower("source_column").startswith(fv.LOAD_METADATA_PREFIX)
    loose = ~F.col("active") & ~is_metadata
    per_table = rows.groupBy("table").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("active").alias("active_n"),
        F.count_if(loose).alias("unmatched_n"),
        F.count_if(F.col("active") & (F.trim(source) == "")).alias("empty_source"),
        F.count_if(F.col("active") & (F.trim(target) == "")).alias("empty_target"),
        names(rule == "").alias("no_rule"),
        names((rule != "") & ~rule.isin(known)).alias("other_rule"),
        names(~F.col("confidence").between(0.0, 1.0)).alias("odd_confidence"),
    )
    doubt = (
        rows.sparkSession.createDataFrame([], "table string, doubt long")
        if ambiguous is None
        else ambiguous.groupBy("table").agg(F.count(F.lit(1)).alias("doubt"))
    )
    facts = (
        header.join(per_table, ["table"], "left")
        .join(repeated("source_column"), ["table"], "left")
        .join(repeated("target_column"), ["table"], "left")
        .join(doubt, ["table"], "left")
    )

    def empty(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    def listed(prefix: str, name: str) -> Column:
        return F.when(
            F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(prefix), F.col(name))
        )

    share = F.lit(100.0) * F.col("unmatched_n") / F.greatest("total", F.lit(1))
    counted = F.concat(
        F.col("unmatched_n").cast("string"), F.lit(" of "), F.col("total").cast("string"),
        F.lit(" source columns are unmatched"),
    )
    issues = [
        F.when(empty("source_table"), F.lit("source_table is empty")),
        F.when(empty("target_table"), F.lit("target_table is empty")),
        F.when(empty("source_schema"), F.lit("source_schema is empty")),
        F.when(F.coalesce("active_n", F.lit(0)) == 0, F.lit("no active column mappings")),
        F.when(F.col("empty_source") > 0, F.lit("a mapping has an empty source column")),
        F.when(F.col("empty_target") > 0, F.lit("a mapping has an empty target column")),
        listed("duplicate source column: ", "dup_source_column"),
        listed("no rule assigned: ", "no_rule"),
        F.when(F.lower("status") == "invalid", F.lit("plan was marked invalid before")),
        F.when(share > 50.0, counted),
    ]
    warnings = [
        listed("target column used more than once: ", "dup_target_column"),
        listed("unknown rule, text is used: ", "other_rule"),
        listed("confidence outside [0, 1]: ", "odd_confidence"),
        F.when(F.col("doubt") > 0,
               F.concat(F.col("doubt").cast("string"), F.lit(" ambiguous column(s)"))),
        F.when((share <= 50.0) & (F.col("unmatched_n") > 0), counted),
    ]
    return facts.select(
        "table",
        F.array_compact(F.array(*issues)).alias("issues"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    ).withColumn("is_valid", F.size("issues") == 0)
