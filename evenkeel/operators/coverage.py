"""Column coverage: how much of a table a result speaks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel import fixed_values as fv
from evenkeel.functions.binding import filled
from evenkeel.functions.rounding import round_even


def _percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    share = F.lit(100.0) * part / whole
    shown = share if digits is None else round_even(share, digits).cast("double")
    return F.when(whole > 0, shown).otherwise(F.lit(0.0))


def column_coverage(mapping: DataFrame) -> DataFrame:
    """Validated share of the mapped source columns per table.

    ``mapping``: ``table, ordinal, source_column, target_column, skip, skip_reason``.  A column
    without a target counts as excluded.  ``total_columns`` counts mapped columns; columns
    that found no partner and are not in the mapping do not lower ``coverage_pct``, so
    ``unmatched_columns`` and ``coverage_incl_unmatched`` tell them apart when the mapping
    has them with ``skip`` unset.
    """
    skip = F.coalesce("skip", F.lit(False))
    loose = ~skip & F.col("target_column").isNull()
    active = ~skip & F.col("target_column").isNotNull()
    entry = F.struct(
        loose.alias("loose"),
        "ordinal",
        F.concat(
            "source_column", F.lit(" ("),
            F.when(skip, F.coalesce(F.nullif("skip_reason", F.lit("")),
                                    F.lit("no reason recorded")))
            .otherwise("no matching target column"),
            F.lit(")"),
        ).alias("text"),
    )
    counts = mapping.groupBy("table").agg(
        F.count_if(~loose).alias("total_columns"),
        F.count_if(active).alias("validated_columns"),
        F.count_if(skip | loose).alias("excluded_columns"),
        F.count_if(loose).alias("unmatched_columns"),
        F.collect_list(F.when(skip | loose, entry)).alias("e"),
    )
    total, done = F.col("total_columns"), F.col("validated_columns")
    return (
        counts.withColumn("coverage_pct", _percent(done, total))
        .withColumn(
            "coverage_incl_unmatched", _percent(done, total + F.col("unmatched_columns"))
        )
        .withColumn("is_low", F.col("coverage_pct") < fv.LOW_COVERAGE_PCT)
        .withColumn(
            "excluded_detail",
            F.array_join(F.transform(F.array_sort("e"), lambda x: x["text"]), ", "),
        )
        .drop("e")
    )


def headline(coverage: DataFrame) -> DataFrame:
    """``v of t columns validated (p%) — n excluded: …`` per table."""
    base = F.concat(
        F.col("validated_columns").cast("string"), F.lit(" of "),
        F.col("total_columns").cast("string"), F.lit(" columns validated ("),
        F.format_string("%.1f", F.col("coverage_pct")), F.lit("%)"),
    )
    return coverage.withColumn(
        "headline",
        F.when(F.col("excluded_columns") == 0, F.concat(base, F.lit(" — no exclusions")))
        .otherwise(
            F.concat(
                base, F.lit(" — "), F.col("excluded_columns").cast("string"),
                F.lit(" excluded: "), "excluded_detail",
            )
        ),
    )


def batch_coverage(coverage: DataFrame) -> DataFrame:
    """Coverage over all tables, with the number of low tables."""
    return coverage.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("total_columns"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum("validated_columns"), F.lit(0)).alias("validated_columns"),
        F.count_if(F.col("is_low")).alias("low_tables"),
    ).withColumn(
        "coverage_pct", _percent(F.col("validated_columns"), F.col("total_columns"))
    )


def low_coverage_tables(coverage: DataFrame) -> DataFrame:
    return coverage.filter(F.col("is_low")).select("table", "coverage_pct").orderBy(
        "coverage_pct", "table"
    )


def two_sided_coverage(presence: DataFrame) -> DataFrame:
    """Source, target and overall coverage per table from a schema presence result."""
    kind = F.col("presence")
    matched, excluded = kind == "matched", kind == "excluded"
    source_only, target_only = kind == "source_only", kind == "target_only"
    category = F.col("category")
    counts = presence.groupBy("table").agg(
        F.count_if(matched | excluded | source_only).alias("source_columns"),
        F.count_if(matched | excluded | target_only).alias("target_columns"),
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(matched).alias("matched_columns"),
        F.count_if(excluded).alias("excluded_matched"),
        F.count_if(source_only).alias("source_only"),
        F.count_if(target_only).alias("target_only"),
        F.count_if(target_only & (category == "Audit Column")).alias("audit_columns"),
        F.count_if(target_only & (category == "Data Enrichment")).alias("enrichment_columns"),
    )
    done = F.col("matched_columns")
    return (
        counts.withColumn("source_coverage", _percent(done, F.col("source_columns"), None))
        .withColumn("target_coverage", _percent(done, F.col("target_columns"), None))
        .withColumn("overall_coverage", _percent(done, F.col("total_columns"), None))
    )


def schema_health(coverage: DataFrame) -> DataFrame:
    """Warnings and recommendations per table, as arrays of text.

    ``coverage`` is the output of :func:`two_sided_coverage`.
    """
    gone = F.col("source_only") + F.col("target_only") + F.col("excluded_matched")
    rate = _percent(gone, F.col("total_columns"), None)
    low = F.col("overall_coverage") < fv.LOW_COVERAGE_PCT

    def when(condition: Column, template: str, **values: Column) -> Column:
        return F.when(condition, filled(template, **values))

    source_only, target_only = F.col("source_only"), F.col("target_only")
    audit, enrichment = F.col("audit_columns"), F.col("enrichment_columns")
    total, overall = F.col("total_columns"), round_even(F.col("overall_coverage"), 1)
    warnings = [
        when(low, fv.WARN_LOW_COVERAGE, pct=overall, matched=F.col("matched_columns"), total=total),
        when(target_only > 0, fv.WARN_TARGET_ONLY, n=target_only),
        when(source_only > 0, fv.WARN_SOURCE_ONLY, n=source_only),
        when(rate > fv.HIGH_EXCLUSION_PCT, fv.WARN_HIGH_EXCLUSION, pct=round_even(rate, 1), n=gone, total=total),
    ]
    advice = [
        when(audit > 0, fv.DOCUMENT_AUDIT, n=audit),
        when(enrichment > 0, fv.DOCUMENT_ENRICHMENT, n=enrichment),
        when(target_only > 0, fv.GENERATE_RULES, table=F.col("table")),
        when(source_only > 0, fv.REVIEW_SOURCE_ONLY, n=source_only),
        when(low, fv.RAISE_COVERAGE),
    ]
    return coverage.select(
        "table", "overall_coverage", low.alias("is_low"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
        F.array_compact(F.array(*advice)).alias("recommendations"),
    )
