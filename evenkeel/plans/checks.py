"""Running what the check selection and the mapping plan ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel.operators import metrics
from evenkeel.operators.projection import ColumnPair


def run_checks(frame: DataFrame, checks: DataFrame, table: str) -> DataFrame:
    """Run a table's selected checks: ``table, check, column_name, detail, value``.

    ``checks`` comes from ``classify.select_checks``.  Row count, NULL shares, extremes and sums come
    from one scan; distinct counts, duplicate keys and value distributions are one grouping each.
    Only the names of the table's columns reach the driver.
    """
    wanted = {
        r["check"]: [c for c in r["columns"].split(",") if c]
        for r in checks.filter(F.col("table") == table).select("check", "columns").collect()
    }
    if not wanted:
        raise ValueError(f"no checks were selected for table {table!r}")
    nothing = F.lit(None).cast("string")
    kinds = {"min": "min_max", "max": "min_max"}
    facts = metrics.column_metrics(
        frame, nulls=wanted.get("null_pct", []), extremes=wanted.get("min_max", []),
        sums=wanted.get("sum", []),
    )
    found = facts.select(
        F.coalesce(*[F.when(F.col("metric") == m, F.lit(c)) for m, c in kinds.items()], "metric")
        .alias("check"),
        "column_name", F.when(F.col("metric").isin(*kinds), F.col("metric")).alias("detail"),
        F.coalesce(F.col("value").cast("double"), F.col("double_value")).alias("value"),
    )
    if wanted.get("distinct_count"):
        found = found.unionByName(metrics.distinct_count(frame, wanted["distinct_count"]).select(
            F.lit("distinct_count").alias("check"), "column_name", nothing.alias("detail"),
            F.col("distinct_count").cast("double").alias("value"),
        ))
    if wanted.get("duplicate_check"):
        keys = wanted["duplicate_check"]
        found = found.unionByName(
            metrics.duplicate_keys(frame, keys, ordered=False)
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
            .select(F.lit("duplicate_check").alias("check"),
                    F.lit(",".join(keys)).alias("column_name"), nothing.alias("detail"), "value")
        )
    if wanted.get("value_distribution"):
        found = found.unionByName(
            metrics.value_distribution(frame, wanted["value_distribution"]).select(
                F.lit("value_distribution").alias("check"), "column_name",
                F.col("value").alias("detail"), F.col("value_count").cast("double").alias("value"),
            )
        )
    return found.select(F.lit(table).alias("table"), "*")


def planned_pairs(mapping: DataFrame, table: str) -> tuple[list[ColumnPair], list[str]]:
    """Compared columns and key columns of one table as its mapping plan has them.

    Skipped and unmatched rows are left out, the plan's rule renders each pair.  A plan is as long
    as the table's schema.
    """
    rows = (
        mapping.filter((F.col("table") == table) & F.col("target_column").isNotNull())
        .filter(~F.coalesce("skip", F.lit(False)))
        .select("ordinal", "source_column", "target_column", "rule", "key_ordinal")
        .collect()
    )
    rows.sort(key=lambda r: r["ordinal"])
    pairs = [ColumnPair(r["source_column"], r["target_column"], r["rule"] or "text") for r in rows]
    keys = sorted((r for r in rows if r["key_ordinal"] is not None), key=lambda r: r["key_ordinal"])
    return pairs, [r["source_column"] for r in keys]
