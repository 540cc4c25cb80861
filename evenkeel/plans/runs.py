"""Validation runs over many tables and their result tables."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evenkeel.operators.keys import common_key
from evenkeel.operators.metrics import count_check
from evenkeel.operators.policy import promote
from evenkeel.operators.presence import presence_failures
from evenkeel.operators.projection import (
    active_rows, load_window, pair_columns, uncompared_columns,
)
from evenkeel.operators.reconcile import diff_counts, ledger, same_rows
from evenkeel.sources.readers import load
from evenkeel.schema import RESULT_SCHEMA, schema

COUNT_SUMMARY = schema(
    "run_id string, run_at string, validation_performed string, source_table_name string, "
    "source_type string, target_table_name string, target_type string, source_count bigint, "
    "target_count bigint, count_difference bigint, status string, batch_start_time string, "
    "batch_end_time string, total_time_taken string"
)
DATA_SUMMARY = schema(
    "run_id string, run_at string, validation_performed string, source_table_name string, "
    "source_type string, target_table_name string, target_type string, source_count bigint, "
    "missing_in_source bigint, target_count bigint, missing_in_target bigint, "
    "value_mismatches bigint, duplicate_keys bigint, status string, output_file_path string, "
    "batch_start_time string, batch_end_time string, total_time_taken string"
)


@dataclass
class TableTask:
    """One table pair of a run.  ``source`` and ``target`` are read specs or DataFrames."""

    table: str
    source: DataFrame | dict
    target: DataFrame | dict
    keys: list[str] = field(default_factory=list)
    renamed: dict[str, str] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)
    decimal_places: dict[str, int] = field(default_factory=dict)
    load_type: str = "historical"
    window: tuple[str, str, object, object] | None = None
    validation_type: str = "data_validation"
    needs_keys: bool = False
    # look for a key in the data where none is named
    find_keys: bool = False
    # compare text columns that are named for JSON or hstore by their contents
    by_contents: bool = False
    source_type: str = "parquet"
    target_type: str = "parquet"

    def sides(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Both sides with row filters applied on raw columns."""
        source = load(spark, self.source) if isinstance(self.source, dict) else self.source
        target = load(spark, self.target) if isinstance(self.target, dict) else self.target
        target = active_rows(target)
        if self.needs_keys and not self.keys and not self.find_keys:
            raise ValueError("data validation needs a key")
        if self.load_type.strip().lower() == "incremental" and not self.window:
            raise ValueError("an incremental load needs a window")
        if self.window:
            source_column, target_column, low, high = self.window
            source = load_window(source, self.load_type, source_column, low, high)
            target = load_window(target, self.load_type, target_column, low, high)
        return source, target


def table_result(spark: SparkSession, task: TableTask) -> DataFrame:
    """One lazy result row.

    ``mode`` says what the status rests on: ``count`` (row counts), ``keyed`` (rows by key) or
    ``multiset`` (data validation without keys: whole rows, as often as they occur).
    ``uncompared_columns`` names what the status does not speak for, and why.
    """
    source, target = task.sides(spark)
    columns = {"table": F.lit(task.table), "validation_type": F.lit(task.validation_type)}
    if task.validation_type == "count_validation":
        found = count_check(source, target)
        columns["mode"] = F.lit("count")
        return _fit(found.withColumns(columns), RESULT_SCHEMA)
    pairs = pair_columns(
        source, target, task.renamed, task.excluded, task.rules, task.decimal_places, task.by_contents
    )
    if not pairs:
        raise ValueError("no column of the source has a partner in the target")
    keys = task.keys or (common_key(source, target, pairs) if task.find_keys else [])
    if task.needs_keys and not keys:
        raise ValueError("data validation needs a key, and none was found")
    if keys:
        found = diff_counts(ledger(source, target, pairs, keys))
    else:
        # rows that only one side holds, or holds more often
        found = same_rows(source, target, pairs).withColumnsRenamed(
            {"source_surplus": "missing_in_target", "target_surplus": "missing_in_source"}
        ).withColumns({
            "source_count": source.agg(F.count(F.lit(1))).scalar(),
            "target_count": target.agg(F.count(F.lit(1))).scalar(),
        })
    left_out = uncompared_columns(source, target, pairs, task.excluded)
    columns |= {
        "mode": F.lit("keyed" if keys else "multiset"),
        "compared_columns": F.lit(len(pairs)),
        "uncompared_columns": F.lit("; ".join(f"{s}.{c}: {why}" for s, c, why in left_out)),
    }
    return _fit(found.withColumns(columns), RESULT_SCHEMA)


def _fit(frame: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(frame.columns)
    return frame.selectExpr(
        *[
            f"cast({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()})"
            f" AS `{f.name}`"
            for f in schema.fields
        ]
    )


def batch_results(spark: SparkSession, tasks: Iterable[TableTask]) -> DataFrame:
    """Result rows of all tasks as one lazy DataFrame.

    A task that cannot be planned (absent file, absent key) is an ERROR row and does not stop
    the others.  Failures while running stop the action; :func:`run_batch` isolates them too.
    """
    results = None
    for task in tasks:
        try:
            row = table_result(spark, task)
        except Exception as e:  # reported as the status of this table
            row = _error_row(spark, task, e)
        results = row if results is None else results.unionByName(row)
    return results if results is not None else spark.createDataFrame([], RESULT_SCHEMA)


def run_batch(spark: SparkSession, tasks: Iterable[TableTask], at_once: int = 4) -> DataFrame:
    """Run the tasks, each isolated, `at_once` of them at a time so that the cluster stays busy.

    Only the one-row results reach the driver, in the order of the tasks.
    """

    def one(task: TableTask) -> list:
        try:
            return table_result(spark, task).collect()
        except Exception as e:  # reported as the status of this table
            return [_error_values(task, e)]

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        rows = [tuple(r) for found in pool.map(one, tasks) for r in found]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _error_row(spark: SparkSession, task: TableTask, error: Exception) -> DataFrame:
    return spark.createDataFrame([_error_values(task, error)], RESULT_SCHEMA)


def _error_values(task: TableTask, error: Exception) -> tuple:
    message = str(error).strip().splitlines()[0] if str(error).strip() else repr(error)
    known = {
        "table": task.table, "validation_type": task.validation_type, "status": "ERROR",
        "error": message,
    }
    return tuple(known.get(name) for name in RESULT_SCHEMA.names)


def full_run(
    spark: SparkSession,
    tasks: Iterable[TableTask],
    presence: DataFrame,
    skips: DataFrame | None = None,
    at_once: int = 4,
) -> DataFrame:
    """One run from end to end: the tasks are run, missing tables stand as FAIL rows under their
    results, and unjustified skips promote a PASS.

    ``presence``: :func:`evenkeel.operators.presence.table_presence`; ``skips``: output of
    ``policy.skip_counts``.  :func:`status_counts`, :func:`skip_report` and :func:`summary` take the
    result.
    """
    results = run_batch(spark, tasks, at_once).unionByName(presence_failures(presence))
    return results if skips is None else promote(results, skips)


def tasks_from_control(control_rows: Iterable[T.Row], fmt: str, base: str) -> list[TableTask]:
    """Tasks from the active rows of a control table over files ``base/<schema>/<table>``.

    Optional fields of a row: ``primary_key`` (comma separated), ``source_column``,
    ``target_column``, ``window_start`` and ``window_end`` for incremental loads,
    ``source_query`` and ``target_query`` (SQL over the side's rows, ``{rows}``).
    What a row asks for and lacks (a window, a key) makes its table an ERROR, never a pass.
    """

    def side(row: dict, which: str) -> dict:
        spec = {"format": fmt, "path": f"{base}/{row[which + '_schema']}/{row[which + '_table']}"}
        return spec | ({"query": row[which + "_query"]} if row.get(which + "_query") else {})

    def task(row: dict) -> TableTask:
        kind = row.get("validation_type") or "count_validation"
        window = None
        if row.get("window_start") is not None and row.get("window_end") is not None:
            column = row.get("source_column")
            window = (column, row.get("target_column") or column, row["window_start"],
                      row["window_end"])
        keys = [k.strip() for k in (row.get("primary_key") or "").split(",") if k.strip()]
        return TableTask(
            table=row["table_name"], source=side(row, "source"), target=side(row, "target"),
            keys=keys, window=window, load_type=row.get("load_type") or "historical",
            validation_type=kind, needs_keys=kind == "data_validation",
        )

    return [task(r.asDict() if isinstance(r, T.Row) else dict(r)) for r in control_rows]


def summary(
    results: DataFrame,
    kind: str,
    run_id: str,
    started: datetime.datetime,
    ended: datetime.datetime,
    source_type: str = "parquet",
    target_type: str = "parquet",
    output_file_path: str = "",
) -> DataFrame:
    """Count or data summary rows of a run; the times are those of the driver."""
    schema = COUNT_SUMMARY if kind == "count_validation" else DATA_SUMMARY
    constants: dict[str, Column] = {
        "run_id": F.lit(run_id),
        "run_at": F.lit(started.isoformat(sep=" ", timespec="seconds")),
        "validation_performed": F.lit(kind),
        "source_table_name": F.col("table"),
        "target_table_name": F.col("table"),
        "source_type": F.lit(source_type),
        "target_type": F.lit(target_type),
        "output_file_path": F.lit(output_file_path),
        "batch_start_time": F.lit(started.isoformat(sep=" ", timespec="seconds")),
        "batch_end_time": F.lit(ended.isoformat(sep=" ", timespec="seconds")),
        "total_time_taken": F.lit(f"{(ended - started).total_seconds():.2f}s"),
    }
    rows = results.filter(F.col("validation_type") == kind)
    return _fit(rows.withColumns(constants), schema)


def status_counts(results: DataFrame) -> DataFrame:
    """PASS, FAIL and ERROR counts, promotions and the verdict of a run.

    ``results`` has ``status`` and, after promotion, ``original_status``.
    """
    status = F.col("status")
    if "original_status" in results.columns:
        promoted = (F.col("original_status") == "PASS") & (status == "FAIL")
    else:
        promoted = F.lit(False)
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "PASS").alias("pass_count"),
        F.count_if(status == "FAIL").alias("fail_count"),
        F.count_if(status == "ERROR").alias("error_count"),
        F.count_if(promoted).alias("promoted_count"),
    ).withColumn(
        "verdict",
        F.when(F.col("fail_count") + F.col("error_count") > 0, "FAIL").otherwise("PASS"),
    )


def skip_report(results: DataFrame, coverage: DataFrame, skips: DataFrame) -> DataFrame:
    """Per table: original and effective status, coverage and skips by verdict.

    Results that were promoted already (:func:`full_run`) keep the status from before.  A table without a plan has UNKNOWN coverage, never full coverage.
    """
    planned = coverage.select("table", "total_columns", "validated_columns", "coverage_pct")
    joined = results.join(planned, ["table"], "left").join(skips, ["table"], "left")
    known = F.col("total_columns").isNotNull()
    unjustified = F.coalesce("unjustified_skips", F.lit(0))
    before = "original_status" if "original_status" in results.columns else "status"

    def count(name: str) -> Column:
        return F.when(known, F.coalesce(name, F.lit(0))).alias(name)

    return joined.select(
        "table",
        F.coalesce(before, "status").alias("original_status"),
        F.when((F.col("status") == "PASS") & (unjustified > 0), "FAIL")
        .otherwise(F.col("status"))
        .alias("effective_status"),
        "validated_columns",
        "total_columns",
        count("justified_skips"),
        count("unjustified_skips"),
        count("warn_only_skips"),
        F.when(known, F.format_string("%.1f", F.col("coverage_pct"))).otherwise("UNKNOWN").alias(
            "coverage"
        ),
    )
