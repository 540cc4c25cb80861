"""A run that outlives its driver: results are stored table by table, and a restart does the rest.

Every table of a run has a directory of its own below ``<path>/run=<id>/``, written when the table is
done.  So tables that run at the same time never commit to one directory, a table that is done twice
is stored once, and what a stopped run has finished is read, not computed again.

``results/``     one row per table: the result, when it ran and for how long
``mismatches/``  the differing rows of a keyed table that failed
``report/``      count summary, data summary, coverage and status of the whole run, at its end

Each table's jobs carry a tag of their own; a table that takes longer than ``limit`` seconds has its
jobs cancelled and is an ERROR.  With ``pool`` its jobs share the cluster with other pools under
fair scheduling.
"""

from __future__ import annotations

import datetime
import threading
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenkeel.operators.policy import promote
from evenkeel.operators.projection import pair_columns
from evenkeel.operators.reconcile import ledger, row_diff
from evenkeel.plans.runs import (
    TableTask, _error_values, skip_report, status_counts, summary, table_result,
)
from evenkeel.schema import RESULT_SCHEMA

STORED_SCHEMA = T.StructType(
    [
        T.StructField("table_no", T.IntegerType()),
        *RESULT_SCHEMA.fields,
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class RunStore:
    """Where the results of one run lie."""

    spark: SparkSession
    path: str
    run_id: str

    @property
    def folder(self) -> str:
        return f"{self.path}/run={quote(self.run_id, safe='')}"

    def of(self, what: str, task: TableTask) -> str:
        name = f"{quote(task.table, safe='')}.{quote(task.validation_type, safe='')}"
        return f"{self.folder}/{what}/{name}"

    def results(self) -> DataFrame:
        """What is finished so far, in the order of the tasks."""
        try:
            found = self.spark.read.schema(STORED_SCHEMA).parquet(f"{self.folder}/results/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED_SCHEMA)
        return found.orderBy("table_no")

    def write(self, task: TableTask, row: tuple) -> None:
        one = self.spark.createDataFrame([row], STORED_SCHEMA)
        one.coalesce(1).write.mode("overwrite").parquet(self.of("results", task))

    def mismatches(self, task: TableTask) -> DataFrame:
        return self.spark.read.parquet(self.of("mismatches", task))

    def report(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/report/{name}")


class _Limit:
    """Cancels the jobs of a tag when their time is up."""

    def __init__(self, spark: SparkSession, tag: str, seconds: float | None) -> None:
        self.over = False
        # tags of the context, because those of a session are known to the thread that set them only
        self.context, self.tag = spark.sparkContext, tag
        self.timer = threading.Timer(seconds, self._end) if seconds else None

    def _end(self) -> None:
        self.over = True
        self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> "_Limit":
        self.context.addJobTag(self.tag)
        if self.timer:
            self.timer.daemon = True
            self.timer.start()
        return self

    def __exit__(self, *_) -> None:
        if self.timer:
            self.timer.cancel()
        self.context.removeJobTag(self.tag)


def _keep_mismatches(store: RunStore, task: TableTask) -> None:
    source, target = task.sides(store.spark)
    pairs = pair_columns(
        source, target, task.renamed, task.excluded, task.rules, task.decimal_places, task.by_contents
    )
    found = row_diff(ledger(source, target, pairs, task.keys), task.keys)
    found.write.mode("overwrite").parquet(store.of("mismatches", task))


def run_stored(
    spark: SparkSession,
    tasks: Iterable[TableTask],
    path: str,
    run_id: str,
    at_once: int = 4,
    limit: float | None = None,
    pool: str | None = None,
    mismatches: bool = False,
    redo: tuple[str, ...] = ("ERROR",),
) -> RunStore:
    """Run the tasks that the store has no result of, or one with a status in ``redo``.

    Results are stored as their tables finish; nothing is kept for the end.  A failure that is not
    the table's own (the driver is stopped, the store cannot be written) ends the run and leaves what
    is finished; calling again with the same ``run_id`` goes on from there.
    """
    store = RunStore(spark, path, run_id)
    tasks = list(tasks)
    stored = store.results().select("table", "validation_type", "status", "attempt").collect()
    before = {(r["table"], r["validation_type"]): r for r in stored}

    def one(number: int, task: TableTask) -> None:
        old = before.get((task.table, task.validation_type))
        attempt = 1 + (old["attempt"] if old else 0)
        started = datetime.datetime.now()
        if pool:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        tag = f"evenkeel-{quote(run_id, safe='')}-{number}-{time.monotonic_ns()}"
        with _Limit(spark, tag, limit) as time_limit:
            try:
                row = tuple(table_result(spark, task).first())
                failed = row[RESULT_SCHEMA.names.index("status")] == "FAIL"
                if mismatches and task.keys and failed and task.validation_type != "count_validation":
                    _keep_mismatches(store, task)
            except Exception as e:  # reported as the status of this table
                over = TimeoutError(f"took longer than {limit} seconds")
                row = _error_values(task, over if time_limit.over else e)
        store.write(task, (number, *row, started, datetime.datetime.now(), attempt))

    failures: list[BaseException] = []

    def isolated(number: int, task: TableTask) -> None:
        # a thread of its own, so that tags and pool stay with this table's jobs
        def run() -> None:
            try:
                one(number, task)
            except BaseException as e:  # noqa: BLE001 - raised again below, in the caller's thread
                failures.append(e)

        thread = InheritableThread(target=run)
        thread.start()
        thread.join()

    left = [
        (i, t) for i, t in enumerate(tasks)
        if (old := before.get((t.table, t.validation_type))) is None or old["status"] in redo
    ]
    with ThreadPoolExecutor(max_workers=at_once) as workers:
        for number, task in left:
            workers.submit(lambda n=number, t=task: None if failures else isolated(n, t))
    if failures:
        raise failures[0]
    return store


def write_report(
    store: RunStore, coverage: DataFrame | None = None, skips: DataFrame | None = None,
) -> DataFrame:
    """Summaries, coverage and status of the run as tables below ``report/``; the status row is returned.

    ``coverage`` is the output of ``coverage.column_coverage``, ``skips`` of ``policy.skip_counts``.
    """
    results = store.results()
    spans = results.agg(F.min("started_at"), F.max("ended_at")).first()
    began, ended = (t or datetime.datetime.now() for t in spans)
    if skips is not None:
        results = promote(results, skips)
    tables = {
        kind: summary(results, kind, store.run_id, began, ended, output_file_path=store.folder)
        for kind in ("count_validation", "data_validation")
    }
    tables["status"] = status_counts(results)
    if coverage is not None and skips is not None:
        tables["coverage"] = skip_report(results, coverage, skips)
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{store.folder}/report/{name}")
    return store.report("status")
