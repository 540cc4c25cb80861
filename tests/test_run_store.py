"""A stored run: restart, time limits, mismatches and reports."""

import time

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import coverage, policy
from evenkeel.plans import run_store as rs
from evenkeel.plans.runs import TableTask
from evenkeel.suite import fixtures as fx
from evenkeel.suite.queries import RENAMED

SF = "/root/testdata/sf0.001"


class Counting(TableTask):
    """A task that counts how often it is read, and may stop the run or take its time."""

    def sides(self, spark):
        self.reads = getattr(self, "reads", 0) + 1
        if getattr(self, "stops", False):
            raise SystemExit("the driver is stopped")
        return super().sides(spark)


def _tasks(spark):
    customer = fx.read(spark, SF, "customer")
    return [
        Counting("customer", customer, fx.derive(spark, SF, fx.CUSTOMER_TARGET), ["c_custkey"]),
        Counting("orders", fx.read(spark, SF, "orders"), fx.derive(spark, SF, fx.ORDERS_TARGET),
                 ["o_orderkey"], RENAMED),
        Counting("part/odd name", fx.read(spark, SF, "part"), fx.read(spark, SF, "part"),
                 validation_type="count_validation"),
        Counting("part/odd name", fx.read(spark, SF, "part"), fx.read(spark, SF, "part"), ["p_partkey"]),
        Counting("ghost", {"path": f"{SF}/none.parquet"}, {"path": f"{SF}/none.parquet"}, ["k"]),
    ]


def _status(store):
    return [(r["table"], r["validation_type"], r["status"]) for r in store.results().collect()]


WHOLE = [
    ("customer", "data_validation", "PASS"), ("orders", "data_validation", "FAIL"),
    ("part/odd name", "count_validation", "PASS"), ("part/odd name", "data_validation", "PASS"),
    ("ghost", "data_validation", "ERROR"),
]


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    path = f"file://{tmp_path}"
    tasks = _tasks(spark)
    tasks[2].stops = True
    with pytest.raises(SystemExit):
        rs.run_stored(spark, tasks, path, "r 1", at_once=1)
    store = rs.RunStore(spark, path, "r 1")
    assert _status(store) == WHOLE[:2]
    again = _tasks(spark)
    assert _status(rs.run_stored(spark, again, path, "r 1")) == WHOLE
    assert [getattr(t, "reads", 0) for t in again] == [0, 0, 1, 1, 1]
    # only errors are tried again
    third = _tasks(spark)
    store = rs.run_stored(spark, third, path, "r 1")
    assert [getattr(t, "reads", 0) for t in third] == [0, 0, 0, 0, 1]
    attempts = [r["attempt"] for r in store.results().collect()]
    assert attempts == [1, 1, 1, 1, 2]
    assert rs.RunStore(spark, path, "other").results().count() == 0


def test_a_table_over_its_time_is_an_error_and_the_others_go_on(spark, tmp_path):
    slow = F.udf(lambda k: time.sleep(0.5) or k, "long")
    part = fx.read(spark, SF, "part").repartition(2)
    tasks = [
        TableTask("slow", part.withColumn("p_partkey", slow("p_partkey")), part, ["p_partkey"]),
        TableTask("quick", part, part, validation_type="count_validation"),
    ]
    began = time.monotonic()
    store = rs.run_stored(spark, tasks, f"file://{tmp_path}", "limits", limit=15)
    rows = {r["table"]: r for r in store.results().collect()}
    assert rows["slow"]["status"] == "ERROR" and "longer than 15 seconds" in rows["slow"]["error"]
    assert rows["quick"]["status"] == "PASS"
    assert time.monotonic() - began < 45
    assert len(spark.sparkContext.getJobTags()) == 0


def test_mismatches_and_reports_are_stored(spark, tmp_path):
    tasks = _tasks(spark)
    store = rs.run_stored(spark, tasks, f"file://{tmp_path}", "full", mismatches=True, pool="checks")
    found = store.mismatches(tasks[1])
    counts = {r["row_status"]: r["n"] for r in found.groupBy("row_status").agg(
        F.count("*").alias("n")).collect()}
    row = store.results().filter("table = 'orders'").first()
    assert counts["MISSING_IN_TARGET"] == row["missing_in_target"] > 0
    assert counts["VALUE_MISMATCH"] == row["value_mismatches"] > 0
    skips = policy.skip_counts(policy.classify_skips(fx.derive(spark, SF, fx.RUN_SKIPS)))
    covered = coverage.column_coverage(fx.derive(spark, SF, fx.MAPPING))
    status = rs.write_report(store, covered, skips).first()
    assert (status["total"], status["pass_count"], status["error_count"], status["verdict"]) == (5, 2, 1, "FAIL")
    assert status["promoted_count"] == 1
    assert store.report("count_validation").count() == 1
    assert store.report("data_validation").count() == 4
    report = {r["table"]: r for r in store.report("coverage").collect()}
    assert report["customer"]["original_status"] == "PASS"
    assert report["customer"]["effective_status"] == "FAIL"
