"""Stored sketches, distributed row numbers, pruned windows and rejected patterns."""

import datetime
import random

from pyspark.sql import functions as F

from evenkeel.operators import metrics, numbering, policy, sketches, usage
from evenkeel.sources import folders, sinks
from evenkeel.suite import fixtures as fx

SF = "/root/testdata/sf0.001"


def _close(estimate, exact):
    return abs(estimate - exact) <= 4 * sketches.standard_error() * exact


def test_a_new_partition_reads_only_itself(spark, tmp_path):
    rows = fx.read(spark, SF, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    stored, path = f"file://{tmp_path}/lines", f"file://{tmp_path}/sketches"
    rows.write.partitionBy("month").parquet(stored)
    table, columns = spark.read.parquet(stored), ["l_orderkey", "l_extendedprice", "l_returnflag"]
    months = sorted(r["month"] for r in table.select("month").distinct().collect())
    first = sketches.add_partitions(table.filter(F.col("month") < months[5]), columns, "month", path)
    assert first == months[:5]
    assert sketches.add_partitions(table, columns, "month", path) == months[5:]
    assert sketches.add_partitions(table, columns, "month", path) == []
    found = sketches.stored_sketches(spark, path)
    assert found.count() == len(months) * len(columns)
    exact = {r["column_name"]: r["distinct_count"] for r in metrics.distinct_count(rows, columns).collect()}
    for r in sketches.distinct_estimates(found).collect():
        assert r["row_count"] == rows.count() and r["null_count"] == 0
        assert _close(r["distinct_estimate"], exact[r["column_name"]])
    # the filter on new partitions is one on directories
    wanted = table.filter(F.col("month").isin([months[-1]]))
    text = sketches.column_sketches(wanted, columns)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in text.replace("isnotnull(month#", "month#") or "PartitionFilters: [isnotnull(month" in text


def test_sketches_of_odd_columns(spark):
    rows = [(1, 0.0, [1], None, None), (2, -0.0, [1], "a", None), (2, float("nan"), None, "a", None)]
    frame = spark.createDataFrame(rows, "i int, d double, l array<int>, s string, n string")
    got = {r["column_name"]: (r["distinct_estimate"], r["null_count"])
           for r in sketches.distinct_estimates(sketches.column_sketches(frame, frame.columns)).collect()}
    assert got == {"i": (2, 0), "d": (2, 0), "l": (1, 1), "s": (1, 1), "n": (0, 3)}
    wide = frame.select(F.col("i").cast("long").alias("i"))
    compared = sketches.compare_sketches(
        sketches.column_sketches(frame, ["i", "s"]), sketches.column_sketches(wide, ["i"]))
    assert {r["column_name"]: r["status"] for r in compared.collect()} == {"i": "PASS", "s": "FAIL"}
    nothing = sketches.column_sketches(frame.limit(0), ["i"])
    assert sketches.distinct_estimates(nothing).collect() == []


def test_numbers_of_hot_and_tied_rows(spark):
    rng = random.Random(1)
    rows = [(5 if rng.random() < 0.4 else rng.randint(0, 50), i, None if i % 9 == 0 else i % 7)
            for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, i int, extra int").repartition(7)
    got = numbering.numbered(frame, [F.asc_nulls_first("extra"), F.desc("k"), F.asc("i")])
    order = lambda r: (r[2] is not None, r[2] or 0, -r[0], r[1])
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=order), 1)}
    assert {r["i"]: r["seq"] for r in got.collect()} == want
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text
    assert numbering.numbered(frame.limit(0), [F.asc("i")]).collect() == []


def test_the_learned_log_is_numbered_in_parts(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"s{i % 40}", "T", "int", "NUMBER", "integer", str(i), "t", at + datetime.timedelta(hours=i))
            for i in range(100)]
    path = f"file://{tmp_path}/log"
    sinks.append_learned(spark.createDataFrame(rows, sinks.LEARNED_SCHEMA), path)
    got = sinks.learned(spark, path)
    assert [r["reason"] for r in got.orderBy("seq").collect()] == [str(i) for i in range(60, 100)]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert sinks.learned(spark, f"file://{tmp_path}/none").collect() == []


def test_the_usage_window_reaches_the_scan(spark, tmp_path):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(40)]
    rows = [(f"{d.isoformat()}T{h:02d}:00:00", "m", "c", 1, 1, 2) for d in days for h in (0, 12, 23)]
    rows += [("2024-01-20", "m", "c", 1, 1, 2), ("2024-01-20T99:00:00", "m", "c", 1, 1, 2), (None,) + rows[0][1:]]
    names = "timestamp string, model string, call_type string, prompt_tokens long, completion_tokens long, total_tokens long"
    path = f"file://{tmp_path}/usage"
    spark.createDataFrame(rows, names).write.parquet(path)
    costed = usage.with_cost(spark.read.parquet(path), usage.price_table(spark))
    today = datetime.date(2024, 1, 20)
    found = usage.window_rollup(costed, today, 7)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,2024-01-14)" in text and "LessThan(timestamp,2024-01-21)" in text
    overall = next(r for r in found.collect() if r["grouping"] == "overall")
    assert (overall["calls"], overall["tokens"], overall["tokens_today"]) == (21, 42, 6)


def test_patterns_are_checked_without_a_job_and_rejections_are_rows(spark):
    config = {"pattern_exclusions": {"patterns": [{"pattern": "^A"}, {"pattern": "[bad"}, {"pattern": ""}]},
              "compliance_exclusions": {"pii": {"enabled": True, "patterns": ["(open", "ssn"]}}}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("patterns", "none expected")
    rules = policy.ExclusionPolicy.from_config(config)
    assert list(tracker.getJobIdsForGroup("patterns")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r["layer"], r["pattern"]): r["reason"] for r in rules.rejected_rules(spark).collect()}
    assert set(got) == {("compliance", "(open"), ("pattern", "[bad")} and all(got.values())
    assert policy.ExclusionPolicy.default().rejected_rules(spark).collect() == []
