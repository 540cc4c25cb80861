import datetime

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import classify, coverage, policy, presence, usage
from evenkeel.plans import mapping as plan, runs
from evenkeel.sources import catalog as cat, readers, sinks

MAPPING = ("table string, ordinal int, source_column string, target_column string, skip boolean, "
           "skip_reason string")


def acct(spark):
    return spark.createDataFrame(
        [("AcctSoftware", 1, "AcctSoftwareID", "ACCTSOFTWAREID", False, None),
         ("AcctSoftware", 2, "sSoftwareName", "SSOFTWARENAME", False, None),
         ("AcctSoftware", 3, "dDeleted", "DDELETED", False, None),
         ("AcctSoftware", 4, "uTS", None, True, "rowversion — not comparable"),
         ("AcctSoftware", 5, "LegacyFlag", None, False, None)], MAPPING)


def test_coverage_of_the_sample_plan(spark):
    row = coverage.column_coverage(acct(spark)).collect()[0]
    assert (row["total_columns"], row["validated_columns"], row["excluded_columns"],
            row["coverage_pct"], row["coverage_incl_unmatched"]) == (4, 3, 2, 75.0, 60.0)
    assert row["is_low"]
    assert row["excluded_detail"] == (
        "uTS (rowversion — not comparable), LegacyFlag (no matching target column)")


def test_headlines(spark):
    rows = [("t", i, c, c.upper() if not r else None, bool(r), r) for i, (c, r) in enumerate(
        [("a", None), ("b", None), ("c", None), ("uTS", "binary type"), ("ssn", "PII policy")])]
    rows += [("full", 1, "a", "A", False, None)]
    got = {r["table"]: r["headline"] for r in coverage.headline(
        coverage.column_coverage(spark.createDataFrame(rows, MAPPING))).collect()}
    assert got["t"] == ("3 of 5 columns validated (60.0%) — 2 excluded: uTS (binary type), "
                        "ssn (PII policy)")
    assert got["full"] == "1 of 1 columns validated (100.0%) — no exclusions"


def test_batch_coverage(spark):
    rows = [("good", i, f"c{i}", f"C{i}", False, None) for i in range(10)]
    rows += [("thin", i, f"c{i}", f"C{i}" if i < 4 else None, i >= 4, "x") for i in range(10)]
    per_table = coverage.column_coverage(spark.createDataFrame(rows, MAPPING))
    assert coverage.batch_coverage(per_table).collect()[0]["coverage_pct"] == 70.0
    assert [r["table"] for r in coverage.low_coverage_tables(per_table).collect()] == ["thin"]
    empty = coverage.batch_coverage(per_table.filter("1 = 0")).collect()[0]
    assert empty["coverage_pct"] == 0.0


CUSTOMER = ["customer_id bigint", "first_name string", "last_name string", "email string",
            "phone string", "date_of_birth date", "account_balance decimal(10,2)",
            "is_active boolean", "created_at timestamp_ntz", "updated_at timestamp_ntz"]
EXTRA = ["_FIVETRAN_SYNCED timestamp_ntz", "MIGRATED_AT timestamp_ntz", "MIGRATED_BY string",
         "DATA_QUALITY_SCORE decimal(3,2)", "FULL_NAME string"]


def catalogs(spark):
    s = spark.createDataFrame([], ", ".join(CUSTOMER))
    t = spark.createDataFrame([], ", ".join([c.upper() for c in CUSTOMER] + EXTRA))
    return (cat.column_catalog(spark, {"customers": s}, "source", {"customers": ["customer_id"]}),
            cat.column_catalog(spark, {"customers": t}, "target"))


def test_two_sided_coverage_of_customers(spark):
    source, target = catalogs(spark)
    found = presence.schema_presence(source, target)
    row = coverage.two_sided_coverage(found).collect()[0]
    assert (row["matched_columns"], row["source_only"], row["target_only"]) == (10, 0, 5)
    assert (row["source_coverage"], round(row["target_coverage"], 1),
            round(row["overall_coverage"], 1)) == (100.0, 66.7, 66.7)
    kinds = {r["column_name"]: r["category"] for r in
             found.filter("presence = 'target_only'").collect()}
    assert kinds == {"_FIVETRAN_SYNCED": "Fivetran Metadata", "MIGRATED_AT": "Audit Column",
                     "MIGRATED_BY": "Audit Column", "DATA_QUALITY_SCORE": "Data Enrichment",
                     "FULL_NAME": "Derived/Computed"}
    health = coverage.schema_health(coverage.two_sided_coverage(found)).collect()[0]
    assert len(health["warnings"]) == 2 and health["is_low"]


def test_table_presence_fixture(spark):
    source = spark.createDataFrame([("orders",), ("customers",), ("products",)], "table string")
    target = spark.createDataFrame([("CUSTOMERS",), ("PRODUCTS",), ("X",)], "table string")
    got = {(r["source_table"] or r["target_table"]): r["status"]
           for r in presence.table_presence(source, target).collect()}
    assert got == {"orders": "MISSING_CRITICAL", "customers": "MATCHED", "products": "MATCHED",
                   "X": "TARGET_ONLY"}
    failed = presence.presence_failures(presence.table_presence(source, target)).collect()
    assert [(r["table"], r["status"]) for r in failed] == [("orders", "FAIL")]


def test_exclusion_fixture(spark):
    rules = policy.ExclusionPolicy.from_config({
        "global_exclusions": {"columns": [
            {"column_name": "_FIVETRAN_DELETED", "reason": "soft delete"}]},
        "pattern_exclusions": {"patterns": [
            {"pattern": "^_FIVETRAN_.*", "reason": "metadata"}, {"pattern": "[bad"}]},
        "table_specific_exclusions": {"AcctSoftware": {"exclusions": [
            {"column_name": "uTS", "reason": "row version"}]}},
    })
    columns = spark.createDataFrame(
        [("acctsoftware", c, "", "", "mssql") for c in ("uts", "_FIVETRAN_SYNCED",
                                                       "sSoftwareName", "_fivetran_deleted")],
        "table string, column_name string, source_type string, target_type string, source_db string")
    got = {r["column_name"]: (r["excluded"], r["rule_type"], r["reason"])
           for r in policy.decide_exclusions(columns, rules).collect()}
    assert got == {
        "uts": (True, "table_specific", "row version"),
        "_FIVETRAN_SYNCED": (True, "pattern", "metadata"),
        "sSoftwareName": (False, "", ""),
        "_fivetran_deleted": (True, "pattern", "metadata"),
    }
    assert all(reason for excluded, _, reason in got.values() if excluded)


@pytest.mark.parametrize("name,reason,dtype,category,verdict", [
    ("_FIVETRAN_ID", "", "", "fivetran_metadata", "JUSTIFIED"),
    ("a", "PII policy", "", "config_exclusion", "JUSTIFIED"),
    ("a", "", "timestamp without time zone", "type_incompatible", "JUSTIFIED"),
    ("etl_run", "", "int", "audit_column", "JUSTIFIED"),
    ("a", "no matching target column", "int", "no_target_match", "UNJUSTIFIED"),
    ("a", "target-only", "int", "no_source_match", "WARN_ONLY"),
    ("a", None, "int", "unknown", "UNJUSTIFIED"),
    ("a", "Best fuzzy candidate score 0.52 below threshold 0.75", "int", "unknown",
     "UNJUSTIFIED"),
])
def test_skip_verdicts(spark, name, reason, dtype, category, verdict):
    row = policy.classify_skips(spark.createDataFrame(
        [(name, reason, dtype)], "column_name string, skip_reason string, data_type string")
    ).collect()[0]
    assert (row["category"], row["verdict"]) == (category, verdict)


@pytest.mark.parametrize("name,dtype,group", [
    ("payload", "jsonb", "skipped"), ("created", "timestamp(6)", "temporal"),
    ("customer_id", "bigint", "identifier"), ("ref", "uuid", "identifier"),
    ("is_on", "int", "status_flag"), ("locked", "text", "status_flag"),
    ("net_amount", "numeric(10,2)", "numeric_financial"), ("qty", "integer", "numeric_quantity"),
    ("size", "number(38,0)", "numeric_generic"), ("order_status", "varchar(3)", "text_enum"),
    ("note", "text", "text_generic"), ("thing", "geometry", "text_generic"),
    ("tax_code_total", "text", "text_generic"),
])
def test_column_groups(spark, name, dtype, group):
    frame = spark.createDataFrame([(name, dtype)], "n string, t string")
    assert frame.select(classify.column_group(F.col("n"), F.col("t"))).collect()[0][0] == group


def test_real_catalog_profile(spark):
    source, _ = catalogs(spark)
    checks = {r["check"]: r["columns"] for r in classify.select_checks(
        classify.classify(source)).collect()}
    assert checks["sum"] == "account_balance" and checks["value_distribution"] == "is_active"
    assert "duplicate_check" not in checks  # DataFrame schemas say nullable


def test_plan_checks(spark):
    mapping = plan.MAPPING_SCHEMA
    rows = [("bronze", "t", 1, "a", "int", "A", "NUMBER", "exact", 0.0, 1.0, "resolved", False,
             False, None, None, "integer", True, 1)]
    good = spark.createDataFrame(rows, mapping)
    header = spark.createDataFrame([("t", "public", "t", "T", "complete"),
                                    ("none", "public", "", "T", "complete")],
                                   "table string, source_schema string, source_table string, "
                                   "target_table string, status string")
    got = {r["table"]: r for r in plan.check_plans(header, good).collect()}
    assert got["t"]["is_valid"] and not got["t"]["warnings"]
    assert got["none"]["issues"] == ["source_table is empty", "no active column mappings"]


# --- runs, sinks, readers ----------------------------------------------------------------------------


def test_batch_isolates_failures(spark, tmp_path):
    good = spark.range(5).withColumn("v", F.col("id"))
    bad = good.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("boom")))
                          .otherwise(F.col("v")))
    tasks = [runs.TableTask("ok", good, good, ["id"]),
             runs.TableTask("late", good, bad, ["id"]),
             runs.TableTask("early", {"path": str(tmp_path / "nothing")}, good, ["id"]),
             runs.TableTask("counted", good, good.filter("id > 0"))]
    got = {r["table"]: r["status"] for r in runs.run_batch(spark, tasks).collect()}
    assert got == {"ok": "PASS", "late": "ERROR", "early": "ERROR", "counted": "FAIL"}


def test_reports_and_mismatches(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0)
    results = runs.run_batch(spark, [runs.TableTask("t", spark.range(3), spark.range(2))])
    report = runs.summary(results, "data_validation", "r1", at, at + datetime.timedelta(0, 3))
    path = str(tmp_path / "summary")
    sinks.append_report(report, path)
    sinks.append_report(report, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 2 and back.columns == runs.DATA_SUMMARY.names
    assert back.collect()[0]["total_time_taken"] == "3.00s"
    assert not sinks.write_mismatches(spark.range(0), str(tmp_path / "none"))
    assert spark.read.schema("id bigint").parquet(str(tmp_path / "none")).count() == 0
    assert sinks.write_mismatches(spark.range(2), str(tmp_path / "some"))
    assert spark.read.parquet(str(tmp_path / "some")).count() == 2


def test_confirmed_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.confirmed_mappings(spark, path).count() == 0
    for hour, target in ((1, "A"), (3, "B"), (2, "C")):
        sinks.confirm_mapping(spark.createDataFrame(
            [("t", target, "me", datetime.datetime(2024, 1, 1, hour), "c")],
            sinks.CONFIRMED_SCHEMA), path)
    assert [r["target_table"] for r in sinks.confirmed_mappings(spark, path).collect()] == ["B"]


def test_decision_export_and_policy_rows(spark, tmp_path):
    columns = spark.createDataFrame(
        [("t", "_FIVETRAN_ID", "", "", "")],
        "table string, column_name string, source_type string, target_type string, source_db string")
    decided = policy.decide_exclusions(columns, policy.ExclusionPolicy.default())
    sinks.write_decisions(decided, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).collect()[0]["excluded"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_load_formats(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    spark.range(3).write.option("header", True).format(fmt).save(path)
    spec = {"format": fmt, "path": path, "schema": "id bigint", "options": {"header": "true"}}
    assert sorted(r["id"] for r in readers.load(spark, spec).collect()) == [0, 1, 2]


def test_control_table(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "s" / "a"))
    spark.range(4).write.parquet(str(tmp_path / "t" / "b"))
    empty = [None] * len(readers.CONTROL_SCHEMA)

    def row(**kw):
        return tuple(kw.get(n, e) for n, e in zip(readers.CONTROL_SCHEMA.names, empty))

    control = spark.createDataFrame(
        [row(id=1, table_name="x", source_schema="s", source_table="a", target_schema="t",
             target_table="b", is_active=True),
         row(id=2, table_name="off", is_active=False)], readers.CONTROL_SCHEMA)
    tasks = runs.tasks_from_control(
        readers.active_control_rows(control).collect(), "parquet", str(tmp_path))
    got = runs.run_batch(spark, tasks).collect()
    assert [(r["table"], r["status"]) for r in got] == [("x", "PASS")]


def test_usage_log(spark, tmp_path):
    log = tmp_path / "usage.jsonl"
    log.write_text(
        '{"timestamp":"2024-01-05T10:00:00","model":"gpt-4o","call_type":"map",'
        '"prompt_tokens":1000000,"completion_tokens":100000}\n'
        "not json\n"
        '{"timestamp":"bad","model":"who","prompt_tokens":1000000}\n')
    events = readers.usage_log(spark, str(log))
    costed = usage.with_cost(events, usage.price_table(spark))
    overall = usage.usage_rollup(costed).filter("grouping = 'overall'").collect()[0]
    assert (overall["calls"], overall["cost"]) == (2, 2.5 + 1.0 + 3.0)
    days = usage.daily_cost(costed, datetime.date(2024, 1, 7)).orderBy("day").collect()
    assert [r["cost"] for r in days] == [0.0, 0.0, 0.0, 0.0, 3.5, 0.0, 0.0]


def test_warehouse_catalog(spark):
    frame = cat.column_catalog(
        spark, {"t": spark.sql("SELECT 1 AS a, CAST(1 AS DECIMAL(9,3)) AS b")}, "source",
        {"t": ["B"]})
    rows = [(r["name"], r["type"], r["precision"], r["scale"], r["is_key"]) for r in
            frame.orderBy("ordinal").collect()]
    assert rows == [("a", "int", None, None, False), ("b", "decimal(9,3)", 9, 3, True)]
