import datetime

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import metrics, projection as pj, reconcile as rc


@pytest.fixture(scope="module")
def sides(spark):
    source = spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (4, None, 4.0), (5, "e", 5.0),
         (5, "e", 5.0), (None, "n", 0.0)],
        "id int, name string, amount double",
    )
    target = spark.createDataFrame(
        [("1 ", "a ", "1.001"), ("2", "B", "2.00"), ("4", "x", "4"), ("5", "e", "5"),
         ("6", "f", "6"), (None, "n", "0")],
        "ID string, NAME string, AMOUNT string",
    ).select(F.trim("ID").cast("bigint").alias("ID"), "NAME",
             # two declared places: a third one would count, also against a float
             F.col("AMOUNT").cast("decimal(10,2)").alias("AMOUNT"))
    return source, target


def result(sides, **kw):
    source, target = sides
    return rc.ledger(source, target, pj.pair_columns(source, target), ["id"], **kw)


def test_row_diff(sides):
    rows = {(r["id"], r["row_status"]) for r in rc.row_diff(result(sides), ["id"]).collect()}
    assert rows == {
        ("2", "VALUE_MISMATCH"), ("3", "MISSING_IN_TARGET"), ("4", "VALUE_MISMATCH"),
        ("5", "DUPLICATE_KEY"), ("6", "MISSING_IN_SOURCE"),
    }


def test_cell_diff(sides):
    cells = {tuple(r) for r in rc.cell_diff(result(sides), ["id"]).collect()}
    assert cells == {("2", "name", "b", "B"), ("4", "name", "<<NULL>>", "x")}
    strict = {tuple(r) for r in rc.cell_diff(result(sides, strict_nulls=True), ["id"]).collect()}
    assert strict == {("2", "name", "b", "B"), ("4", "name", None, "x")}


def test_null_token_collision(spark):
    a = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS v")
    b = spark.sql("SELECT 1 AS id, '<<NULL>>' AS v")
    pairs = pj.pair_columns(a, b)
    assert rc.cell_diff(rc.ledger(a, b, pairs, ["id"]), ["id"]).count() == 0
    assert rc.cell_diff(rc.ledger(a, b, pairs, ["id"], strict_nulls=True), ["id"]).count() == 1


def test_counts_and_mirror(sides):
    source, target = sides
    row = rc.diff_counts(result(sides)).collect()[0]
    assert row.asDict() == {
        "source_count": 7, "target_count": 6, "missing_in_source": 1, "missing_in_target": 1,
        "value_mismatches": 2, "duplicate_keys": 1, "status": "FAIL",
    }
    pairs = pj.pair_columns(target, source)
    back = rc.diff_counts(rc.ledger(target, source, pairs, ["ID"])).collect()[0]
    assert (back["missing_in_source"], back["missing_in_target"]) == (
        row["missing_in_target"], row["missing_in_source"])
    assert back["value_mismatches"] == row["value_mismatches"]


def test_same_table_passes(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    pairs = pj.pair_columns(part, part)
    book = rc.ledger(part, part, pairs, ["p_partkey"])
    assert rc.diff_counts(book).collect()[0]["status"] == "PASS"
    assert rc.row_diff(book, ["p_partkey"]).count() == 0
    assert rc.same_rows(part, part.orderBy(F.rand(1)), pairs).collect()[0]["status"] == "PASS"


def test_wide_diff_names_only_differing_cells(sides):
    counts = {r["column_name"]: r["mismatches"]
              for r in rc.mismatches_per_column(result(sides)).collect()}
    assert counts == {"name": 2, "amount": 0}
    wide = rc.wide_diff(result(sides), ["id"], [c for c, n in counts.items() if n])
    assert wide.columns == ["id", "name_self", "name_other"]
    assert wide.count() == 2


def test_composite_key(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3)], "k int, l string, v int")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 9), (2, None, 3)], "k int, l string, v int")
    book = rc.ledger(a, b, pj.pair_columns(a, b), ["k", "l"])
    assert [tuple(r) for r in rc.cell_diff(book, ["k", "l"]).collect()] == [
        ("1", "y", "v", "2", "9")]
    with pytest.raises(KeyError):
        rc.ledger(a, b, pj.pair_columns(a, b), ["nope"])


def test_key_modes(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    empty = b.filter("k > 100")

    def found(target, mode):
        return sorted(
            (str(r["k"]), r["source_rows"]) for r in
            rc.missing_rows(a, target, ["k"], nulls=mode).collect())

    assert found(b, "match") == [("2", 2)]
    assert found(b, "not_exists") == [("2", 2), ("None", 1)]
    assert found(b, "not_in") == []
    assert found(b.filter("k IS NOT NULL"), "not_in") == [("2", 2)]
    assert found(empty, "not_in") == [("1", 1), ("2", 2), ("None", 1)]
    with pytest.raises(ValueError):
        rc.missing_rows(a, b, ["k"], nulls="maybe")


def test_invariant_missing_plus_common(spark):
    a = spark.range(0, 100).withColumn("k", F.col("id") % 37)
    b = spark.range(0, 20).withColumn("k", F.col("id"))
    missing = rc.missing_rows(a, b, ["k"]).count()
    common = rc.key_intersection(a, b, ["k"]).count()
    assert missing + common == a.select("k").distinct().count()


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x ")], "k int, v string")
    got = {tuple(r) for r in rc.surplus_rows(a, b, pj.pair_columns(a, b)).collect()}
    assert got == {("1", "<<NULL>>", "source", 1), ("2", "x", "target", 1)}


def test_hot_key_keeps_results_whole(spark):
    """A third of all rows share one key: counted exactly, not multiplied, not dropped."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    book = rc.ledger(rows, rows, pj.pair_columns(rows, rows), ["k"])
    row = rc.diff_counts(book).collect()[0]
    assert (row["source_count"], row["duplicate_keys"], row["value_mismatches"]) == (30000, 1, 0)
    dup = rc.row_diff(book, ["k"]).collect()
    assert [(r["k"], r["source_rows"], r["target_rows"]) for r in dup] == [
        ("<<NULL>>", 10000, 10000)]


# --- projections and metrics -----------------------------------------------------------------


def test_pairing(spark):
    a = spark.sql("SELECT 1 AS custId, 'x' AS First_Name, array(1) AS tags, 2 AS gone")
    b = spark.sql("SELECT 1L AS CUSTOMER_KEY, 'x' AS FIRSTNAME, array(1) AS TAGS")
    pairs = pj.pair_columns(a, b, {"CUSTID": "customer_key"})
    assert [(p.source, p.target) for p in pairs] == [
        ("custId", "CUSTOMER_KEY"), ("First_Name", "FIRSTNAME"), ("tags", "TAGS")]
    assert pj.uncompared_columns(a, b, pairs) == [("source", "gone", "no partner in target")]


def test_find_column_and_headers(spark):
    frame = spark.sql("SELECT 1 AS ` A `, 2 AS B_NORMALIZED")
    assert pj.clean_headers(frame).columns == ["a", "b_normalized"]
    assert pj.find_column(frame, "b") == "B_NORMALIZED"
    with pytest.raises(KeyError):
        pj.find_column(frame, "c")


def test_active_rows(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, true), (2, false), (3, NULL) t(id, _FIVETRAN_ACTIVE)")
    assert [r["id"] for r in pj.active_rows(frame).collect()] == [1]
    assert pj.active_rows(frame.select("id")).count() == 3


def test_load_window_is_wall_clock(spark):
    frame = spark.sql(
        "SELECT id, TIMESTAMP_NTZ '1996-01-01 00:00:00' + id * INTERVAL '1' HOUR AS t "
        "FROM range(30)")
    day = datetime.datetime(1996, 1, 1), datetime.datetime(1996, 1, 1, 23)
    kept = [r["id"] for r in pj.load_window(frame, "Incremental", "T", *day).collect()]
    assert kept == list(range(24))
    assert pj.load_window(frame, "historical").count() == 30
    as_date = frame.selectExpr("id", "CAST(t AS DATE) AS t")
    assert pj.load_window(as_date, "incremental", "t", "1996-01-02", "1996-01-02").count() == 6
    assert pj.load_window(frame, "incremental", "id", 3, 5).count() == 3


def test_exclusion_order():
    names = pj.excluded_names(["Extra", "_FIVETRAN_ID"], ["extra", "last"])
    assert names[-2:] == ["extra", "last"] and len(names) == len(set(names)) == 9


def test_empty_table_metrics(spark):
    frame = spark.range(0).withColumnRenamed("id", "a")
    assert metrics.null_percent(frame).collect()[0]["null_pct"] is None
    assert metrics.distinct_count(frame).collect()[0]["distinct_count"] == 0
    assert metrics.count_check(frame, frame).collect()[0]["status"] == "PASS"


def test_distinct_details(spark):
    frame = spark.sql(
        "SELECT * FROM VALUES (0.0D, '{\"a\":1}'), (-0.0D, '{ \"a\": 1 }'), (NULL, NULL) t(x, j)")
    got = {r[0]: r[1] for r in metrics.distinct_count(frame, json_columns=["j"]).collect()}
    assert got == {"x": 1, "j": 1}


@pytest.mark.parametrize("approx", [False, True])
def test_nested_columns_are_counted(spark, approx):
    frame = spark.sql(
        "SELECT * FROM VALUES "
        "(array('a, b'), map('x', 1, 'y', NULL), named_struct('t', TIMESTAMP '2024-11-03 05:30:00.000001Z', 'd', 0.0D)), "
        "(array('a', 'b'), map('y', NULL, 'x', 1), named_struct('t', TIMESTAMP '2024-11-03 06:30:00.000001Z', 'd', 0.0D)), "
        "(array('a', NULL), map('x', 1), named_struct('t', TIMESTAMP '2024-11-03 05:30:00.000002Z', 'd', 0.0D)), "
        "(array('a', 'b'), NULL, named_struct('t', TIMESTAMP '2024-11-03 05:30:00.000001Z', 'd', -0.0D)), "
        "(NULL, NULL, NULL) t(a, m, s)")
    frame = frame.selectExpr("*", "array(m) AS am", "1 AS n")
    got = {r[0]: r[1] for r in metrics.distinct_count(frame, approx=approx).collect()}
    assert got == {"a": 3, "m": 2, "s": 3, "am": 3, "n": 1}


def test_business_checks_need_a_column(spark):
    frame = spark.range(3)
    with pytest.raises(ValueError):
        metrics.business_checks(frame, [metrics.BusinessCheck("c", ("zzz",), "zzz > 1")])
