"""Keys found in data, comparison of bucketed tables, scales and partners of column pairs."""

import itertools
import random
import uuid

import pytest
from pyspark.sql import functions as F, types as T

from evenkeel.operators import keys, projection as pj, reconcile as rc
from evenkeel.plans.rules import RuleBook
from evenkeel.plans.runs import TableTask, skip_report, table_result
from evenkeel.sources import catalog, folders, layout
from evenkeel.suite import fixtures as fx
from evenkeel.suite.queries import ORDER_KEY, _order_pairs, _orders, _orders_target

SF = "/root/testdata/sf0.001"


def _plain_keys(rows, names, longest):
    found = []
    for size in range(1, longest + 1):
        for s in itertools.combinations(range(len(names)), size):
            if any(set(k) <= set(s) for k in found):
                continue
            seen = [tuple(r[i] for i in s) for r in rows]
            if rows and None not in itertools.chain(*seen) and len(set(seen)) == len(rows):
                found.append(s)
    return [tuple(names[i] for i in k) for k in found]


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b,c", "d`e", "f", "g"]
    rows = list({tuple(rng.randint(0, rng.choice([3, 12, 60])) for _ in names) for _ in range(120)})
    rows = [(*r, float(r[0]) * rng.choice([1, -1]), None if i == 5 else i, [1], str(i // 2))
            for i, r in enumerate(rows)]
    columns = "a int, `b,c` long, `d``e` int, f int, g int, x double, n int, arr array<int>, s string"
    frame = spark.createDataFrame(rows, columns)
    for slice_rows in (1, 20, 10_000):
        got = keys.search_keys(frame, slice_rows=slice_rows)
        # -0.0 is 0.0, a column with NULL or of a nested type is in no key
        plain = [(*r[:5], r[5] + 0.0, r[8]) for r in rows]
        assert got.keys == _plain_keys(plain, [*names, "x", "s"], 3)
        assert sum(level.keys for level in got.levels) == len(got.keys)


def test_key_search_leaves_most_sets_alone(spark):
    got = keys.search_keys(fx.read(spark, "/root/testdata/sf0.01", "lineitem"))
    for level in got.levels:
        counted = level.refuted_by_count + level.keys
        assert level.sets == (level.with_key_inside + level.too_few_values + level.refuted_by_slice
                              + counted)
    assert sum(x.refuted_by_count + x.keys for x in got.levels) < sum(x.sets for x in got.levels) / 4


def test_sets_are_hashed_on_slices_and_on_the_rows_that_a_part_repeats(spark, monkeypatch):
    frame = spark.range(4096).selectExpr(
        "id div 8 AS a", "if(id = 9, 0, id % 8) AS b", "id % 2 AS c", "id % 3 AS d")
    whole, plain = set(), keys._hash

    def hashed(rows, names):
        if rows is frame and len(names) > 1:
            whole.add(tuple(names))
        return plain(rows, names)

    monkeypatch.setattr(keys, "_hash", hashed)
    got = keys.search_keys(frame, slice_rows=64)
    assert got.keys == [("a", "b", "c"), ("a", "b", "d")]
    assert whole == {("a", "b")}  # repeated once; the sets around it are keys by these two rows


def test_keys_of_nothing(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert keys.discover_keys(empty).collect() == []
    same = spark.createDataFrame([(1, 2)] * 3, "a int, b int")
    assert keys.discover_keys(same).collect() == []
    assert keys.discover_keys(same.limit(1)).count() == 2


def test_a_key_of_both_sides(spark):
    source, target = _orders(spark, SF), _orders_target(spark, SF)
    pairs = _order_pairs(source, target)
    assert keys.common_key(source, target, pairs) == []  # the target repeats keys
    again = fx.read(spark, SF, "orders")
    assert keys.common_key(source, again, pj.pair_columns(source, again)) == ["o_orderkey"]


def _stored(spark, rows, key, buckets=16):
    return layout.write_bucketed(
        rows, f"t_{uuid.uuid4().hex}", [key], buckets, folders.new_folder(spark, "bucketed"))


def test_bucketed_tables_are_compared_without_a_shuffle(spark):
    source = _stored(spark, _orders(spark, SF), "o_orderkey")
    target = pj.active_rows(_stored(spark, fx.derive(spark, SF, fx.ORDERS_TARGET), "O_ORDERKEY"))
    book = rc.ledger(source, target, _order_pairs(source, target), ORDER_KEY)
    for frame in (rc.row_diff(book, ORDER_KEY), rc.cell_diff(book, ORDER_KEY),
                  rc.key_ledger(source, target, ["o_orderkey"])):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Bucketed: true" in text
    plain = rc.ledger(_orders(spark, SF), _orders_target(spark, SF),
                      _order_pairs(_orders(spark, SF), _orders_target(spark, SF)), ORDER_KEY)
    a, b = rc.row_diff(book, ORDER_KEY), rc.row_diff(plain, ORDER_KEY)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_layouts_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (None, 3, "b")], "k int, l long, s string")
    names = {}
    for name, key, n in (("k8", "k", 8), ("again", "k", 8), ("k4", "k", 4), ("s8", "s", 8)):
        names[name] = f"{name}_{uuid.uuid4().hex}"
        layout.write_bucketed(rows, names[name], [key], n, folders.new_folder(spark, name))
    found = {n: layout.declared_layout(spark, t) for n, t in names.items()}
    assert found["k8"] == layout.Layout(("k",), 8)
    pairs = pj.pair_columns(rows, rows)
    tell = lambda keys, a, b: layout.co_located(rows, rows, pairs, keys, found[a], found[b])
    assert tell(["k"], "k8", "again") and tell(["K", "l"], "k8", "again")
    assert not tell(["k"], "k8", "k4") and not tell(["l"], "k8", "again") and not tell(["s"], "s8", "s8")
    assert not layout.co_located(rows, rows, pairs, ["k"], found["k8"], None)
    # NULL keys meet in buckets too
    a, b = spark.table(names["k8"]), spark.table(names["again"])
    book = rc.ledger(a, b, pj.pair_columns(a, b), ["k"])
    assert rc.diff_counts(book).first()["status"] == "PASS"


def test_a_decimal_decides_the_places_of_a_float(spark):
    d, f = T.DecimalType(10, 4), T.DoubleType()
    assert pj.common_rule(d, f) == pj.common_rule(f, d) == "numeric:4"
    assert pj.common_rule(f, f) == "numeric" and pj.common_rule(T.DecimalType(12, 2), f) == "numeric"
    a = spark.sql("SELECT 1 AS k, CAST(0.001 AS DECIMAL(10,4)) AS v")
    for other, status in ((0.004, "FAIL"), (0.001, "PASS")):
        b = spark.createDataFrame([(1, other)], "k int, v double")
        book = rc.ledger(a, b, pj.pair_columns(a, b), ["k"])
        assert rc.diff_counts(book).first()["status"] == status


def test_a_target_column_has_one_partner(spark):
    source = spark.createDataFrame([(1, 2, 3)], "a_b int, ab int, c int")
    target = spark.createDataFrame([(1, 2)], "AB int, C int")
    pairs = pj.pair_columns(source, target)
    assert [(p.source, p.target) for p in pairs] == [("ab", "AB"), ("c", "C")]
    assert pj.uncompared_columns(source, target, pairs) == [
        ("source", "a_b", "its partner AB is compared with ab")]
    both = pj.pair_columns(source, target, {"a_b": "AB"})
    assert [(p.source, p.target) for p in both] == [("a_b", "AB"), ("ab", "AB"), ("c", "C")]


def test_skip_report_keeps_the_status_from_before(spark):
    results = spark.createDataFrame(
        [("t", "FAIL", "PASS"), ("u", "PASS", "PASS"), ("v", "FAIL", None)],
        "table string, status string, original_status string")
    covered = spark.createDataFrame([], "table string, total_columns long, validated_columns long, "
                                        "coverage_pct double")
    skips = spark.createDataFrame([("t", 0, 2, 0)], "table string, justified_skips long, "
                                                    "unjustified_skips long, warn_only_skips long")
    got = {r["table"]: (r["original_status"], r["effective_status"])
           for r in skip_report(results, covered, skips).collect()}
    assert got == {"t": ("PASS", "FAIL"), "u": ("PASS", "PASS"), "v": ("FAIL", "FAIL")}


def test_a_run_finds_the_key_that_nobody_names(spark):
    orders = fx.read(spark, SF, "orders")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, 1.0)
                                .otherwise(F.col("o_totalprice")))
    found = table_result(spark, TableTask("orders", orders, changed, find_keys=True, needs_keys=True)).first()
    named = table_result(spark, TableTask("orders", orders, changed, ["o_orderkey"])).first()
    assert found == named and found["mode"] == "keyed" and found["value_mismatches"] > 0
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert table_result(spark, TableTask("t", same, same, find_keys=True)).first()["mode"] == "multiset"
    with pytest.raises(ValueError, match="none was found"):
        table_result(spark, TableTask("t", same, same, find_keys=True, needs_keys=True))


def test_a_warehouse_is_cataloged_once(spark, tmp_path):
    database = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION 'file://{tmp_path}/{database}'")
    for i in range(5):
        spark.createDataFrame([(1, "x")], f"k{i} int, s string").write.saveAsTable(f"{database}.t{i}")
    known = {}
    found = catalog.warehouse_catalog(spark, database, "source", known=known)
    assert sorted((r["table"], r["name"]) for r in found.collect()) == sorted(
        (f"t{i}", c) for i in range(5) for c in (f"k{i}", "s"))
    known[database, "t0"] = T.StructType([T.StructField("kept", T.LongType())])
    again = catalog.warehouse_catalog(spark, database, "source", known=known)
    assert "kept" in {r["name"] for r in again.collect()}
    catalog.forget(known, database, "t0")
    assert catalog.warehouse_catalog(spark, database, "source", known=known).count() == 10
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_names_decide_on_contents_when_asked(spark):
    a = spark.createDataFrame([(1, '{"x": 1, "y": 2}', "c  d")], "k int, my_Json string, note string")
    b = spark.createDataFrame([(1, '{"y":2,"x":1}', "c  d")], "k int, MY_JSON string, note string")
    for by_contents, status in ((True, "PASS"), (False, "FAIL")):
        found = table_result(spark, TableTask("t", a, b, ["k"], by_contents=by_contents)).first()
        assert found["status"] == status
    assert [p.rule for p in pj.pair_columns(a, b, by_contents=True)] == ["integer", "by_name:json", "text"]
    kept = pj.pair_columns(a, b, rules={"my_json": "text"}, by_contents=True)
    assert [p.rule for p in kept] == ["integer", "text", "text"]
    with pytest.raises(ValueError):
        RuleBook().named("by_name:xml")
