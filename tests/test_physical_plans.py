"""The plans that matter at scale keep their shape."""

import datetime
import re

import pytest

from evenkeel.operators import metrics, projection as pj, reconcile as rc
from evenkeel.suite import fixtures as fx
from evenkeel.suite.queries import QUERIES

SF = "/root/testdata/sf0.001"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return fx.read(spark, SF, "orders")


def test_ledger_shuffles_each_side_once_and_combines_first(orders):
    book = rc.ledger(orders, orders, pj.pair_columns(orders, orders), ["o_orderkey"])
    text = physical(rc.cell_diff(book, ["o_orderkey"]))
    assert text.count("Exchange") == 1
    assert "partial_max" in text and "Join" not in text


def test_presence_reads_only_the_key(orders):
    book = rc.ledger(orders, orders, pj.pair_columns(orders, orders), ["o_orderkey"])
    text = physical(rc.row_diff(book, ["o_orderkey"], values=False))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {"struct<o_orderkey:bigint>"}
    assert "SortAggregate" not in text and text.count("Exchange") == 1


def test_values_reach_the_shuffle_as_stored(orders):
    book = rc.ledger(orders, orders, pj.pair_columns(orders, orders), ["o_orderkey"])
    below = physical(rc.diff_counts(book)).split("Exchange hashpartitioning")[1]
    assert "trim(" not in below and "decimal(38,2)" not in below


def test_load_window_is_pushed_down(orders):
    low, high = datetime.datetime(1996, 1, 1), datetime.datetime(1996, 2, 1)
    rows = pj.load_window(orders, "incremental", "o_orderdate", low, high)
    text = rows.select("o_orderkey", "o_orderdate")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(" in text


def test_not_in_has_no_nested_loop(orders, spark):
    lines = fx.read(spark, SF, "lineitem")
    text = physical(rc.missing_rows(orders, lines, ["o_orderkey"], ["l_orderkey"], "not_in"))
    assert "NestedLoop" not in text and "Broadcast" not in text and "Cartesian" not in text


def test_metrics_of_a_side_share_one_scan(spark):
    lines = fx.read(spark, SF, "lineitem")
    names = ["l_quantity", "l_tax"]
    text = physical(metrics.column_metrics(lines, nulls=names, extremes=names, sums=names))
    assert text.count("FileScan") == 1
    assert "struct<l_quantity:double,l_tax:double>" in text


def test_distinct_counts_do_not_expand(spark):
    lines = fx.read(spark, SF, "lineitem")
    text = physical(metrics.distinct_count(lines, ["l_orderkey", "l_tax", "l_returnflag"]))
    assert "Expand" not in text and text.count("FileScan") == 1


def test_no_query_pairs_everything_with_everything(spark):
    for name, run in QUERIES.items():
        text = physical(run(spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
