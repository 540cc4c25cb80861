"""Registered queries: every operator on the given tables or on rows derived from them."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.functions import names as nm, normalise as nz
from evenkeel.functions.rounding import round_even
from evenkeel.operators import (
    classify, coverage, keys, matching, metrics, numbering, policy, presence, projection, reconcile, sketches,
    usage, windows,
)
from evenkeel.plans import checks, mapping as plan, run_store, runs
from evenkeel.plans.rules import RuleBook
from evenkeel.sources import catalog as cat, folders, layout, sinks
from evenkeel.suite import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RENAMED = {"o_custkey": "CUSTOMER_KEY"}
ORDER_KEY = ["o_orderkey"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _orders(spark, d):
    return fx.read(spark, d, "orders")


def _orders_target(spark, d):
    return projection.active_rows(fx.derive(spark, d, fx.ORDERS_TARGET))


def _order_pairs(source, target):
    return projection.pair_columns(
        source, target, RENAMED, projection.excluded_names(),
        # stored doubles with two decimals; both sides carry times, compared to the second
        rules={"o_totalprice": "numeric"},
    )


def _order_ledger(spark, d):
    source, target = _orders(spark, d), _orders_target(spark, d)
    return reconcile.ledger(source, target, _order_pairs(source, target), ORDER_KEY)


# --- row and cell differences -----------------------------------------------------------------


@query
def data_summary_orders(spark, d):
    book = _order_ledger(spark, d)
    found = reconcile.diff_counts(book).select(
        F.lit("orders").alias("table"), F.lit("data_validation").alias("validation_type"), "*"
    )
    at = datetime.datetime(2024, 1, 1)
    rows = runs.summary(runs._fit(found, runs.RESULT_SCHEMA), "data_validation", "run", at, at)
    return rows.select(
        "validation_performed", "source_table_name", "source_count", "missing_in_source",
        "target_count", "missing_in_target", "value_mismatches", "duplicate_keys", "status",
    )


@query
def row_diff_orders(spark, d):
    return reconcile.row_diff(_order_ledger(spark, d), ORDER_KEY)


@query
def co_located_diff_orders(spark, d):
    """row_diff_orders over tables that are bucketed alike: compared without a shuffle."""
    source, target = (
        layout.write_bucketed(
            rows, f"{side}_{uuid.uuid4().hex}", [key], 16, folders.new_folder(spark, side)
        )
        for side, rows, key in (
            ("orders_source", _orders(spark, d), "o_orderkey"),
            ("orders_target", fx.derive(spark, d, fx.ORDERS_TARGET), "O_ORDERKEY"),
        )
    )
    target = projection.active_rows(target)
    book = reconcile.ledger(source, target, _order_pairs(source, target), ORDER_KEY)
    return reconcile.row_diff(book, ORDER_KEY)


@query
def row_presence_orders(spark, d):
    return reconcile.row_diff(_order_ledger(spark, d), ORDER_KEY, values=False)


@query
def cell_diff_orders(spark, d):
    return reconcile.cell_diff(_order_ledger(spark, d), ORDER_KEY)


@query
def wide_diff_orders(spark, d):
    return reconcile.wide_diff(_order_ledger(spark, d), ORDER_KEY)


@query
def mismatches_per_column(spark, d):
    return reconcile.mismatches_per_column(_order_ledger(spark, d))


@query
def cell_diff_customer_clean(spark, d):
    source, target = fx.read(spark, d, "customer"), fx.derive(spark, d, fx.CUSTOMER_TARGET)
    pairs = projection.pair_columns(source, target)
    book = reconcile.ledger(source, target, pairs, ["c_custkey"], strict_nulls=True)
    return reconcile.diff_counts(book)


# --- metrics ----------------------------------------------------------------------------------


@query
def row_count(spark, d):
    return metrics.row_count(_orders_target(spark, d))


@query
def count_check(spark, d):
    return metrics.count_check(_orders(spark, d), _orders_target(spark, d))


@query
def count_summary(spark, d):
    found = metrics.count_check(_orders(spark, d), _orders_target(spark, d)).select(
        F.lit("orders").alias("table"), F.lit("count_validation").alias("validation_type"), "*"
    )
    at = datetime.datetime(2024, 1, 1)
    rows = runs.summary(runs._fit(found, runs.RESULT_SCHEMA), "count_validation", "run", at, at)
    return rows.drop("run_at", "batch_start_time", "batch_end_time", "total_time_taken")


@query
def count_only_check(spark, d):
    part = fx.read(spark, d, "part")
    task = runs.TableTask(
        "part", part, part.filter("p_partkey % 7 <> 0"), validation_type="count_validation"
    )
    return runs.table_result(spark, task).select(
        "table", "validation_type", "mode", "source_count", "target_count", "status"
    )


@query
def keyless_validation(spark, d):
    """Data validation without a key compares whole rows as often as they occur."""
    task = runs.TableTask(
        "orders", fx.derive(spark, d, fx.KEYLESS_SOURCE), fx.derive(spark, d, fx.KEYLESS_TARGET)
    )
    return runs.table_result(spark, task).select(
        "table", "mode", "source_count", "target_count", "missing_in_target",
        "missing_in_source", "status",
    )


@query
def uncompared_columns(spark, d):
    """Arrays are compared; a dropped column is named in the result."""
    source = fx.read(spark, d, "embeddings")
    target = source.select(
        "vec_id", F.when(F.col("vec_id") % 10 == 0, F.reverse("embedding"))
        .otherwise(F.col("embedding")).alias("embedding"),
    )
    task = runs.TableTask("embeddings", source, target, ["vec_id"])
    return runs.table_result(spark, task).select(
        "table", "mode", "status", "compared_columns", "uncompared_columns", "source_count"
    )


@query
def edge_values(spark, d):
    """Flags, whole numbers beyond 1e18 and four decimal places across types."""
    source = fx.derive(spark, d, fx.EDGES_SOURCE).withColumn(
        "small", F.col("small").cast("decimal(10,4)"))
    target = fx.derive(spark, d, fx.EDGES_TARGET).withColumn(
        "small", F.col("small").cast("decimal(10,4)"))
    pairs = projection.pair_columns(source, target)
    return reconcile.mismatches_per_column(reconcile.ledger(source, target, pairs, ["id"]))


@query
def mixed_scale_diff(spark, d):
    """DECIMAL(10,4) against DOUBLE: the declared scale decides the places."""
    source = fx.derive(spark, d, fx.SCALE_SOURCE)
    target = fx.derive(spark, d, fx.SCALE_TARGET)
    pairs = projection.pair_columns(source, target)
    return reconcile.cell_diff(reconcile.ledger(source, target, pairs, ["id"]), ["id"])


@query
def named_contents_diff(spark, d):
    """Text columns named for JSON or hstore are compared by their contents, other text as it is."""
    source, target = fx.derive(spark, d, fx.NAMED_SOURCE), fx.derive(spark, d, fx.NAMED_TARGET)
    pairs = projection.pair_columns(source, target, by_contents=True)
    book = reconcile.ledger(source, target, pairs, ["c_custkey"])
    return reconcile.mismatches_per_column(book)


@query
def missing_rows_mixed_types(spark, d):
    """Keys of different types meet by value: DECIMAL and DOUBLE against BIGINT."""
    source = fx.read(spark, d, "orders").select("o_orderkey")
    kept = source.filter("o_orderkey % 97 <> 0")
    found = None
    for kind in ("decimal(12,2)", "double"):
        target = kept.select(F.col("o_orderkey").cast(kind).alias("o_orderkey"))
        rows = reconcile.missing_rows(source, target, ["o_orderkey"]).select(
            F.lit(kind).alias("kind"), F.col("o_orderkey").cast("double").alias("o_orderkey"),
            "source_rows",
        )
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def null_pct(spark, d):
    return metrics.null_percent(_orders_target(spark, d))


@query
def distinct_count(spark, d):
    return metrics.distinct_count(
        fx.read(spark, d, "lineitem"),
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
         "l_linestatus", "l_shipdate"],
    )


@query
def distinct_count_json(spark, d):
    return metrics.distinct_count(
        fx.read(spark, d, "events"), ["event_type", "user_id", "props"], json_columns=["props"]
    )


def _within_bound(estimates, exact, estimate, error):
    """Per column: is the estimate within four standard errors of the exact count?"""
    off = F.abs(F.col(estimate) - F.col("distinct_count"))
    return estimates.join(exact, ["column_name"]).select(
        "column_name", "distinct_count", (off <= 4 * error * F.col("distinct_count")).alias("within_bound")
    )


@query
def distinct_count_approx(spark, d):
    lines = fx.read(spark, d, "lineitem")
    approx = metrics.distinct_count(lines, approx=True, rsd=0.02)
    return _within_bound(
        approx.withColumnRenamed("distinct_count", "estimate"), metrics.distinct_count(lines),
        "estimate", 0.02,
    )


@query
def distinct_sketches(spark, d):
    """Sketches stored per month of orders, in two sittings, merged and held against exact counts."""
    path, orders = folders.new_folder(spark, "sketches"), _orders(spark, d)
    monthly = orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    for rows in (monthly.filter("month < '1995-01'"), monthly):
        sketches.add_partitions(rows, orders.columns, "month", path)
    merged = sketches.distinct_estimates(sketches.stored_sketches(spark, path))
    return _within_bound(
        merged, metrics.distinct_count(orders), "distinct_estimate", sketches.standard_error())


@query
def sketch_compare(spark, d):
    """Both sides from sketches: the renamed key column agrees, the orphan keys show."""
    names = {"CUSTOMER_KEY": "o_custkey", "O_ORDERKEY": "o_orderkey", "O_ORDERSTATUS": "o_orderstatus"}
    source = sketches.column_sketches(_orders(spark, d), list(names.values()))
    shifted = _orders_target(spark, d).withColumn("O_ORDERKEY", F.col("O_ORDERKEY") * 3 + 1)
    target = sketches.column_sketches(shifted, list(names), renamed=names)
    return sketches.compare_sketches(source, target).select("column_name", "status")


def _min_max_sum(frame, extremes, sums):
    return metrics.column_metrics(frame, extremes=extremes, sums=sums).select(
        "column_name", "metric", F.col("value").cast("double").alias("value")
    )


@query
def min_max(spark, d):
    return _min_max_sum(
        fx.read(spark, d, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"], [],
    )


@query
def sum_recon(spark, d):
    return _min_max_sum(
        fx.read(spark, d, "lineitem"), [], ["l_quantity", "l_extendedprice", "l_quantity"]
    )


@query
def metric_compare(spark, d):
    source = projection.clean_headers(_orders(spark, d))
    target = projection.clean_headers(_orders_target(spark, d))
    renamed = {"customer_key": "o_custkey"}
    sides = [
        metrics.column_metrics(
            frame, nulls=["o_orderstatus", key], extremes=["o_totalprice", key],
            sums=["o_totalprice"], renamed=renamed,
        ).unionByName(
            metrics.distinct_metrics(frame, ["o_orderstatus", "o_orderkey", key], renamed)
        )
        for frame, key in ((source, "o_custkey"), (target, "customer_key"))
    ]
    return metrics.compare_metrics(*sides)


@query
def metric_edges(spark, d):
    """NaN, infinity and values beyond any decimal are reported, not lost."""
    orders = _orders(spark, d).select(
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("nan")))
        .otherwise(F.col("o_orderkey").cast("double")).alias("a"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(1e30))
        .otherwise(F.col("o_orderkey").cast("double")).alias("b"),
        F.col("o_orderkey").cast("double").alias("c"),
    )
    source = metrics.column_metrics(
        orders, extremes=["a", "b", "c"], sums=["a", "c"], nans=["a", "b"])
    target = metrics.column_metrics(
        orders.withColumn("a", F.expr("nullif(a, double('nan'))")),
        extremes=["a", "b", "c"], sums=["a", "c"], nans=["a", "b"])
    return metrics.compare_metrics(source, target).select("column_name", "metric", "is_match")


@query
def value_distribution(spark, d):
    return metrics.value_distribution(
        fx.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    ).unionByName(
        metrics.value_distribution(fx.read(spark, d, "events"), ["event_type"])
    ).orderBy("column_name", F.desc("value_count"))


@query
def value_distribution_compare(spark, d):
    source = metrics.value_distribution(_orders(spark, d), ["o_orderstatus"])
    target = metrics.value_distribution(
        projection.clean_headers(_orders_target(spark, d)), ["o_orderstatus"]
    )
    return metrics.compare_distributions(source, target)


@query
def duplicate_keys(spark, d):
    return metrics.duplicate_keys(
        fx.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query
def duplicate_keys_target(spark, d):
    return metrics.duplicate_keys(
        projection.clean_headers(_orders_target(spark, d)), ["o_orderkey"], ordered=False
    )


@query
def key_candidates(spark, d):
    return metrics.key_candidates(
        fx.read(spark, d, "lineitem"),
        [["l_orderkey"], ["l_orderkey", "l_linenumber"],
         ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]],
    ).unionByName(metrics.key_candidates(
        projection.clean_headers(_orders_target(spark, d)), [["o_orderkey"], ["o_orderstatus"]]
    ))


@query
def key_discovery(spark, d):
    """Single and composite keys that nobody names."""
    found = None
    for name in ("lineitem", "orders", "customer", "labels"):
        one = keys.discover_keys(fx.read(spark, d, name)).withColumn("table", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


@query
def business_checks(spark, d):
    checks = [
        metrics.BusinessCheck("price_positive", ("o_totalprice",), "o_totalprice > 100000",
                              "error"),
        metrics.BusinessCheck("status_known", ("o_orderstatus",),
                              "o_orderstatus IN ('O', 'F')"),
        metrics.BusinessCheck("no_such", ("imaginary",), "imaginary > 0", "info"),
    ]
    frame = projection.clean_headers(_orders_target(spark, d))
    return metrics.business_checks(frame, checks)


# --- keys and sets -------------------------------------------------------------------------------


@query
def missing_rows(spark, d):
    return reconcile.missing_rows(
        _orders(spark, d), fx.read(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"]
    )


@query
def missing_rows_null_aware(spark, d):
    # half-labelled documents hold NULL keys on the right, so NOT IN finds nothing there
    labelled = fx.read(spark, d, "labels").select(
        F.when(F.col("toxic") == 0, F.col("doc_id")).alias("doc_id"))
    documents = fx.read(spark, d, "documents")
    strict = reconcile.missing_rows(documents, labelled, ["doc_id"], nulls="not_in")
    plain = reconcile.missing_rows(
        documents, fx.read(spark, d, "labels"), ["doc_id"], nulls="not_in"
    )
    return strict.withColumn("target", F.lit("with_nulls")).unionByName(
        plain.withColumn("target", F.lit("without_nulls"))
    )


@query
def missing_rows_composite(spark, d):
    target = projection.clean_headers(_orders_target(spark, d))
    return reconcile.missing_rows(
        _orders(spark, d), target, ["o_orderkey", "o_orderstatus"], nulls="not_exists"
    )


@query
def orphan_rows(spark, d):
    target = projection.clean_headers(_orders_target(spark, d))
    return reconcile.orphan_rows(_orders(spark, d), target, ["o_orderkey"])


@query
def key_difference(spark, d):
    target = projection.clean_headers(_orders_target(spark, d))
    return reconcile.key_difference(_orders(spark, d), target, ["o_orderkey"])


@query
def key_intersection(spark, d):
    return reconcile.key_intersection(
        fx.read(spark, d, "documents"), fx.read(spark, d, "labels"), ["doc_id"]
    )


@query
def surplus_rows(spark, d):
    source, target = _orders(spark, d), _orders_target(spark, d)
    return reconcile.surplus_rows(source, target, _order_pairs(source, target))


@query
def same_rows(spark, d):
    source, target = _orders(spark, d), _orders_target(spark, d)
    changed = reconcile.same_rows(source, target, _order_pairs(source, target))
    again = fx.read(spark, d, "lineitem")
    lines = reconcile.same_rows(again, again, projection.pair_columns(again, again))
    return changed.withColumn("table", F.lit("orders")).unionByName(
        lines.withColumn("table", F.lit("lineitem"))
    )


# --- projections and filters ------------------------------------------------------------------------


@query
def active_rows(spark, d):
    return projection.clean_headers(
        projection.active_rows(fx.derive(spark, d, fx.ORDERS_TARGET))
    ).select("o_orderkey", "o_totalprice")


@query
def drop_excluded(spark, d):
    frame = projection.clean_headers(fx.derive(spark, d, fx.ORDERS_TARGET))
    names = projection.excluded_names(["MIGRATED_AT"], ["data_quality_score", "o_orderdate"])
    return projection.drop_excluded(frame, names)


@query
def incremental_window(spark, d):
    low, high = datetime.datetime(1996, 1, 1), datetime.datetime(1996, 12, 31)
    sides = []
    for frame, column, name in (
        (_orders(spark, d), "o_orderdate", "source"),
        (projection.clean_headers(_orders_target(spark, d)), "o_orderdate", "target"),
    ):
        for load_type in ("incremental", "historical"):
            rows = projection.load_window(frame, load_type, column, low, high)
            sides.append(
                rows.agg(F.count(F.lit(1)).alias("row_count")).select(
                    F.lit(name).alias("side"), F.lit(load_type).alias("load_type"), "row_count"
                )
            )
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out


@query
def normalised_projection(spark, d):
    source, target = _orders(spark, d), _orders_target(spark, d)
    pairs = _order_pairs(source, target)
    rows = projection.normalised(target, pairs, "target")
    found = projection.find_column(rows, "O_ORDERKEY")
    return rows.withColumnRenamed(found, "o_orderkey_normalized")


@query
def ordered_export(spark, d):
    frame = fx.read(spark, d, "customer")
    pairs = projection.pair_columns(frame, frame)
    return projection.ordered_export(frame, pairs, ["c_custkey"], "source")


# --- normalisation rules -------------------------------------------------------------------------------


def _rule(table: str, key: str, out: Callable[[], F.Column], name: str) -> None:
    def run(spark, d):
        return fx.read(spark, d, table).select(key, nz.with_null_token(out()).alias("text"))

    QUERIES[f"normalise_{name}"] = run


_rule("orders", "o_orderkey",
      lambda: nz.boolean(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "O")),
      "boolean")
_rule("lineitem", "l_orderkey", lambda: nz.boolean(F.col("l_linenumber") % 3), "boolean_bit")
_rule("lineitem", "l_orderkey", lambda: nz.integer(F.col("l_quantity"), _double()), "integer")
_rule("orders", "o_orderkey", lambda: nz.numeric(F.col("o_totalprice")), "numeric")
_rule("events", "event_id",
      lambda: nz.timestamp_tz(F.timestamp_micros(F.col("event_id") * 86399123456)),
      "timestamp_tz")
_rule("events", "event_id", lambda: nz.timestamp_ntz(F.col("ts")), "timestamp_ntz")
_rule("orders", "o_orderkey", lambda: nz.date(F.col("o_orderdate")), "date")
_rule("documents", "doc_id", lambda: nz.text(F.concat(F.lit("  "), F.col("text"), F.lit(" "))),
      "text")
_rule("customer", "c_custkey",
      lambda: nz.uuid(F.concat(F.lit(" "), F.md5(F.col("c_name")))), "uuid")
_rule("events", "event_id", lambda: nz.json(F.col("props")), "json")
_rule("documents", "doc_id", lambda: nz.binary(F.col("text").cast("binary")), "binary")
_rule("customer", "c_custkey",
      lambda: nz.hstore(F.concat(F.lit(' "n"=>"'), F.col("c_name"), F.lit('" '))), "hstore")
_rule("orders", "o_orderkey",
      lambda: nz.plain(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey"))),
      "null_placeholder")
_rule("pages", "page_id", lambda: nz.xml(F.col("html")), "xml")


def _double():
    from pyspark.sql.types import DoubleType

    return DoubleType()


@query
def normalise_map(spark, d):
    pairs = F.create_map(F.lit("z"), F.col("c_name"), F.lit("a"), F.col("c_mktsegment"))
    return fx.read(spark, d, "customer").select(
        "c_custkey", nz.with_null_token(nz.sorted_map(pairs)).alias("text")
    )


@query
def normalise_by_column_name(spark, d):
    pairs = F.concat(
        F.lit(' "seg" => "'), "c_mktsegment", F.lit('", "name"=>"'), "c_name",
        F.lit('", "seg"=>"last" '),
    )
    text = F.concat(F.lit(' {"b": '), F.col("c_custkey").cast("string"),
                    F.lit(', "a": [1, 2]} '))
    return fx.read(spark, d, "customer").select(
        "c_custkey",
        nz.by_column_name(pairs, "tags_hstore").alias("hstore_text"),
        nz.by_column_name(text, "doc_json").alias("json_text"),
        nz.by_column_name(F.concat(F.col("c_name"), F.lit("\t")), "name").alias("plain_text"),
    )


@query
def normalise_early_dialect(spark, d):
    flag = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "O")
    return _orders(spark, d).select(
        "o_orderkey", nz.with_null_token(nz.boolean(flag, "TRUE", "FALSE"), "").alias("text")
    )


# --- rules and types ---------------------------------------------------------------------------------------


def _source_catalog(spark, d):
    return fx.derive(spark, d, fx.SOURCE_CATALOG)


def _target_catalog(spark, d):
    return fx.derive(spark, d, fx.TARGET_CATALOG)


@query
def assign_rules(spark, d):
    """Every source column type against every type of the target column of its position."""
    s = _source_catalog(spark, d).select("table", "ordinal", "name", F.col("type").alias("st"))
    t = _target_catalog(spark, d).select("table", "ordinal", F.col("type").alias("tt"))
    return s.join(t, ["table", "ordinal"]).select(
        "table", "ordinal", "name", RuleBook().assign(F.col("st"), F.col("tt")).alias("rule")
    )


@query
def custom_rules(spark, d):
    book = RuleBook().register("level", [("SMALLINT", "*")], lambda c, t: nz.plain(c),
                               before="boolean")
    book = book.register_template("shout", [("TEXT", "VARCHAR")], "upper(trim({col}))")
    rows = _source_catalog(spark, d).select(
        "table", "ordinal", book.assign(F.col("type"), F.lit("VARCHAR")).alias("rule"), "name",
        book.named("shout").apply("name").alias("shouted"),
    )
    return rows


@query
def canonical_types(spark, d):
    size = F.col("p_size")
    raw = (
        F.when(size % 6 == 0, "NVARCHAR").when(size % 6 == 1, "decimal(10, 2)")
        .when(size % 6 == 2, "datetimeoffset").when(size % 6 == 3, " Struct (x) ")
        .when(size % 6 == 4, "tinyint").otherwise("geometry")
    )
    return fx.read(spark, d, "part").select(
        "p_partkey", raw.alias("native"),
        cat.canonical_type(raw, "sqlserver").alias("from_sqlserver"),
        cat.canonical_type(raw, "athena").alias("from_athena"),
        cat.canonical_type(raw, "postgresql").alias("from_postgresql"),
    )


@query
def column_catalog(spark, d):
    """Catalog of real tables next to the NULL share and distinct values of each column."""
    tables = {n: fx.read(spark, d, n) for n in ("orders", "lineitem", "events")}
    rows = cat.column_catalog(spark, tables, "source", {"orders": ["o_orderkey"]})
    found = None
    for name, frame in tables.items():
        one = metrics.null_percent(frame).withColumn("table", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return rows.join(
        found.withColumnRenamed("column_name", "name"), ["table", "name"]
    ).select("table", "ordinal", "name", "type", "is_key", "null_pct", "total_rows")


# --- names and matching -----------------------------------------------------------------------------------


@query
def name_key(spark, d):
    return fx.read(spark, d, "part").select(
        "p_partkey", nm.name_key(F.col("p_name")).alias("name_key"),
        nm.same_name(F.col("p_name"), F.upper(F.replace(F.col("p_name"), F.lit(" "),
                                                        F.lit("_")))).alias("same"),
    )


@query
def exact_match(spark, d):
    return matching.exact_match(
        _source_catalog(spark, d), _target_catalog(spark, d),
        fx.derive(spark, d, fx.CONFIGURED),
    ).select("table", "source_column", "target_column", "match_method")


@query
def unmatched_targets(spark, d):
    source, target = _source_catalog(spark, d), _target_catalog(spark, d)
    return matching.unmatched_targets(matching.exact_match(source, target), target).select(
        "table", "name"
    )


@query
def fuzzy_top_n(spark, d):
    out = matching.fuzzy_candidates(_source_catalog(spark, d), _target_catalog(spark, d))
    return out.select(
        "table", "source_column", "target_column",
        F.round("fuzzy_score", 6).alias("fuzzy_score"), "candidate_rank",
        nm.score_band(F.col("fuzzy_score")).alias("band"),
    )


@query
def edit_similarity(spark, d):
    source = _source_catalog(spark, d).withColumnRenamed("name", "s_name")
    target = _target_catalog(spark, d).withColumnRenamed("name", "t_name")
    a, b = nm.name_key(F.col("s_name")), nm.name_key(F.col("t_name"))
    return source.join(target, ["table", "ordinal"]).select(
        "table", "ordinal", F.round(nm.edit_similarity(a, b), 6).alias("similarity"),
        F.round(nm.similarity(a, b), 6).alias("lcs_similarity"),
        nm.within_one_edit(a, b).alias("within_one_edit"),
    )


@query
def confidence(spark, d):
    source, target = _source_catalog(spark, d), _target_catalog(spark, d)
    scored = matching.score_candidates(
        matching.fuzzy_candidates(source, target, 1), matching.table_sizes(source, target),
        fx.derive(spark, d, fx.LEARNED),
    )
    return scored.select(
        "table", "source_column", "target_column",
        *[
            round_even(F.col(c), 3).cast("double").alias(name)
            for c, name in (
                ("fuzzy_score", "name_similarity"),
                ("type_compatibility", "type_compatibility"),
                ("position_proximity", "position_proximity"),
                ("learned_example", "learned_example"), ("confidence", "final_score"),
            )
        ],
        "reason",
    )


def _decisions(spark, d):
    learned = fx.derive(spark, d, fx.LEARNED).filter(F.col("target_type") == "NUMBER")
    return matching.match_columns(
        _source_catalog(spark, d), _target_catalog(spark, d),
        fx.derive(spark, d, fx.CONFIGURED), learned,
    )


@query
def match_decisions(spark, d):
    return _decisions(spark, d).select(
        "table", "ordinal", "source_column", "target_column", "match_method",
        F.round("confidence", 4).alias("confidence"), "decision", "needs_review", "skip",
        "skip_reason",
    )


@query
def mapping_plan(spark, d):
    keys = _source_catalog(spark, d).filter("is_key").select("table", "name", "key_ordinal")
    return plan.build_mapping(_decisions(spark, d), "bronze", keys).select(
        "table", "source_column", "target_column", "rule", "is_key", "key_ordinal", "decision"
    )


@query
def key_agreement(spark, d):
    return matching.key_agreement(_source_catalog(spark, d), _target_catalog(spark, d))


@query
def conflicting_targets(spark, d):
    return matching.conflicting_targets(fx.derive(spark, d, fx.TABLE_MAP))


@query
def match_tables(spark, d):
    return matching.match_tables(
        fx.derive(spark, d, fx.SOURCE_TABLES), fx.derive(spark, d, fx.TARGET_TABLES)
    )


@query
def suggest_targets(spark, d):
    confirmed = windows.latest_per_key(
        fx.derive(spark, d, fx.CONFIRMED), ["source_table"], [F.desc("confirmed_at")]
    )
    return matching.suggest_targets(
        fx.derive(spark, d, fx.SOURCE_TABLES), fx.derive(spark, d, fx.TARGET_TABLES), confirmed
    )


@query
def learned_top_k(spark, d):
    target = F.regexp_replace(F.upper("name"), "E", "")
    requests = _source_catalog(spark, d).select(
        F.concat_ws(".", "table", "name").alias("request_id"), "name", "type",
        F.array(target).alias("target_names"), F.array(F.lit("VARCHAR")).alias("target_types"),
    )
    return matching.relevant_examples(requests, fx.derive(spark, d, fx.LEARNED))


@query
def row_numbers(spark, d):
    """Numbers over all orders by price, then key: no task holds more than a range of them."""
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return numbering.numbered(_orders(spark, d), order, "place").select("o_orderkey", "place")


@query
def learned_log(spark, d):
    """The learned log, written and read again: the latest correction of each pair, in their order."""
    path = folders.new_folder(spark, "learned")
    corrections = _corrections(spark, d)
    sinks.append_learned(corrections, path)
    return sinks.learned(spark, path).select("seq", "source_column", "target_column", "reason")


def _corrections(spark, d):
    """One correction per order; orders of some customers correct the same pair."""
    return _orders(spark, d).select(
        F.concat(F.lit("s"), F.col("o_custkey") % 97).alias("source_column"),
        F.concat(F.lit("T"), F.col("o_custkey") % 5).alias("target_column"),
        F.lit("int").alias("source_type"), F.lit("NUMBER").alias("target_type"),
        F.lit("integer").alias("correct_rule"), F.col("o_orderkey").cast("string").alias("reason"),
        F.lit("orders").alias("table_name"),
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey"))).alias("corrected_at"),
    )


@query
def latest_per_key(spark, d):
    return windows.latest_per_key(
        fx.read(spark, d, "events").select("user_id", "event_id", "ts", "event_type"),
        ["user_id"], [F.desc("ts"), F.desc("event_id")],
    )


@query
def learned_upsert(spark, d):
    stored = fx.derive(spark, d, fx.LEARNED)
    fresh = stored.filter(F.col("source_type") == "jsonb").select(
        "seq", F.upper("source_column").alias("source_column"),
        F.lower("target_column").alias("target_column"), "source_type", "target_type",
        F.lit("json").alias("correct_rule"), "reason", "table_name", "corrected_at",
    )
    return sinks.upsert_learned(stored, fresh).select(
        "source_column", "target_column", "correct_rule", "table_name"
    )


# --- classification and policy ----------------------------------------------------------------------------


@query
def classify_columns(spark, d):
    return classify.classify(_source_catalog(spark, d)).select(
        "table", "name", "column_group", "business_key", "has_precision"
    )


@query
def select_checks(spark, d):
    return classify.select_checks(classify.classify(_source_catalog(spark, d)))


@query
def table_profile(spark, d):
    return classify.table_profile(classify.classify(_source_catalog(spark, d)))


POLICY = {
    "table_specific_exclusions": {
        "TABLE_1": {
            "source_database": "mssql",
            "exclusions": [{"column_name": "UTS", "reason": "row version"}],
        },
        "table_2": {
            "exclusions": [
                {"source_column_names": ["customer_ssn"], "reason": "not migrated",
                 "applies_to": ["target"]},
            ],
        },
    },
    "type_based_exclusions": {
        "rules": [
            {"source_types": ["bytea"], "target_types": ["BINARY"], "reason": "binary payload"},
            {"source_types": ["text"], "target_types": ["VARCHAR"], "enabled": False},
        ]
    },
    "database_specific_exclusions": {
        "mssql": [{"column_name": "uTS", "reason": "row version column"},
                  {"pattern": "tmp_", "reason": "work column"}],
    },
    "compliance_exclusions": {
        "pii": {"enabled": True, "patterns": ["ssn", "[bad"], "reason": "PII policy"},
        "pci": {"enabled": False, "patterns": ["card"], "reason": "PCI policy"},
    },
    "pattern_exclusions": {
        "patterns": [{"pattern": "^_FIVETRAN_.*", "reason": "load metadata"}],
    },
    "global_exclusions": {
        "columns": [{"column_name": "UTS", "reason": "row version anywhere",
                     "applies_to": ["source"]}],
    },
    "user_global_exclusions": [{"column_name": "card_number", "reason": "user choice"}],
}


@query
def exclusions(spark, d):
    columns = fx.derive(spark, d, fx.EXCLUSION_COLUMNS)
    rules = policy.ExclusionPolicy.from_config(POLICY)
    out = None
    for side in ("both", "source", "target"):
        one = policy.decide_exclusions(columns, rules, side).withColumn("asked", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out


@query
def exclusions_default(spark, d):
    return policy.decide_exclusions(
        fx.derive(spark, d, fx.EXCLUSION_COLUMNS), policy.ExclusionPolicy.default()
    )


@query
def schema_presence(spark, d):
    return presence.schema_presence(_source_catalog(spark, d), _target_catalog(spark, d)).select(
        "table", "column_name", "target_column", "presence", "category", "reason"
    )


@query
def generated_rules(spark, d):
    found = presence.schema_presence(_source_catalog(spark, d), _target_catalog(spark, d))
    rules = policy.generated_rules(found)
    # the generated rules exclude exactly the one-sided columns they were made for
    columns = found.select("table", "column_name", "source_type", "target_type",
                           F.lit("postgresql").alias("source_db"))
    decided = policy.decide_exclusions(
        columns, policy.ExclusionPolicy(), table_rules=rules
    )
    return decided.select("table", "column_name", "excluded", "rule_type")


@query
def target_only(spark, d):
    found = presence.schema_presence(_source_catalog(spark, d), _target_catalog(spark, d))
    return found.filter(F.col("presence") == "target_only").groupBy("category").agg(
        F.count(F.lit(1)).alias("columns")
    )


@query
def column_names(spark, d):
    return presence.all_column_names(_source_catalog(spark, d), _target_catalog(spark, d))


@query
def skip_verdict(spark, d):
    return policy.classify_skips(fx.derive(spark, d, fx.SKIPS)).select(
        "table", "ordinal", "column_name", "category", "verdict", "message"
    )


@query
def skip_partition(spark, d):
    return policy.skip_counts(policy.classify_skips(fx.derive(spark, d, fx.SKIPS)))


@query
def promote_status(spark, d):
    skips = policy.skip_counts(policy.classify_skips(_mapping_skips(spark, d)))
    return policy.promote(fx.derive(spark, d, fx.TABLE_RESULTS), skips)


def _mapping(spark, d):
    return fx.derive(spark, d, fx.MAPPING)


def _mapping_skips(spark, d):
    return _mapping(spark, d).filter("skip").select(
        "table", F.col("source_column").alias("column_name"), "skip_reason",
        F.col("source_type").alias("data_type"),
    )


@query
def run_status(spark, d):
    return runs.status_counts(promote_status(spark, d))


@query
def skip_report(spark, d):
    # tables whose plan cannot be read have no coverage rows
    mapping = _mapping(spark, d).filter(~F.col("table").endswith("9"))
    return runs.skip_report(
        fx.derive(spark, d, fx.TABLE_RESULTS), coverage.column_coverage(mapping),
        policy.skip_counts(policy.classify_skips(_mapping_skips(spark, d))),
    )


# --- presence, coverage and plans ------------------------------------------------------------------------


@query
def table_presence(spark, d):
    return presence.table_presence(
        fx.derive(spark, d, fx.SOURCE_TABLES), fx.derive(spark, d, fx.TARGET_TABLES),
        fx.derive(spark, d, fx.TABLE_EXCLUSIONS),
    )


@query
def presence_failures(spark, d):
    return presence.presence_failures(table_presence(spark, d)).select(
        "table", "validation_type", "status", "source_count"
    )


@query
def column_coverage(spark, d):
    return coverage.headline(coverage.column_coverage(_mapping(spark, d)))


@query
def batch_coverage(spark, d):
    return coverage.batch_coverage(coverage.column_coverage(_mapping(spark, d)))


@query
def low_coverage_tables(spark, d):
    # in every tenth table a quarter of the columns is skipped
    thin = F.col("table").endswith("3") & (F.col("ordinal") % 4 == 0)
    mapping = _mapping(spark, d).withColumn("skip", F.col("skip") | thin)
    return coverage.low_coverage_tables(coverage.column_coverage(mapping))


def _two_sided(spark, d):
    return coverage.two_sided_coverage(
        presence.schema_presence(_source_catalog(spark, d), _target_catalog(spark, d))
    )


@query
def bidirectional_coverage(spark, d):
    share = ["source_coverage", "target_coverage", "overall_coverage"]
    out = _two_sided(spark, d)
    return out.select(
        *[c for c in out.columns if c not in share], *[F.round(c, 4).alias(c) for c in share]
    )


@query
def schema_health(spark, d):
    return coverage.schema_health(_two_sided(spark, d)).select(
        "table", F.round("overall_coverage", 4).alias("overall_coverage"), "is_low",
        F.concat_ws(" | ", "warnings").alias("warnings"),
        F.concat_ws(" | ", "recommendations").alias("recommendations"),
    )


@query
def plan_status(spark, d):
    doubt = _mapping(spark, d).filter("needs_review").select(
        "table", F.col("source_column").alias("column_name")
    )
    return plan.plan_status(_mapping(spark, d)).withColumn("asked", F.lit("plain")).unionByName(
        plan.plan_status(_mapping(spark, d), doubt).withColumn("asked", F.lit("with_doubt"))
    )


@query
def plan_statistics(spark, d):
    return plan.plan_statistics(_mapping(spark, d))


@query
def plan_checks(spark, d):
    return plan.check_plans(fx.derive(spark, d, fx.PLAN_HEADERS), _mapping(spark, d)).select(
        "table", "is_valid", F.concat_ws(" | ", "issues").alias("issues"),
        F.concat_ws(" | ", "warnings").alias("warnings"),
    )


@query
def batch_run(spark, d):
    """Several table pairs in one run, one of them broken."""
    tasks = [
        runs.TableTask("orders", _orders(spark, d), fx.derive(spark, d, fx.ORDERS_TARGET),
                       ["o_orderkey"], RENAMED),
        runs.TableTask("customer", fx.read(spark, d, "customer"),
                       fx.derive(spark, d, fx.CUSTOMER_TARGET), ["c_custkey"]),
        runs.TableTask("part", {"path": f"{d}/part.parquet"}, {"path": f"{d}/part.parquet"},
                       validation_type="count_validation"),
        runs.TableTask("ghost", {"path": f"{d}/no_such_table.parquet"},
                       {"path": f"{d}/part.parquet"}, ["p_partkey"]),
    ]
    return runs.batch_results(spark, tasks).drop("error")


@query
def profile_checks(spark, d):
    """Catalog, classes, selected checks and their results for lineitem and orders."""
    found = None
    for table in ("lineitem", "orders"):
        frame = fx.read(spark, d, table)
        selected = classify.select_checks(
            classify.classify(cat.column_catalog(spark, {table: frame}, "source")))
        rows = checks.run_checks(frame, selected, table)
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("value", F.round("value", 2))


@query
def mapped_diff_orders(spark, d):
    """Catalogs, match decisions, mapping plan and the diff that the plan asks for."""
    source, target = _orders(spark, d), _orders_target(spark, d)
    catalogs = [
        cat.column_catalog(spark, {"orders": frame}, side, {"orders": keys})
        for frame, side, keys in ((source, "source", ORDER_KEY), (target, "target", []))
    ]
    wish = spark.createDataFrame(
        [("orders", s, t) for s, t in RENAMED.items()],
        "table string, source_column string, target_column string")
    decisions = matching.match_columns(*catalogs, wish)
    mapping = plan.build_mapping(
        decisions, source_keys=catalogs[0].filter("is_key").select("table", "name", "key_ordinal"))
    pairs, keys = checks.planned_pairs(mapping, "orders")
    return reconcile.mismatches_per_column(reconcile.ledger(source, target, pairs, keys))


@query
def resumed_run(spark, d):
    """A run in two sittings: the second one reads what the first has stored and does the rest."""
    path, tasks = folders.new_folder(spark, "runs"), _run_tasks(spark, d)
    run_store.run_stored(spark, tasks[:2], path, "nightly")
    store = run_store.run_stored(spark, tasks, path, "nightly", mismatches=True)
    return store.results().select(
        "table_no", "table", "validation_type", "status", "mode", "source_count", "attempt"
    )


@query
def run_report(spark, d):
    """The stored coverage report of a run: statuses before and after promotion, skips by verdict."""
    store = run_store.run_stored(
        spark, _run_tasks(spark, d), folders.new_folder(spark, "runs"), "nightly")
    skips = policy.skip_counts(policy.classify_skips(fx.derive(spark, d, fx.RUN_SKIPS)))
    run_store.write_report(store, coverage.column_coverage(_mapping(spark, d)), skips)
    return store.report("coverage").select(
        "table", "original_status", "effective_status", "validated_columns", "coverage")


def _run_tasks(spark, d):
    return [
        runs.TableTask("orders", _orders(spark, d), fx.derive(spark, d, fx.ORDERS_TARGET),
                       ["o_orderkey"], RENAMED),
        runs.TableTask("customer", fx.read(spark, d, "customer"),
                       fx.derive(spark, d, fx.CUSTOMER_TARGET), ["c_custkey"]),
        runs.TableTask("part", fx.read(spark, d, "part"), fx.read(spark, d, "part"),
                       validation_type="count_validation"),
        runs.TableTask("ghost", {"path": f"{d}/no_such_table.parquet"},
                       {"path": f"{d}/part.parquet"}, ["p_partkey"]),
    ]


@query
def full_run(spark, d):
    """Presence, tasks and promotion in one result: failing, promoted, ERROR and missing tables."""
    tasks = _run_tasks(spark, d)
    found = presence.table_presence(
        fx.derive(spark, d, fx.RUN_SOURCES), fx.derive(spark, d, fx.RUN_TARGETS))
    skips = policy.skip_counts(policy.classify_skips(fx.derive(spark, d, fx.RUN_SKIPS)))
    return runs.full_run(spark, tasks, found, skips).select(
        "table", "validation_type", "status", "original_status", "mode", "source_count"
    )


# --- usage -------------------------------------------------------------------------------------------------


def _usage(spark, d):
    return usage.with_cost(fx.derive(spark, d, fx.USAGE_SPARK), usage.price_table(spark))


@query
def usage_cost(spark, d):
    return usage.usage_rollup(_usage(spark, d)).withColumn("cost", F.round("cost", 4))


TODAY = datetime.date(2024, 2, 2)


@query
def daily_cost(spark, d):
    return usage.daily_cost(_usage(spark, d), TODAY).withColumn("cost", F.round("cost", 4))


@query
def window_usage(spark, d):
    return usage.window_rollup(_usage(spark, d), datetime.date(2024, 1, 20)).withColumns(
        {"cost": F.round("cost", 4), "cost_today": F.round("cost_today", 4)}
    )
