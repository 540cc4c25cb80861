"""DuckDB SQL that says independently what each registered query must return."""

from __future__ import annotations

from itertools import combinations

from evenkeel import fixed_values as fv
from evenkeel.suite import fixtures as fx

ORACLES: dict[str, str] = {}

NULL = fv.NULL_TOKEN


def add(name: str, sql: str) -> None:
    ORACLES[name] = " ".join(sql.split("\n"))


def given(**tables: str) -> str:
    """``WITH`` list of derived inputs."""
    return "WITH " + ", ".join(f"{n} AS ({fx.duck(text)})" for n, text in tables.items())


def text_in(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- orders and their target ---------------------------------------------------------------------

ACTIVE = f"(SELECT * FROM ({fx.duck(fx.ORDERS_TARGET)}) o WHERE _FIVETRAN_ACTIVE = TRUE)"


def money(c: str) -> str:
    return f"coalesce(CAST(round(CAST({c} AS DECIMAL(38,2)), 2) AS VARCHAR), '{NULL}')"


def plain(c: str) -> str:
    return f"coalesce(trim(CAST({c} AS VARCHAR)), '{NULL}')"


def seconds(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '{NULL}')"


VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LEDGER = f"""
WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, {plain('o_custkey')} AS o_custkey,
                  {plain('o_orderstatus')} AS o_orderstatus, {money('o_totalprice')} AS o_totalprice,
                  {seconds('o_orderdate')} AS o_orderdate,
                  {plain('o_orderpriority')} AS o_orderpriority FROM orders),
     t AS (SELECT CAST(O_ORDERKEY AS VARCHAR) AS k, {plain('CUSTOMER_KEY')} AS o_custkey,
                  {plain('O_ORDERSTATUS')} AS o_orderstatus, {money('O_TOTALPRICE')} AS o_totalprice,
                  {seconds('O_ORDERDATE')} AS o_orderdate,
                  {plain('O_ORDERPRIORITY')} AS o_orderpriority FROM {ACTIVE} a),
     sc AS (SELECT k, count(*) AS n FROM s GROUP BY k),
     tc AS (SELECT k, count(*) AS n FROM t GROUP BY k),
     counts AS (SELECT coalesce(sc.k, tc.k) AS k, coalesce(sc.n, 0) AS sn, coalesce(tc.n, 0) AS tn
                  FROM sc FULL JOIN tc ON sc.k = tc.k),
     common AS (SELECT s.k, {', '.join(f's.{v} AS s_{v}, t.{v} AS t_{v}' for v in VALUES)}
                  FROM counts c JOIN s ON s.k = c.k JOIN t ON t.k = c.k WHERE sn = 1 AND tn = 1),
     bad AS (SELECT * FROM common WHERE {' OR '.join(f's_{v} <> t_{v}' for v in VALUES)})
"""
PRESENCE = """
SELECT k AS o_orderkey, sn AS source_rows, tn AS target_rows,
       CASE WHEN tn = 0 THEN 'MISSING_IN_TARGET' ELSE 'MISSING_IN_SOURCE' END AS row_status,
       CASE WHEN tn = 0 THEN 'Row ' || k || ' exists in source but not in target'
            ELSE 'Row ' || k || ' exists in target but not in source' END AS details
  FROM counts WHERE sn = 0 OR tn = 0
UNION ALL
SELECT k, sn, tn, 'DUPLICATE_KEY', 'Row ' || k || ' occurs ' || CAST(sn AS VARCHAR)
       || ' time(s) in source and ' || CAST(tn AS VARCHAR) || ' in target'
  FROM counts WHERE sn > 1 OR tn > 1
"""
add("row_presence_orders", LEDGER + PRESENCE)
ROW_DIFF = LEDGER + PRESENCE + """
UNION ALL SELECT k, 1, 1, 'VALUE_MISMATCH', 'Row ' || k || ' has other values' FROM bad"""
add("row_diff_orders", ROW_DIFF)
add("co_located_diff_orders", ROW_DIFF)
add("cell_diff_orders", LEDGER + " UNION ALL ".join(
    f"SELECT k AS o_orderkey, '{v}' AS column_name, s_{v} AS source_value, t_{v} AS target_value "
    f"FROM bad WHERE s_{v} <> t_{v}" for v in VALUES))
add("wide_diff_orders", LEDGER + "SELECT k AS o_orderkey, " + ", ".join(
    f"CASE WHEN s_{v} <> t_{v} THEN s_{v} END AS {v}_self, "
    f"CASE WHEN s_{v} <> t_{v} THEN t_{v} END AS {v}_other"
    for v in VALUES) + " FROM bad")
add("mismatches_per_column", LEDGER + " UNION ALL ".join(
    f"SELECT '{v}' AS column_name, count(*) AS mismatches FROM bad WHERE s_{v} <> t_{v}"
    for v in VALUES))
add("data_summary_orders", LEDGER + """
SELECT 'data_validation' AS validation_performed, 'orders' AS source_table_name,
       (SELECT count(*) FROM s) AS source_count,
       (SELECT count(*) FROM counts WHERE sn = 0) AS missing_in_source,
       (SELECT count(*) FROM t) AS target_count,
       (SELECT count(*) FROM counts WHERE tn = 0) AS missing_in_target,
       (SELECT count(*) FROM bad) AS value_mismatches,
       (SELECT count(*) FROM counts WHERE sn > 1 OR tn > 1) AS duplicate_keys, 'FAIL' AS status""")
add("cell_diff_customer_clean", """
SELECT count(*) AS source_count, count(*) AS target_count, CAST(0 AS BIGINT) AS missing_in_source,
       CAST(0 AS BIGINT) AS missing_in_target, CAST(0 AS BIGINT) AS value_mismatches,
       CAST(0 AS BIGINT) AS duplicate_keys, 'PASS' AS status FROM customer""")

# --- metrics -----------------------------------------------------------------------------------------

add("row_count", f"SELECT count(*) AS row_count FROM {ACTIVE} a")
COUNTS = f"(SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM {ACTIVE} a) AS t)"
add("count_check", f"""
SELECT s AS source_count, t AS target_count, abs(t - s) AS count_difference,
       CASE WHEN s = t THEN 'PASS' ELSE 'FAIL' END AS status FROM {COUNTS} c""")
add("count_summary", f"""
SELECT 'run' AS run_id, 'count_validation' AS validation_performed, 'orders' AS source_table_name,
       'parquet' AS source_type, 'orders' AS target_table_name, 'parquet' AS target_type,
       s AS source_count, t AS target_count, abs(t - s) AS count_difference,
       CASE WHEN s = t THEN 'PASS' ELSE 'FAIL' END AS status FROM {COUNTS} c""")
add("count_only_check", """
SELECT 'part' AS "table", 'count_validation' AS validation_type, 'count' AS mode,
       count(*) AS source_count, count(*) FILTER (p_partkey % 7 <> 0) AS target_count,
       CASE WHEN count(*) FILTER (p_partkey % 7 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM part""")
add("keyless_validation", given(s=fx.KEYLESS_SOURCE, t=fx.KEYLESS_TARGET) + """
SELECT 'orders' AS "table", 'multiset' AS mode, (SELECT count(*) FROM s) AS source_count,
       (SELECT count(*) FROM t) AS target_count,
       (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) x) AS missing_in_target,
       (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s) x) AS missing_in_source,
       'FAIL' AS status""")
add("uncompared_columns", """
SELECT 'embeddings' AS "table", 'keyed' AS mode,
       CASE WHEN count(*) FILTER (vec_id % 10 = 0 AND embedding <> list_reverse(embedding)) > 0
            THEN 'FAIL' ELSE 'PASS' END AS status, CAST(2 AS INTEGER) AS compared_columns,
       'source.label: no partner in target' AS uncompared_columns, count(*) AS source_count
  FROM embeddings""")
add("edge_values", """
SELECT 'flag' AS column_name,
       count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 5 = 0) AS mismatches FROM orders
UNION ALL SELECT 'big', 0
UNION ALL SELECT 'small', count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 10 <> 4)
  FROM orders""")
add("missing_rows_mixed_types", """
SELECT kind, CAST(o_orderkey AS DOUBLE) AS o_orderkey, count(*) AS source_rows
  FROM orders, (VALUES ('decimal(12,2)'), ('double')) k(kind)
 WHERE o_orderkey % 97 = 0 GROUP BY ALL""")
TARGET_COLUMNS = ["O_ORDERKEY", "CUSTOMER_KEY", "O_ORDERSTATUS", "O_TOTALPRICE", "O_ORDERDATE",
                  "O_ORDERPRIORITY", "_FIVETRAN_ACTIVE", "_FIVETRAN_SYNCED", "MIGRATED_AT",
                  "DATA_QUALITY_SCORE"]


def null_share(c: str, frame: str) -> str:
    return (f"SELECT '{c}' AS column_name, CAST(round(100.0 * sum(CASE WHEN {c} IS NULL THEN 1 "
            f"ELSE 0 END) / count(*), 2) AS DOUBLE) AS null_pct, count(*) AS total_rows FROM {frame}")


add("null_pct", " UNION ALL ".join(null_share(c, f"{ACTIVE} a") for c in TARGET_COLUMNS))
add("distinct_count", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM lineitem"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_returnflag", "l_linestatus", "l_shipdate"]))
add("distinct_count_json", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {e}) AS distinct_count FROM events"
    for c, e in [("event_type", "event_type"), ("user_id", "user_id"),
                 ("props", "CAST(json(props) AS VARCHAR)")]))


def extremes(table: str, columns: list[str], value: str = "CAST({f}({c}) AS DOUBLE)") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{f}' AS metric, {value.format(f=f, c=c)} AS value "
        f"FROM {table}" for c in columns for f in ("min", "max"))


ROWS_OF = ("SELECT '*' AS column_name, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value "
           "FROM {t} UNION ALL ")
add("min_max", ROWS_OF.format(t="lineitem")
    + extremes("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    + " UNION ALL " + extremes("lineitem", ["l_shipdate"], "CAST(epoch({f}({c})) AS DOUBLE)"))
add("sum_recon", ROWS_OF.format(t="lineitem") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'sum' AS metric, "
    f"CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DOUBLE) AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice")))


def side_metrics(frame: str, key: str) -> str:
    parts = [
        f"SELECT '*' AS c, 'row_count' AS m, CAST(count(*) AS DECIMAL(28,6)) AS v FROM {frame}",
        *[
            f"SELECT '{shown}', 'null_pct', CAST(round(100.0 * sum(CASE WHEN {c} IS NULL THEN 1 "
            f"ELSE 0 END) / count(*), 2) AS DECIMAL(28,6)) FROM {frame}"
            for shown, c in (("o_orderstatus", "o_orderstatus"), ("o_custkey", key))
        ],
        *[
            f"SELECT '{shown}', '{f}', CAST({f}({c}) AS DECIMAL(28,6)) FROM {frame}"
            for shown, c in (("o_totalprice", "o_totalprice"), ("o_custkey", key))
            for f in ("min", "max")
        ],
        f"SELECT 'o_totalprice', 'sum', CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS "
        f"DECIMAL(28,6)) FROM {frame}",
        *[
            f"SELECT '{shown}', 'distinct_count', CAST(count(DISTINCT {c}) AS DECIMAL(28,6)) "
            f"FROM {frame}"
            for shown, c in (("o_orderstatus", "o_orderstatus"), ("o_orderkey", "o_orderkey"),
                             ("o_custkey", key))
        ],
    ]
    return " UNION ALL ".join(parts)


add("metric_compare", f"""
WITH a AS ({side_metrics('orders', 'o_custkey')}),
     b AS ({side_metrics(ACTIVE + ' x', 'customer_key')})
SELECT a.c AS column_name, a.m AS metric, CAST(a.v AS DOUBLE) AS source_value,
       CAST(b.v AS DOUBLE) AS target_value, CAST(b.v - a.v AS DOUBLE) AS delta,
       a.v IS NOT DISTINCT FROM b.v AS is_match
  FROM a JOIN b ON a.c = b.c AND a.m = b.m""")
add("value_distribution", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS value_count FROM {t} GROUP BY {c}"
    for t, c in (("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"),
                 ("events", "event_type"))))
add("value_distribution_compare", f"""
WITH a AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1),
     b AS (SELECT O_ORDERSTATUS AS v, count(*) AS n FROM {ACTIVE} x GROUP BY 1)
SELECT 'o_orderstatus' AS column_name, coalesce(a.v, b.v) AS value,
       coalesce(a.n, 0) AS source_count, coalesce(b.n, 0) AS target_count,
       coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(a.n, 0) = coalesce(b.n, 0) AS is_match
  FROM a FULL JOIN b ON a.v IS NOT DISTINCT FROM b.v""")
add("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1 ORDER BY duplicate_count DESC""")
add("duplicate_keys_target", f"""
SELECT O_ORDERKEY AS o_orderkey, count(*) AS duplicate_count FROM {ACTIVE} a GROUP BY 1
HAVING count(*) > 1""")


def candidate(shown: str, frame: str, key: str, columns: list[str]) -> str:
    nulls = " OR ".join(f"{c} IS NULL" for c in columns)
    return (f"SELECT '{shown}' AS candidate, count(*) AS row_count, (SELECT count(*) FROM (SELECT "
            f"DISTINCT {key} FROM {frame}) q) AS distinct_keys, CAST(sum(CASE WHEN {nulls} THEN 1 "
            f"ELSE 0 END) AS BIGINT) AS null_keys FROM {frame}")




def all_within(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, TRUE AS within_bound "
        f"FROM {table}" for c in columns)


add("distinct_count_approx", all_within("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]))
add("distinct_sketches", all_within("orders", [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
add("sketch_compare", """
SELECT 'o_custkey' AS column_name, 'PASS' AS status UNION ALL SELECT 'o_orderstatus', 'PASS'
UNION ALL SELECT 'o_orderkey', 'FAIL'""")
add("key_candidates", "SELECT *, row_count = distinct_keys AND null_keys = 0 AS is_key FROM ("
    + " UNION ALL ".join(
        candidate(",".join(k), f, ", ".join(k), k) for f, k in (
            ("lineitem", ["l_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]),
            ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
            (ACTIVE + " x", ["o_orderkey"]), (ACTIVE + " x", ["o_orderstatus"]))) + ") c")


def minimal_keys(table: str, columns: list[str]) -> str:
    """Every single column, pair and triple is counted; sets with a key inside are left out."""
    sets = [s for n in (1, 2, 3) for s in combinations(columns, n)]
    rows = " UNION ALL ".join(
        f"SELECT {list(s)} AS s, count(DISTINCT ({', '.join(s)})) AS n, count(*) AS rows, "
        f"count_if({' OR '.join(f'{c} IS NULL' for c in s)}) AS nulls FROM {table}" for s in sets)
    return f"""
SELECT array_to_string(k.s, ',') AS candidate, CAST(len(k.s) AS INT) AS n_columns,
       k.rows AS row_count, '{table}' AS "table"
  FROM {table}_keys k WHERE NOT EXISTS (
    FROM {table}_keys o WHERE len(o.s) < len(k.s) AND list_has_all(k.s, o.s))""", f"""
{table}_keys AS (SELECT * FROM ({rows}) x WHERE n = rows AND nulls = 0 AND rows > 0)"""


KEYED = [minimal_keys(t, c) for t, c in {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "labels": ["doc_id", "quality", "toxic"],
}.items()]
add("key_discovery", "WITH " + ",".join(w for _, w in KEYED) + " UNION ALL ".join(q for q, _ in KEYED))
add("business_checks", f"""
SELECT 'price_positive' AS check_name, 'error' AS severity, 'o_totalprice' AS columns,
       count(*) FILTER (WHERE NOT O_TOTALPRICE > 100000) AS failed_rows,
       count(*) FILTER (WHERE O_TOTALPRICE IS NULL) AS unknown_rows, count(*) AS total_rows,
       count(*) FILTER (WHERE NOT O_TOTALPRICE > 100000) = 0 AS passed FROM {ACTIVE} a
UNION ALL
SELECT 'status_known', 'warning', 'o_orderstatus',
       count(*) FILTER (WHERE O_ORDERSTATUS NOT IN ('O', 'F')),
       count(*) FILTER (WHERE O_ORDERSTATUS IS NULL), count(*),
       count(*) FILTER (WHERE O_ORDERSTATUS NOT IN ('O', 'F')) = 0 FROM {ACTIVE} b""")

# --- keys and sets ---------------------------------------------------------------------------------------

add("missing_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, count(*) AS source_rows FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""")
add("missing_rows_null_aware", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS source_rows, 'with_nulls' AS target
  FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN toxic = 0 THEN doc_id END FROM labels)
 GROUP BY 1
UNION ALL
SELECT CAST(doc_id AS VARCHAR), count(*), 'without_nulls' FROM documents
 WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""")
add("missing_rows_composite", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, count(*) AS source_rows
  FROM orders s WHERE NOT EXISTS (SELECT 1 FROM {ACTIVE} t WHERE t.O_ORDERKEY = s.o_orderkey
       AND t.O_ORDERSTATUS = s.o_orderstatus) GROUP BY 1, 2""")
add("orphan_rows", f"""
SELECT CAST(O_ORDERKEY AS VARCHAR) AS o_orderkey, count(*) AS target_rows FROM {ACTIVE} t
 WHERE O_ORDERKEY NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
add("key_difference", f"""
SELECT CAST(k AS VARCHAR) AS o_orderkey, s AS row_status FROM (
  SELECT k, 'MISSING_IN_TARGET' AS s FROM (SELECT o_orderkey AS k FROM orders EXCEPT
         SELECT O_ORDERKEY FROM {ACTIVE} a) x
  UNION ALL
  SELECT k, 'MISSING_IN_SOURCE' FROM (SELECT O_ORDERKEY AS k FROM {ACTIVE} b EXCEPT
         SELECT o_orderkey FROM orders) y) z""")
add("key_intersection", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM (SELECT doc_id FROM documents INTERSECT
SELECT doc_id FROM labels) x""")
SHOWN = ", ".join(f"{c} AS {a}_normalized" for c, a in [("k", "o_orderkey"), *zip(VALUES, VALUES)])
add("surplus_rows", LEDGER + f"""
SELECT {SHOWN}, 'source' AS surplus_side, count(*) AS surplus_rows
  FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) x GROUP BY ALL
UNION ALL
SELECT {SHOWN}, 'target', count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s) y GROUP BY ALL""")
add("same_rows", LEDGER + """
SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) x) AS source_surplus,
       (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s) y) AS target_surplus,
       'FAIL' AS status, 'orders' AS "table"
UNION ALL
SELECT (SELECT count(*) FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem) x),
       CAST(0 AS BIGINT), 'PASS', 'lineitem'""")

add("named_contents_diff", """
SELECT 'doc_json' AS column_name, count(*) AS mismatches FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT 'tags_hstore', count(*) FROM customer WHERE c_custkey % 15 = 0
UNION ALL SELECT 'plain_text', count(*) FROM customer""")
add("mixed_scale_diff", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'amount' AS column_name,
       CAST(CAST((o_orderkey % 50) * 0.001 AS DECIMAL(10,4)) AS VARCHAR) AS source_value,
       CAST(CAST((o_orderkey % 50 + 3) * 0.001 AS DECIMAL(10,4)) AS VARCHAR) AS target_value
  FROM orders WHERE o_orderkey % 7 = 0""")

# --- projections ---------------------------------------------------------------------------------------------

add("active_rows", f"SELECT O_ORDERKEY AS o_orderkey, O_TOTALPRICE AS o_totalprice FROM {ACTIVE} a")
add("drop_excluded", f"""
SELECT O_ORDERKEY AS o_orderkey, CUSTOMER_KEY AS customer_key, O_ORDERSTATUS AS o_orderstatus,
       O_TOTALPRICE AS o_totalprice, O_ORDERPRIORITY AS o_orderpriority
  FROM ({fx.duck(fx.ORDERS_TARGET)}) o""")
IN_1996 = "BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'"
add("incremental_window", " UNION ALL ".join(
    f"SELECT '{side}' AS side, '{kind}' AS load_type, count(*) AS row_count FROM {frame}{where}"
    for side, frame in (("source", "orders"), ("target", ACTIVE + " a"))
    for kind, where in (("incremental", f" WHERE o_orderdate {IN_1996}"), ("historical", ""))))
add("normalised_projection", f"""
SELECT CAST(O_ORDERKEY AS VARCHAR) AS o_orderkey_normalized,
       {plain('CUSTOMER_KEY')} AS o_custkey_normalized,
       {plain('O_ORDERSTATUS')} AS o_orderstatus_normalized,
       {money('O_TOTALPRICE')} AS o_totalprice_normalized,
       {seconds('O_ORDERDATE')} AS o_orderdate_normalized,
       {plain('O_ORDERPRIORITY')} AS o_orderpriority_normalized FROM {ACTIVE} a""")
add("ordered_export", f"""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey_normalized, {plain('c_name')} AS c_name_normalized,
       {plain('c_nationkey')} AS c_nationkey_normalized, {money('c_acctbal')}
       AS c_acctbal_normalized, {plain('c_mktsegment')} AS c_mktsegment_normalized
  FROM customer ORDER BY 1""")

# --- normalisation rules ---------------------------------------------------------------------------------------


def rule(name: str, table: str, key: str, value: str) -> None:
    add(f"normalise_{name}", f"SELECT {key}, coalesce({value}, '{NULL}') AS text FROM {table}")


FLAG = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus = 'O' END"
rule("boolean", "orders", "o_orderkey", f"CASE {FLAG} WHEN TRUE THEN '1' WHEN FALSE THEN '0' END")
rule("boolean_bit", "lineitem", "l_orderkey", "CAST(l_linenumber % 3 AS VARCHAR)")
rule("integer", "lineitem", "l_orderkey", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)")
rule("numeric", "orders", "o_orderkey",
     "CAST(round(CAST(o_totalprice AS DECIMAL(38,2)), 2) AS VARCHAR)")
rule("timestamp_tz", "events", "event_id",
     "strftime(make_timestamp(event_id * 86399123456), '%Y-%m-%d %H:%M:%S')")
rule("timestamp_ntz", "events", "event_id", "strftime(ts, '%Y-%m-%d %H:%M:%S')")
rule("date", "orders", "o_orderkey", "strftime(o_orderdate, '%Y-%m-%d')")
rule("text", "documents", "doc_id", "trim('  ' || text || ' ')")
rule("uuid", "customer", "c_custkey", "upper(md5(c_name))")
rule("json", "events", "event_id", "CAST(json(props) AS VARCHAR)")
rule("binary", "documents", "doc_id", "lower(hex(encode(text)))")
rule("hstore", "customer", "c_custkey", "trim(' \"n\"=>\"' || c_name || '\" ')")
rule("null_placeholder", "orders", "o_orderkey",
     "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END")
rule("xml", "pages", "page_id", "trim(html)")
rule("map", "customer", "c_custkey",
     "'{\"a\":\"' || c_mktsegment || '\",\"z\":\"' || c_name || '\"}'")
add("normalise_by_column_name", """
SELECT c_custkey, '{"name":"' || c_name || '","seg":"last"}' AS hstore_text,
       '{"a":[1,2],"b":' || CAST(c_custkey AS VARCHAR) || '}' AS json_text, c_name AS plain_text
  FROM customer""")
add("normalise_early_dialect", f"""
SELECT o_orderkey, CASE {FLAG} WHEN TRUE THEN 'TRUE' WHEN FALSE THEN 'FALSE' ELSE '' END AS text
  FROM orders""")

# --- rules and types ----------------------------------------------------------------------------------------------

TRIGGERS = [(n, p, s, t) for p, (n, pairs) in enumerate(fv.RULE_TRIGGERS.items())
            for s, t in pairs]
RULE_ROWS = ", ".join(f"({p}, '{n}', '{s}', '{t}')" for n, p, s, t in TRIGGERS)


def duck_type(c: str) -> str:
    c = f"regexp_replace({c}, '\\([^)]*\\)', '', 'g')"
    c = f"regexp_replace({c}, '\\s+without\\s+time\\s+zone', '_NTZ', 'gi')"
    c = f"regexp_replace({c}, '\\s+with\\s+time\\s+zone', '_TZ', 'gi')"
    return f"upper(trim({c}))"


def first_rule(frame: str, keep: str, s: str, t: str) -> str:
    """Rule of lowest priority whose prefixes match, per row of ``frame``."""
    return f"""
SELECT {keep}, (SELECT arg_min(r.name, r.priority) FROM (VALUES {RULE_ROWS})
       r(priority, name, s, t) WHERE (r.s = '*' OR starts_with({duck_type(s)}, r.s))
       AND (r.t = '*' OR starts_with({duck_type(t)}, r.t))) AS rule FROM {frame}"""


CATALOGS = given(src=fx.SOURCE_CATALOG, tgt=fx.TARGET_CATALOG)
add("assign_rules", CATALOGS + first_rule(
    '(SELECT s."table" AS tb, s.ordinal AS o, s.name AS n, s.type AS st, t.type AS tt FROM src s '
    'JOIN tgt t ON s."table" = t."table" AND s.ordinal = t.ordinal) x',
    'tb AS "table", o AS ordinal, n AS name', "st", "tt"))
add("custom_rules", given(src=fx.SOURCE_CATALOG) + """
SELECT "table", ordinal, CASE WHEN type = 'smallint' THEN 'level' WHEN type = 'text' THEN 'shout'
       WHEN type = 'jsonb' THEN 'json' WHEN type = 'bytea' THEN 'bytea'
       WHEN type = 'uuid' THEN 'uuid' WHEN type = 'hstore' THEN 'hstore' ELSE 'text' END AS rule,
       name, upper(trim(name)) AS shouted FROM src""")
NATIVE = """CASE p_size % 6 WHEN 0 THEN 'NVARCHAR' WHEN 1 THEN 'decimal(10, 2)'
 WHEN 2 THEN 'datetimeoffset' WHEN 3 THEN ' Struct (x) ' WHEN 4 THEN 'tinyint' ELSE 'geometry' END"""
add("canonical_types", f"""
SELECT p_partkey, {NATIVE} AS native,
       CASE p_size % 6 WHEN 0 THEN 'character varying' WHEN 1 THEN 'decimal(10, 2)'
            WHEN 2 THEN 'timestamp with time zone' WHEN 3 THEN ' struct (x) '
            WHEN 4 THEN 'smallint' ELSE 'geometry' END AS from_sqlserver,
       CASE p_size % 6 WHEN 0 THEN 'nvarchar' WHEN 1 THEN 'numeric' WHEN 2 THEN 'datetimeoffset'
            WHEN 3 THEN 'json' WHEN 4 THEN 'smallint' ELSE 'geometry' END AS from_athena,
       {NATIVE} AS from_postgresql FROM part""")
REAL_COLUMNS = {
    "orders": ["o_orderkey:bigint", "o_custkey:bigint", "o_orderstatus:string",
               "o_totalprice:double", "o_orderdate:timestamp_ntz", "o_orderpriority:string"],
    "lineitem": ["l_orderkey:bigint", "l_partkey:bigint", "l_suppkey:bigint",
                 "l_linenumber:int", "l_quantity:double", "l_extendedprice:double",
                 "l_discount:double", "l_tax:double", "l_returnflag:string",
                 "l_linestatus:string", "l_shipdate:timestamp_ntz"],
    "events": ["event_id:bigint", "ts:timestamp_ntz", "user_id:bigint", "event_type:string",
               "value:double", "props:string"],
}
add("column_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST({i} AS INT) AS ordinal, '{c.split(':')[0]}' AS name, "
    f"'{c.split(':')[1]}' AS type, {c.startswith('o_orderkey')} AS is_key, CAST(round(100.0 * "
    f"sum(CASE WHEN {c.split(':')[0]} IS NULL THEN 1 ELSE 0 END) / count(*), 2) AS DOUBLE) "
    f"AS null_pct, count(*) AS total_rows FROM {t}"
    for t, cs in REAL_COLUMNS.items() for i, c in enumerate(cs, start=1)))

# --- names and matching -----------------------------------------------------------------------------------------------


def key(c: str) -> str:
    return f"coalesce(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g'), '')"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two short texts."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    masks = (f"list_transform(string_split({b}, ''), lambda ch: CAST(list_sum(list_transform("
             f"range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = ch THEN "
             f"CAST(1 AS BIGINT) << i ELSE CAST(0 AS BIGINT) END)) AS BIGINT))")
    return (f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), "
            f"lambda v, m: ((v + (v & m)) | (v & ~m)) & {full})))")


def ratio(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE "
            f"CAST(2.0 AS DOUBLE) * {lcs(a, b)} / (length({a}) + length({b})) END)")


add("name_key", f"SELECT p_partkey, {key('p_name')} AS name_key, TRUE AS same FROM part")
BY_NAME = 'SELECT "table" AS tb, upper(name) AS u, arg_max(name, ordinal) AS name FROM tgt GROUP BY 1, 2'
BY_KEY = f'SELECT "table" AS tb, {key("name")} AS u, arg_min(name, ordinal) AS name FROM tgt GROUP BY 1, 2'
EXACT = f"""
 by_name AS ({BY_NAME}), by_key AS ({BY_KEY}),
 exact AS (SELECT s."table" AS tb, s.ordinal AS o, s.name AS n, s.type AS st,
                  coalesce(w.name, a.name, b.name) AS tn,
                  CASE WHEN w.name IS NOT NULL THEN 'configured' WHEN a.name IS NOT NULL
                       THEN 'exact' WHEN b.name IS NOT NULL THEN 'normalized_exact' END AS method
             FROM src s LEFT JOIN wish c ON c."table" = s."table" AND upper(c.source_column)
                  = upper(s.name)
             LEFT JOIN by_name w ON w.tb = s."table" AND w.u = upper(c.target_column)
             LEFT JOIN by_name a ON a.tb = s."table" AND a.u = upper(s.name)
             LEFT JOIN by_key b ON b.tb = s."table" AND b.u = {key('s.name')})"""
WITH_WISH = given(src=fx.SOURCE_CATALOG, tgt=fx.TARGET_CATALOG, wish=fx.CONFIGURED)
add("exact_match", WITH_WISH + "," + EXACT + """
SELECT tb AS "table", n AS source_column, tn AS target_column, method AS match_method FROM exact""")
add("unmatched_targets", CATALOGS
    + ", wish AS (SELECT '' AS \"table\", '' AS source_column, '' AS target_column WHERE FALSE),"
    + EXACT + """
SELECT "table", name FROM tgt WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.tb = tgt."table"
   AND upper(e.tn) = upper(tgt.name))""")
SCORED = f"""
 pairs AS (SELECT s."table" AS tb, s.ordinal AS o, s.name AS n, s.type AS st, t.name AS tn,
                  t.type AS tt, t.ordinal AS t_o, {key('s.name')} AS sk, {key('t.name')} AS tk
             FROM {{s}} s JOIN {{t}} t ON s."table" = t."table"),
 scored AS (SELECT *, {ratio('sk', 'tk')} AS score FROM pairs),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY tb, o, n ORDER BY score DESC, t_o, tn)
              AS rk FROM scored)"""
add("fuzzy_top_n", CATALOGS + "," + SCORED.format(s="src", t="tgt") + """
SELECT tb AS "table", n AS source_column, tn AS target_column, round(score, 6) AS fuzzy_score,
       CAST(rk AS INT) AS candidate_rank, CASE WHEN score >= 0.95 THEN 'high'
       WHEN score >= 0.75 THEN 'review' ELSE 'below' END AS band FROM ranked WHERE rk <= 5""")
add("edit_similarity", CATALOGS + f"""
SELECT "table", ordinal, round(1.0 - CAST(levenshtein(a, b) AS DOUBLE)
       / greatest(length(a), length(b)), 6) AS similarity, round({ratio('a', 'b')}, 6)
       AS lcs_similarity, levenshtein(a, b) <= 1 AS within_one_edit
  FROM (SELECT s."table", s.ordinal, {key('s.name')} AS a, {key('t.name')} AS b FROM src s
          JOIN tgt t ON s."table" = t."table" AND s.ordinal = t.ordinal) x""")
COMPAT_ROWS = ", ".join(f"({i}, '{a.upper()}', '{b.upper()}', {v})"
                        for i, (a, b, v) in enumerate(fv.TYPE_COMPATIBILITY))


def bare(c: str) -> str:
    return f"upper(trim(regexp_replace({c}, '\\s*\\([^)]*\\)', '', 'g')))"


FACTORS = f"""
 sizes AS (SELECT tb, greatest(max(s), max(t)) AS total FROM (
             SELECT "table" AS tb, count(*) AS s, 0 AS t FROM src GROUP BY 1 UNION ALL
             SELECT "table", 0, count(*) FROM tgt GROUP BY 1) z GROUP BY tb),
 compat AS (SELECT DISTINCT st, tt, CAST(coalesce(
              (SELECT arg_min(v, i) FROM (VALUES {COMPAT_ROWS}) c(i, a, b, v)
                WHERE a = {bare('st')} AND b = {bare('tt')}),
              (SELECT arg_min(v, i) FROM (VALUES {COMPAT_ROWS}) c(i, a, b, v)
                WHERE starts_with({bare('st')}, a) AND starts_with({bare('tt')}, b)), 0.60)
              AS DOUBLE) AS ty FROM ranked WHERE rk = 1),
 factors AS (SELECT r.*, c.ty, greatest(CAST(0 AS DOUBLE), 1.0 - CAST(abs(o - t_o) AS DOUBLE)
                    / greatest(total - 1, 1)) AS pos,
                    CASE WHEN EXISTS (SELECT 1 FROM learned l WHERE upper(l.source_column)
                         = upper(n) AND upper(l.target_column) = upper(tn)) THEN 1.0 ELSE 0.0
                    END AS ex
               FROM ranked r JOIN sizes z ON z.tb = r.tb JOIN compat c ON c.st = r.st
                    AND c.tt = r.tt WHERE rk = 1),
 judged AS (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), score
                   * CAST(0.40 AS DOUBLE) + ty * CAST(0.35 AS DOUBLE) + pos
                   * CAST(0.10 AS DOUBLE) + CAST(ex AS DOUBLE) * CAST(0.15 AS DOUBLE))) AS conf
              FROM factors)"""
REASON = """CASE WHEN sk = tk THEN 'normalized names are identical (''' || sk || ''')'
 WHEN score >= 0.90 THEN 'normalized names are very similar (''' || sk || ''' ~ ''' || tk
      || ''', score ' || printf('%.2f', score) || ')'
 WHEN score >= 0.75 THEN 'normalized names are similar (''' || sk || ''' ~ ''' || tk
      || ''', score ' || printf('%.2f', score) || ')'
 ELSE 'normalized name similarity is low (''' || sk || ''' vs ''' || tk || ''', score '
      || printf('%.2f', score) || ')' END || '. ' || CASE
 WHEN ty >= 0.95 THEN st || ' → ' || tt || ' is a known compatible type pair'
 WHEN ty >= 0.75 THEN st || ' → ' || tt || ' is a known migration transformation'
 ELSE 'type pair ' || st || ' → ' || tt || ' is not in the catalog' END
 || CASE WHEN ex = 1.0 THEN '. a matching learned example exists' ELSE '' END || '.'"""
add("confidence", given(src=fx.SOURCE_CATALOG, tgt=fx.TARGET_CATALOG, learned=fx.LEARNED) + ","
    + SCORED.format(s="src", t="tgt") + "," + FACTORS + f"""
SELECT tb AS "table", n AS source_column, tn AS target_column, CAST(printf('%.3f', score) AS DOUBLE) AS name_similarity,
       CAST(printf('%.3f', ty) AS DOUBLE) AS type_compatibility, CAST(printf('%.3f', pos) AS DOUBLE) AS position_proximity,
       CAST(ex AS DOUBLE) AS learned_example, CAST(printf('%.3f', conf) AS DOUBLE) AS final_score, {REASON} AS reason
  FROM judged""")
METADATA = "lower(name) LIKE '\\_fivetran\\_%' ESCAPE '\\'"
DECIDED = (
    "WITH src_all AS (" + fx.duck(fx.SOURCE_CATALOG) + "), tgt AS (" + fx.duck(fx.TARGET_CATALOG)
    + "), wish AS (" + fx.duck(fx.CONFIGURED) + "), learned AS (SELECT * FROM ("
    + fx.duck(fx.LEARNED) + ") l WHERE target_type = 'NUMBER'), src AS (SELECT * FROM src_all "
    + f"WHERE NOT {METADATA})," + EXACT + """,
 open_s AS (SELECT tb AS "table", o AS ordinal, n AS name, st AS type FROM exact WHERE tn IS NULL),
 open_t AS (SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.tb = tgt."table"
              AND upper(e.tn) = upper(tgt.name))),"""
    + SCORED.format(s="open_s", t="open_t") + ","
    + FACTORS.replace("FROM src GROUP", "FROM src_all GROUP") + """,
 decided AS (
  SELECT tb AS "table", o AS ordinal, n AS source_column, st AS source_type, tn AS target_column,
         (SELECT max(type) FROM tgt t WHERE t."table" = exact.tb AND t.name = exact.tn) AS
         target_type, method AS match_method, CAST(1 AS DOUBLE) AS confidence,
         'resolved' AS decision, FALSE AS needs_review, FALSE AS skip, NULL AS skip_reason
    FROM exact WHERE tn IS NOT NULL
  UNION ALL
  SELECT tb, o, n, st, CASE WHEN conf >= 0.75 THEN tn END, CASE WHEN conf >= 0.75 THEN tt END,
         CASE WHEN conf >= 0.75 THEN 'fuzzy' END, conf,
         CASE WHEN conf >= 0.75 THEN 'resolved' ELSE 'unmatched' END,
         conf >= 0.75 AND conf < 0.95, conf < 0.75, CASE WHEN conf < 0.75 THEN
         'Best fuzzy candidate score ' || printf('%.2f', conf) || ' below threshold 0.75' END
    FROM judged
  UNION ALL
  SELECT "table", ordinal, name, type, NULL, NULL, NULL, CAST(0 AS DOUBLE), 'unmatched', FALSE,
         TRUE, 'No fuzzy candidates found — column may not exist in target' FROM open_s s
   WHERE NOT EXISTS (SELECT 1 FROM open_t t WHERE t."table" = s."table")
  UNION ALL
  SELECT "table", ordinal, name, type, NULL, NULL, NULL, CAST(0 AS DOUBLE), 'resolved', FALSE,
         TRUE, 'Fivetran metadata column — excluded from validation' FROM src_all
   WHERE """ + METADATA + ")")
add("match_decisions", DECIDED + """
SELECT "table", ordinal, source_column, target_column, match_method,
       round(confidence, 4) AS confidence, decision, needs_review, skip, skip_reason FROM decided""")
add("mapping_plan", DECIDED + ", ruled AS (" + first_rule(
    "decided", '"table" AS tb, ordinal AS o, source_column AS n, target_column AS tn, decision',
    "source_type", "target_type") + """)
SELECT r.tb AS "table", n AS source_column, tn AS target_column, CASE WHEN tn IS NULL THEN 'text'
       ELSE rule END AS rule, s.is_key AS is_key, s.key_ordinal AS key_ordinal, decision
  FROM ruled r JOIN src_all s ON s."table" = r.tb AND s.ordinal = r.o""")
KEYS = ("SELECT \"table\" AS tb, string_agg(" + key("name") + ", ',' ORDER BY key_ordinal) AS ks "
        "FROM {t} WHERE is_key GROUP BY 1")
add("key_agreement", CATALOGS + f""",
 a AS ({KEYS.format(t='src')}), b AS ({KEYS.format(t='tgt')})
SELECT coalesce(a.tb, b.tb) AS "table", a.ks AS source_key, b.ks AS target_key,
       a.ks = b.ks AS agrees, CASE WHEN a.ks <> b.ks THEN 'Source PK [' || a.ks
       || '] does not match target PK [' || b.ks || ']' END AS mismatch_reason
  FROM a FULL JOIN b ON a.tb = b.tb""")
add("conflicting_targets", given(m=fx.TABLE_MAP) + """
SELECT target_table, count(*) AS source_tables, CASE WHEN target_table = '' THEN 'empty_target'
       ELSE 'duplicate_target' END AS problem FROM m GROUP BY 1
HAVING count(*) > 1 OR target_table = ''""")
add("learned_top_k", given(src=fx.SOURCE_CATALOG, l=fx.LEARNED) + f""",
 ex AS (SELECT seq, source_column, target_column, upper(source_column) AS us,
               upper(target_column) AS ut, {key('source_column')} AS k,
               upper(source_type) AS ust, upper(target_type) AS utt FROM l),
 rq AS (SELECT "table" || '.' || name AS request_id, upper(name) AS us, {key('name')} AS k,
               upper(type) AS ust, upper(regexp_replace(upper(name), 'E', '', 'g')) AS want
          FROM src),
 sc AS (SELECT request_id, seq, source_column, target_column,
               CASE WHEN ex.us = rq.us THEN 10 WHEN ex.k = rq.k THEN 6
                    WHEN abs(length(ex.k) - length(rq.k)) <= 1 AND levenshtein(ex.k, rq.k) <= 1
                    THEN 3 ELSE 0 END + CASE WHEN ex.ust = rq.ust THEN 2 ELSE 0 END
               + CASE WHEN ex.ut = rq.want THEN 4 ELSE 0 END
               + CASE WHEN ex.utt = 'VARCHAR' THEN 2 ELSE 0 END AS score FROM rq, ex),
 rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, seq)
          AS example_rank FROM sc WHERE score > 0)
SELECT request_id, seq, source_column, target_column, CAST(score AS INT) AS score,
       CAST(example_rank AS INT) AS example_rank FROM rk WHERE example_rank <= 5""")
add("row_numbers", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""")
add("learned_log", """
SELECT row_number() OVER (ORDER BY max(o_orderkey)) AS seq,
       's' || CAST(o_custkey % 97 AS VARCHAR) AS source_column,
       'T' || CAST(o_custkey % 5 AS VARCHAR) AS target_column,
       CAST(max(o_orderkey) AS VARCHAR) AS reason FROM orders GROUP BY o_custkey % 97, o_custkey % 5""")
add("latest_per_key", """
SELECT user_id, event_id, ts, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
add("learned_upsert", given(l=fx.LEARNED) + """,
 fresh AS (SELECT upper(source_column) AS source_column, lower(target_column) AS target_column,
                  'json' AS correct_rule, table_name FROM l WHERE source_type = 'jsonb'
           QUALIFY row_number() OVER (PARTITION BY upper(source_column), upper(target_column)
                   ORDER BY corrected_at DESC) = 1)
SELECT source_column, target_column, correct_rule, table_name FROM l WHERE NOT EXISTS (
  SELECT 1 FROM fresh f WHERE upper(f.source_column) = upper(l.source_column)
     AND upper(f.target_column) = upper(l.target_column))
UNION ALL SELECT source_column, target_column, correct_rule, table_name FROM fresh""")

# --- classification and policy -------------------------------------------------------------------------------------------

NUMERIC_RE = "^(" + "|".join(fv.NUMERIC_TYPE_PREFIXES) + ")"
TEXT_RE = "^(" + "|".join(fv.TEXT_TYPE_PREFIXES) + ")"


def has_word(words: list[str]) -> str:
    return f"regexp_matches(n, '(^|_)({'|'.join(words)})(_|$)')"


GROUPED = given(src=fx.SOURCE_CATALOG) + f""",
 typed AS (SELECT *, lower(name) AS n, trim(regexp_replace(lower(type), '\\s*\\([^)]*\\)', '', 'g'))
             AS t FROM src),
 grouped AS (SELECT *, CASE WHEN t IN ({text_in(fv.SKIP_TYPES)}) THEN 'skipped'
   WHEN t IN ({text_in(fv.TEMPORAL_TYPES)}) THEN 'temporal'
   WHEN t LIKE '%uuid%' OR n = 'id' OR regexp_matches(n, '_(id|key|code|ref|uuid|guid)$')
     THEN 'identifier'
   WHEN t IN ('boolean', 'bool') OR regexp_matches(n, '^(is|has|can|should|was|will)_')
        OR n IN ({text_in(fv.FLAG_NAMES)}) THEN 'status_flag'
   WHEN regexp_matches(t, '{NUMERIC_RE}') AND {has_word(fv.FINANCIAL_WORDS)}
     THEN 'numeric_financial'
   WHEN regexp_matches(t, '{NUMERIC_RE}') AND {has_word(fv.QUANTITY_WORDS)}
     THEN 'numeric_quantity'
   WHEN regexp_matches(t, '{NUMERIC_RE}') THEN 'numeric_generic'
   WHEN regexp_matches(t, '{TEXT_RE}') AND regexp_matches(n, '(^|_)({'|'.join(fv.ENUM_WORDS)})$')
     THEN 'text_enum' ELSE 'text_generic' END AS g FROM typed)"""
add("classify_columns", GROUPED + """
SELECT "table", name, g AS column_group, g = 'identifier' AND NOT nullable AS business_key,
       g IN ('numeric_financial', 'numeric_quantity', 'numeric_generic') AND coalesce(scale, 0) > 0
       AS has_precision FROM grouped""")
CHECK_ROWS = [
    (0, "row_count", "FALSE"), (1, "data_validation", "FALSE"), (2, "null_pct", "g <> 'skipped'"),
    (3, "distinct_count", "g <> 'skipped'"), (4, "min_max", "g LIKE 'numeric%'"),
    (5, "sum", "g IN ('numeric_financial', 'numeric_quantity')"),
    (6, "duplicate_check", "g = 'identifier' AND NOT nullable"),
    (7, "value_distribution", "g IN ('status_flag', 'text_enum')"),
]
add("select_checks", GROUPED + " UNION ALL ".join(
    f"SELECT \"table\", CAST({i} AS INT) AS check_order, '{c}' AS \"check\", {i} >= 4 AS "
    f"is_conditional, CAST(count(*) FILTER (WHERE {w}) AS INT) AS column_count, "
    f"coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (WHERE {w}), '') AS columns "
    f"FROM grouped GROUP BY 1" + (f" HAVING count(*) FILTER (WHERE {w}) > 0" if i >= 4 else "")
    for i, c, w in CHECK_ROWS))
GROUP_NAMES = ["skipped", "temporal", "identifier", "status_flag", "numeric_financial",
               "numeric_quantity", "numeric_generic", "text_enum", "text_generic"]
add("table_profile", GROUPED + 'SELECT "table", count(*) AS total_columns, ' + ", ".join(
    f"count(*) FILTER (WHERE g = '{g}') AS {g}_columns" for g in GROUP_NAMES) + """,
 count(*) FILTER (WHERE g LIKE 'numeric%') AS numeric_columns,
 count(*) FILTER (WHERE g = 'numeric_financial') > 0 AS has_financial,
 count(*) FILTER (WHERE g = 'temporal') > 0 AS has_temporal,
 count(*) FILTER (WHERE g = 'identifier') > 0 AS has_identifiers,
 count(*) FILTER (WHERE g = 'text_enum') > 0 AS has_enums,
 count(*) FILTER (WHERE g = 'identifier' AND NOT nullable) > 0 AS has_business_keys,
 coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (WHERE g = 'identifier' AND NOT nullable),
   '') AS business_keys FROM grouped GROUP BY 1""")

EXCLUDED = given(c=fx.EXCLUSION_COLUMNS)


def decision(side: str) -> str:
    """Layers of the example policy, spelled out, for one side asked about."""
    def on(condition: str, *sides: str) -> str:
        return condition if side == "both" or side in sides else "FALSE"

    layers = [
        (on("upper(\"table\") = 'TABLE_1' AND source_db = 'mssql' AND upper(column_name) = 'UTS'",
            "source", "target"), "row version", "table_specific", "\"table\" || '.' || column_name"),
        (on("upper(\"table\") = 'TABLE_2' AND upper(column_name) = 'CUSTOMER_SSN'", "target"),
         "not migrated", "table_specific", "\"table\" || '.' || column_name"),
        ("lower(source_type) = 'bytea' AND upper(target_type) = 'BINARY'", "binary payload",
         "type_based", "source_type || '→' || target_type"),
        (on("source_db = 'mssql' AND upper(column_name) = 'UTS'", "source"), "row version column",
         "database_specific", "'mssql.' || column_name"),
        (on("source_db = 'mssql' AND lower(column_name) LIKE 'tmp\\_%' ESCAPE '\\'", "source"),
         "work column", "database_specific_pattern", "'tmp_'"),
        (on("lower(column_name) LIKE '%ssn%'", "source", "target"), "PII policy", "compliance",
         "'pii'"),
        (on("upper(column_name) LIKE '\\_FIVETRAN\\_%' ESCAPE '\\'", "source", "target"),
         "load metadata", "pattern", "'^_FIVETRAN_.*'"),
        (on("upper(column_name) = 'UTS'", "source"), "row version anywhere", "global",
         "column_name"),
        (on("upper(column_name) = 'CARD_NUMBER'", "source", "target"), "user choice", "global",
         "column_name"),
    ]
    return chain(layers)


def chain(layers: list[tuple[str, str, str, str]]) -> str:
    def pick(i: int, wrap: str = "'{}'") -> str:
        return "CASE " + " ".join(
            f"WHEN {l[0]} THEN {l[i] if i == 3 else wrap.format(l[i])}" for l in layers
        ) + " ELSE '' END"

    hit = " OR ".join(f"({l[0]})" for l in layers)
    return (f"SELECT \"table\", column_name, source_type, target_type, source_db, ({hit}) AS "
            f"excluded, {pick(1)} AS reason, {pick(2)} AS rule_type, {pick(3)} AS rule_name")


add("exclusions", EXCLUDED + " UNION ALL ".join(
    f"{decision(s)}, '{s}' AS asked FROM c" for s in ("both", "source", "target")))
add("exclusions_default", EXCLUDED + chain([
    ("upper(column_name) LIKE '\\_FIVETRAN\\_%' ESCAPE '\\'", "Fivetran internal columns",
     "pattern", "'^_FIVETRAN_.*'"),
    ("upper(column_name) IN ('_FIVETRAN_DELETED', '_FIVETRAN_SYNCED', '_FIVETRAN_ID')",
     "Fivetran metadata", "global", "column_name")]) + " FROM c")


def first_category(i: int) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(cn, '^(?:{'|'.join(p)})', 'i') THEN '{(c, r)[i]}'"
        for c, r, p in fv.TARGET_ONLY)
    return f"CASE {whens} ELSE '{fv.TARGET_ONLY_OTHER[i]}' END"


SIDES = CATALOGS + f""",
 a AS (SELECT "table" AS tb, upper(name) AS u, arg_max(name, ordinal) AS name,
              arg_max(type, ordinal) AS type FROM src GROUP BY 1, 2),
 b AS (SELECT "table" AS tb, upper(name) AS u, arg_max(name, ordinal) AS name,
              arg_max(type, ordinal) AS type FROM tgt GROUP BY 1, 2),
 ab AS (SELECT coalesce(a.tb, b.tb) AS tb, coalesce(a.name, b.name) AS cn, b.name AS tn,
               a.name IS NOT NULL AS in_s, b.name IS NOT NULL AS in_t,
               coalesce(a.u, b.u) LIKE '\\_FIVETRAN\\_%' ESCAPE '\\' AS meta
          FROM a FULL JOIN b ON a.tb = b.tb AND a.u = b.u),
 pres AS (SELECT tb, cn, tn, CASE WHEN NOT in_t THEN 'source_only' WHEN NOT in_s
                 THEN 'target_only' WHEN meta THEN 'excluded' ELSE 'matched' END AS p FROM ab),
 full_p AS (SELECT *, CASE p WHEN 'target_only' THEN {first_category(0)}
                   WHEN 'source_only' THEN '{fv.SOURCE_ONLY[0]}' WHEN 'excluded' THEN 'Excluded'
                   END AS category,
                   CASE p WHEN 'target_only' THEN {first_category(1)}
                   WHEN 'source_only' THEN '{fv.SOURCE_ONLY[1]}'
                   WHEN 'excluded' THEN 'Fivetran internal columns' END AS reason FROM pres)"""
add("schema_presence", SIDES + """
SELECT tb AS "table", cn AS column_name, tn AS target_column, p AS presence, category, reason
  FROM full_p""")
add("generated_rules", SIDES + """
SELECT tb AS "table", cn AS column_name, p IN ('source_only', 'target_only') AS excluded,
       CASE WHEN p IN ('source_only', 'target_only') THEN 'table_specific' ELSE '' END AS rule_type
  FROM full_p""")
add("target_only", SIDES + """
SELECT category, count(*) AS columns FROM full_p WHERE p = 'target_only' GROUP BY 1""")
add("column_names", CATALOGS + """
SELECT "table", upper(name) AS column_name FROM src UNION SELECT "table", upper(name) FROM tgt""")


def phrases(c: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{v}')" for v in values) + ")"


def patterns(c: str, values: list[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join(values)}')"


def verdicts(frame: str) -> str:
    """Classified skips of ``frame`` (column_name, skip_reason, data_type, ...)."""
    rules = [
        (patterns("n", fv.SKIP_METADATA_PATTERNS), "fivetran_metadata", "JUSTIFIED",
         "'Fivetran internal metadata column — not present in source'"),
        (phrases("r", fv.SKIP_CONFIG_PHRASES), "config_exclusion", "JUSTIFIED",
         "'Excluded by configuration — ' || given"),
        (phrases("r", fv.SKIP_TYPE_PHRASES) + " OR " + phrases("d", fv.SKIP_INCOMPATIBLE_TYPES),
         "type_incompatible", "JUSTIFIED",
         "'Data type ''' || data_type || ''' cannot be compared cross-database'"),
        (patterns("n", fv.SKIP_AUDIT_PATTERNS), "audit_column", "JUSTIFIED",
         "'Audit/ETL column added during migration or load process'"),
        (phrases("r", fv.SKIP_NO_TARGET_PHRASES), "no_target_match", "UNJUSTIFIED",
         "'Column exists in SOURCE but has NO matching column in TARGET'"),
        (phrases("r", fv.SKIP_NO_SOURCE_PHRASES), "no_source_match", "WARN_ONLY",
         "'Column exists in TARGET only — added during migration or enrichment'"),
        ("trim(given) = ''", "unknown", "UNJUSTIFIED",
         "'Column was skipped with NO documented reason'"),
        ("TRUE", "unknown", "UNJUSTIFIED",
         "'Skip reason ''' || given || ''' is not recognized as a valid justification'"),
    ]

    def pick(i: int) -> str:
        return "CASE " + " ".join(
            f"WHEN {r[0]} THEN {r[i] if i == 3 else repr(r[i])}" for r in rules) + " END"

    return (f"SELECT *, {pick(1)} AS category, {pick(2)} AS verdict, {pick(3)} AS message FROM ("
            f"SELECT *, lower(column_name) AS n, coalesce(skip_reason, '') AS given, "
            f"lower(coalesce(skip_reason, '')) AS r, lower(data_type) AS d FROM {frame}) f")


add("skip_verdict", given(sk=fx.SKIPS) + f"""
SELECT "table", ordinal, column_name, category, verdict, message FROM ({verdicts('sk')}) v""")
PARTITION = """
SELECT "table", count(*) FILTER (WHERE verdict = 'JUSTIFIED') AS justified_skips,
       count(*) FILTER (WHERE verdict = 'UNJUSTIFIED') AS unjustified_skips,
       count(*) FILTER (WHERE verdict = 'WARN_ONLY') AS warn_only_skips,
       coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE verdict
         = 'UNJUSTIFIED'), '') AS unjustified_columns FROM ({v}) v GROUP BY 1"""
add("skip_partition", given(sk=fx.SKIPS) + PARTITION.format(v=verdicts("sk")))
RESULTS = given(m=fx.MAPPING, res=fx.TABLE_RESULTS) + f""",
 sk AS (SELECT "table", source_column AS column_name, skip_reason, source_type AS data_type
          FROM m WHERE skip), sp AS ({PARTITION.format(v=verdicts('sk'))}),
 promoted AS (SELECT res."table" AS "table", CASE WHEN res.status = 'PASS'
                     AND unjustified_skips > 0 THEN 'FAIL' ELSE res.status END AS status,
                     res.status AS original_status, CASE WHEN res.status = 'PASS'
                     AND unjustified_skips > 0 THEN CAST(unjustified_skips AS VARCHAR)
                     || ' unjustified skip(s) found: ' || unjustified_columns END
                     AS skip_promotion_reason FROM res LEFT JOIN sp ON sp."table" = res."table")"""
add("promote_status", RESULTS + "SELECT * FROM promoted")
add("run_status", RESULTS + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS pass_count,
       count(*) FILTER (WHERE status = 'FAIL') AS fail_count,
       count(*) FILTER (WHERE status = 'ERROR') AS error_count,
       count(*) FILTER (WHERE status = 'FAIL' AND original_status = 'PASS') AS promoted_count,
       CASE WHEN count(*) FILTER (WHERE status <> 'PASS') > 0 THEN 'FAIL' ELSE 'PASS' END
       AS verdict FROM promoted""")
ACTIVE_COL = "NOT skip AND target_column IS NOT NULL"
LOOSE_COL = "NOT skip AND target_column IS NULL"
COVER = f"""
 cov AS (SELECT "table", count(*) FILTER (WHERE NOT ({LOOSE_COL})) AS total_columns,
                count(*) FILTER (WHERE {ACTIVE_COL}) AS validated_columns,
                count(*) FILTER (WHERE NOT ({ACTIVE_COL})) AS excluded_columns,
                count(*) FILTER (WHERE {LOOSE_COL}) AS unmatched_columns,
                coalesce(string_agg(source_column || ' (' || CASE WHEN NOT skip
                  THEN 'no matching target column' ELSE coalesce(nullif(skip_reason, ''),
                  'no reason recorded') END || ')', ', ' ORDER BY skip DESC, ordinal)
                  FILTER (WHERE NOT ({ACTIVE_COL})), '') AS excluded_detail FROM m GROUP BY 1),
 cov2 AS (SELECT *, CAST(printf('%.1f', 100.0 * validated_columns / total_columns) AS DOUBLE) AS coverage_pct,
                 CAST(printf('%.1f', 100.0 * validated_columns / (total_columns + unmatched_columns)) AS DOUBLE)
                 AS coverage_incl_unmatched FROM cov)"""
add("skip_report", RESULTS + "," + COVER.replace("FROM m GROUP", "FROM m WHERE \"table\" NOT LIKE '%9' GROUP") + """
SELECT res."table" AS "table", res.status AS original_status, p.status AS effective_status,
       validated_columns, total_columns, CASE WHEN total_columns IS NOT NULL THEN
       coalesce(justified_skips, 0) END AS justified_skips, CASE WHEN total_columns IS NOT NULL
       THEN coalesce(unjustified_skips, 0) END AS unjustified_skips, CASE WHEN total_columns
       IS NOT NULL THEN coalesce(warn_only_skips, 0) END AS warn_only_skips,
       coalesce(printf('%.1f', coverage_pct), 'UNKNOWN') AS coverage
  FROM res JOIN promoted p ON p."table" = res."table" LEFT JOIN cov2 c ON c."table" = res."table"
  LEFT JOIN sp ON sp."table" = res."table\"""")

# --- presence, coverage and plans --------------------------------------------------------------------------------------------

TABLE_SIDES = given(s=fx.SOURCE_TABLES, t=fx.TARGET_TABLES, x=fx.TABLE_EXCLUSIONS) + """,
 tt AS (SELECT upper("table") AS u, max("table") AS name FROM t GROUP BY 1),
 tp AS (SELECT s."table" AS source_table, tt.name AS target_table,
               CASE WHEN s."table" IS NULL THEN 'TARGET_ONLY' WHEN tt.name IS NOT NULL
                    THEN 'MATCHED' WHEN EXISTS (SELECT 1 FROM x WHERE lower(x.table_name)
                    = lower(s."table")) THEN 'MISSING_EXCLUDED' ELSE 'MISSING_CRITICAL' END
               AS status FROM s FULL JOIN tt ON tt.u = upper(s."table"))"""
add("table_presence", TABLE_SIDES + """
SELECT *, CASE status WHEN 'MISSING_EXCLUDED' THEN 'Excluded: staging table'
       WHEN 'MISSING_CRITICAL' THEN 'Table ''' || source_table || ''' exists in source but was NOT '
       || 'found in target. Migration may be incomplete or table name changed.' ELSE '' END
       AS message FROM tp""")
add("presence_failures", TABLE_SIDES + """
SELECT source_table AS "table", 'table_presence' AS validation_type, 'FAIL' AS status,
       CAST(NULL AS BIGINT) AS source_count FROM tp WHERE status = 'MISSING_CRITICAL'""")
COVERED = given(m=fx.MAPPING) + "," + COVER
add("column_coverage", COVERED + """
SELECT *, coverage_pct < 80.0 AS is_low, CAST(validated_columns AS VARCHAR) || ' of '
       || CAST(total_columns AS VARCHAR) || ' columns validated (' || printf('%.1f', coverage_pct)
       || '%)' || CASE WHEN excluded_columns = 0 THEN ' — no exclusions' ELSE ' — '
       || CAST(excluded_columns AS VARCHAR) || ' excluded: ' || excluded_detail END AS headline
  FROM cov2""")
add("batch_coverage", COVERED + """
SELECT count(*) AS tables, CAST(sum(total_columns) AS BIGINT) AS total_columns,
       CAST(sum(validated_columns) AS BIGINT) AS validated_columns,
       count(*) FILTER (WHERE coverage_pct < 80.0) AS low_tables,
       CAST(printf('%.1f', 100.0 * sum(validated_columns) / sum(total_columns)) AS DOUBLE) AS coverage_pct FROM cov2""")
add("low_coverage_tables", given(m0=fx.MAPPING) + """, m AS (
  SELECT * REPLACE (skip OR ("table" LIKE '%3' AND ordinal % 4 = 0) AS skip) FROM m0),""" + COVER + """
SELECT "table", coverage_pct FROM cov2 WHERE coverage_pct < 80.0 ORDER BY 2, 1""")
TWO = SIDES + """,
 two AS (SELECT tb AS "table", count(*) FILTER (WHERE p <> 'target_only') AS source_columns,
                count(*) FILTER (WHERE p <> 'source_only') AS target_columns,
                count(*) AS total_columns, count(*) FILTER (WHERE p = 'matched') AS matched_columns,
                count(*) FILTER (WHERE p = 'excluded') AS excluded_matched,
                count(*) FILTER (WHERE p = 'source_only') AS source_only,
                count(*) FILTER (WHERE p = 'target_only') AS target_only,
                count(*) FILTER (WHERE p = 'target_only' AND category = 'Audit Column')
                AS audit_columns, count(*) FILTER (WHERE p = 'target_only' AND category
                = 'Data Enrichment') AS enrichment_columns FROM full_p GROUP BY 1)"""
OVERALL = "(100.0 * matched_columns / total_columns)"
add("bidirectional_coverage", TWO + f"""
SELECT *, CASE WHEN source_columns = 0 THEN 0.0 ELSE round(100.0 * matched_columns
       / source_columns, 4) END AS source_coverage, CASE WHEN target_columns = 0 THEN 0.0 ELSE
       round(100.0 * matched_columns / target_columns, 4) END AS target_coverage,
       round({OVERALL}, 4) AS overall_coverage FROM two""")
RATE = "(100.0 * (source_only + target_only + excluded_matched) / total_columns)"
add("schema_health", TWO + f"""
SELECT "table", round({OVERALL}, 4) AS overall_coverage, {OVERALL} < 80.0 AS is_low,
       concat_ws(' | ',
         CASE WHEN {OVERALL} < 80.0 THEN 'Low coverage (' || printf('%.1f', {OVERALL})
           || '%) — Only ' || matched_columns || ' of ' || total_columns
           || ' total columns validated' END,
         CASE WHEN target_only > 0 THEN target_only || ' columns exist in target but not in '
           || 'source — possible migration enrichment or schema drift' END,
         CASE WHEN source_only > 0 THEN source_only || ' columns exist in source but not in '
           || 'target — possible dropped columns or incomplete migration' END,
         CASE WHEN {RATE} > 50 THEN 'High exclusion rate (' || printf('%.1f', {RATE}) || '%) — '
           || (source_only + target_only + excluded_matched) || ' of ' || total_columns
           || ' columns excluded' END) AS warnings,
       concat_ws(' | ',
         CASE WHEN audit_columns > 0 THEN 'Document ' || audit_columns
           || ' audit columns added during migration in your migration spec' END,
         CASE WHEN enrichment_columns > 0 THEN 'Document ' || enrichment_columns
           || ' enrichment columns in your data transformation guide' END,
         CASE WHEN target_only > 0 THEN 'Generate exclusion rules for the target-only columns of '
           || "table" END,
         CASE WHEN source_only > 0 THEN 'Review ' || source_only
           || ' source-only columns — verify they should not be in target' END,
         CASE WHEN {OVERALL} < 80.0 THEN 'Increase coverage to at least 80% by mapping or '
           || 'excluding unmapped columns' END) AS recommendations FROM two""")
NOT_META = "lower(source_column) NOT LIKE '\\_fivetran\\_%' ESCAPE '\\'"
add("plan_status", given(m=fx.MAPPING) + f""",
 st AS (SELECT "table", count(*) FILTER (WHERE NOT ({ACTIVE_COL}) AND {NOT_META}) AS unmatched,
               count(*) FILTER (WHERE needs_review) AS doubt FROM m GROUP BY 1)
SELECT "table", unmatched, CAST(0 AS BIGINT) AS ambiguities, CASE WHEN unmatched > 0 THEN 'partial'
       ELSE 'complete' END AS plan_status, 'plain' AS asked FROM st
UNION ALL
SELECT "table", unmatched, doubt, CASE WHEN doubt > 0 THEN 'ambiguous' WHEN unmatched > 0
       THEN 'partial' ELSE 'complete' END, 'with_doubt' FROM st""")
add("plan_statistics", given(m=fx.MAPPING) + f"""
SELECT "table", count(*) AS total_columns, count(*) FILTER (WHERE {ACTIVE_COL}) AS active_columns,
       count(*) FILTER (WHERE skip) AS skipped_columns, count(*) FILTER (WHERE {ACTIVE_COL} AND
       match_method IN ('exact', 'normalized_exact', 'configured')) AS exact_columns,
       count(*) FILTER (WHERE {ACTIVE_COL} AND match_method = 'fuzzy') AS fuzzy_columns,
       count(*) FILTER (WHERE {ACTIVE_COL} AND needs_review) AS review_columns,
       count(*) FILTER (WHERE decision = 'unmatched') AS unmatched_columns FROM m GROUP BY 1""")
KNOWN = text_in(list(fv.RULE_TRIGGERS))
add("plan_checks", given(h=fx.PLAN_HEADERS, m=fx.MAPPING) + f""",
 a AS (SELECT * FROM m WHERE {ACTIVE_COL}),
 dt AS (SELECT "table", string_agg(u, ', ' ORDER BY u) AS names FROM (SELECT "table",
          upper(target_column) AS u FROM a GROUP BY 1, 2 HAVING count(*) > 1) q GROUP BY 1),
 ag AS (SELECT "table", string_agg(source_column, ', ' ORDER BY source_column) FILTER (WHERE
                 rule = '') AS no_rule, string_agg(source_column, ', ' ORDER BY source_column)
                 FILTER (WHERE rule <> '' AND rule NOT IN ({KNOWN})) AS odd_rule,
               string_agg(source_column, ', ' ORDER BY source_column) FILTER (WHERE confidence
                 NOT BETWEEN 0.0 AND 1.0) AS odd_conf FROM a GROUP BY 1),
 un AS (SELECT "table", count(*) AS total, count(*) FILTER (WHERE NOT ({ACTIVE_COL}) AND
          {NOT_META}) AS n FROM m GROUP BY 1),
 f AS (SELECT h."table" AS tb, concat_ws(' | ',
         CASE WHEN trim(target_table) = '' THEN 'target_table is empty' END,
         CASE WHEN trim(source_schema) = '' THEN 'source_schema is empty' END,
         'no rule assigned: ' || no_rule,
         CASE WHEN status = 'invalid' THEN 'plan was marked invalid before' END,
         CASE WHEN 100.0 * n / total > 50 THEN n || ' of ' || total
           || ' source columns are unmatched' END) AS issues,
        concat_ws(' | ', 'target column used more than once: ' || dt.names,
         'unknown rule, text is used: ' || odd_rule, 'confidence outside [0, 1]: ' || odd_conf,
         CASE WHEN n > 0 AND 100.0 * n / total <= 50 THEN n || ' of ' || total
           || ' source columns are unmatched' END) AS warnings
        FROM h LEFT JOIN ag ON ag."table" = h."table" LEFT JOIN dt ON dt."table" = h."table"
        LEFT JOIN un ON un."table" = h."table")
SELECT tb AS "table", issues = '' AS is_valid, issues, warnings FROM f""")
add("batch_run", LEDGER + """
SELECT 'orders' AS "table", 'data_validation' AS validation_type, 'FAIL' AS status,
       (SELECT count(*) FROM s) AS source_count, (SELECT count(*) FROM t) AS target_count,
       CAST(NULL AS BIGINT) AS count_difference,
       (SELECT count(*) FROM counts WHERE sn = 0) AS missing_in_source,
       (SELECT count(*) FROM counts WHERE tn = 0) AS missing_in_target,
       (SELECT count(*) FROM bad) AS value_mismatches,
       (SELECT count(*) FROM counts WHERE sn > 1 OR tn > 1) AS duplicate_keys,
       'keyed' AS mode, CAST(6 AS INTEGER) AS compared_columns,
       'target._FIVETRAN_ACTIVE: no partner in source; target._FIVETRAN_SYNCED: no partner in source; '
       || 'target.MIGRATED_AT: no partner in source; target.DATA_QUALITY_SCORE: no partner in source'
         AS uncompared_columns
UNION ALL SELECT 'customer', 'data_validation', 'PASS', count(*), count(*), NULL, 0, 0, 0, 0,
       'keyed', 5, '' FROM customer
UNION ALL SELECT 'part', 'count_validation', 'PASS', count(*), count(*), 0, NULL, NULL, NULL, NULL,
       'count', NULL, NULL FROM part
UNION ALL SELECT 'ghost', 'data_validation', 'ERROR', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       NULL, NULL, NULL""")
add("full_run", f"""
SELECT 'orders' AS "table", 'data_validation' AS validation_type, 'FAIL' AS status,
       'FAIL' AS original_status, 'keyed' AS mode, count(*) AS source_count FROM orders
UNION ALL SELECT 'customer', 'data_validation', 'FAIL', 'PASS', 'keyed', count(*) FROM customer
UNION ALL SELECT 'part', 'count_validation', 'PASS', 'PASS', 'count', count(*) FROM part
UNION ALL SELECT 'ghost', 'data_validation', 'ERROR', 'ERROR', NULL, NULL
UNION ALL SELECT lower(r_name), 'table_presence', 'FAIL', 'FAIL', NULL, NULL
  FROM region WHERE r_regionkey = 2""")

RUN_ROWS = """
SELECT 0 AS no, 'orders' AS "table", 'data_validation' AS kind, 'FAIL' AS status, 'keyed' AS mode,
       count(*) AS source_count FROM orders
UNION ALL SELECT 1, 'customer', 'data_validation', 'PASS', 'keyed', count(*) FROM customer
UNION ALL SELECT 2, 'part', 'count_validation', 'PASS', 'count', count(*) FROM part
UNION ALL SELECT 3, 'ghost', 'data_validation', 'ERROR', NULL, NULL"""
add("resumed_run", f"""
SELECT CAST(no AS INT) AS table_no, "table", kind AS validation_type, status, mode, source_count,
       CAST(1 AS INT) AS attempt FROM ({RUN_ROWS}) r""")
add("run_report", f"""
SELECT "table", status AS original_status,
       CASE WHEN "table" = 'customer' THEN 'FAIL' ELSE status END AS effective_status,
       CAST(NULL AS BIGINT) AS validated_columns, 'UNKNOWN' AS coverage FROM ({RUN_ROWS}) r""")

# --- usage -----------------------------------------------------------------------------------------------------------------------

PRICE_ROWS = ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in fv.MODEL_PRICES.items())
COSTED = f"""
WITH u AS ({fx.duck(fx.USAGE_DUCK)}), p(m, i, o) AS (VALUES {PRICE_ROWS}),
 c AS (SELECT CAST(substr(timestamp, 1, 10) AS DATE) AS day, coalesce(model, 'unknown') AS model,
              coalesce(call_type, 'unknown') AS call_type, coalesce(prompt_tokens, 0) AS pt,
              coalesce(completion_tokens, 0) AS ct,
              CAST(coalesce(prompt_tokens, 0) AS DOUBLE) / 1000000 * CAST(coalesce(i, 3.0)
              AS DOUBLE) + CAST(coalesce(completion_tokens, 0) AS DOUBLE) / 1000000
              * CAST(coalesce(o, 15.0) AS DOUBLE) AS cost FROM u LEFT JOIN p ON p.m = u.model)
"""


def rollups(measures: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{g}' AS \"grouping\", {n} AS name, count(*) AS calls, {measures} FROM c {where} "
        + (f"GROUP BY {n}" if n != "''" else "")
        for g, n in (("overall", "''"), ("call_type", "call_type"), ("model", "model")))


add("usage_cost", COSTED + rollups("""CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS
 BIGINT) AS completion_tokens, CAST(sum(pt + ct) AS BIGINT) AS total_tokens, round(sum(cost), 4)
 AS cost"""))
add("daily_cost", COSTED + """
SELECT d.day AS day, round(coalesce(sum(cost), 0.0), 4) AS cost,
       CAST(coalesce(sum(pt + ct), 0) AS BIGINT) AS tokens, count(cost) AS calls
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-27', TIMESTAMP '2024-02-02',
        INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN c ON c.day = d.day GROUP BY 1""")
add("window_usage", COSTED + rollups("""CAST(sum(pt + ct) AS BIGINT) AS tokens,
 round(sum(cost), 4) AS cost, CAST(coalesce(sum(CASE WHEN day = DATE '2024-01-20' THEN pt + ct
 END), 0) AS BIGINT) AS tokens_today, round(coalesce(sum(CASE WHEN day = DATE '2024-01-20'
 THEN cost END), 0.0), 4) AS cost_today""",
    "WHERE day BETWEEN DATE '2024-01-14' AND DATE '2024-01-20'"))

# --- tables by name ------------------------------------------------------------------------------

TABLE_PAIRS = given(src=fx.SOURCE_TABLES, tgt=fx.TARGET_TABLES, conf=fx.CONFIRMED) + f""",
 named AS (SELECT "schema" AS sc, upper("table") AS u, min("table") AS tn FROM tgt GROUP BY 1, 2),
 asked AS (SELECT DISTINCT "schema" AS sc, "table" AS tb FROM src),
 found AS (SELECT a.sc, a.tb, n.tn FROM asked a LEFT JOIN named n ON n.sc = a.sc
             AND n.u = upper(a.tb)),
 keyed AS (SELECT f.sc, f.tb, n.tn, {key('f.tb')} AS sk, {key('n.tn')} AS tk
             FROM found f JOIN named n ON n.sc = f.sc WHERE f.tn IS NULL),
 scored AS (SELECT *, {ratio('sk', 'tk')} AS score FROM keyed),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sc, tb ORDER BY score DESC, tn) AS rk
              FROM scored)"""
add("match_tables", TABLE_PAIRS + """
SELECT sc AS "schema", tb AS source_table, tn AS target_table, CAST(1.0 AS DOUBLE) AS ratio,
       CAST(1 AS INT) AS candidate_rank, CAST(100 AS INT) AS percent FROM found WHERE tn IS NOT NULL
UNION ALL SELECT sc, tb, tn, score, CAST(rk AS INT), CAST(floor(score * 100) AS INT) FROM ranked
 WHERE score >= 0.30 AND rk <= 5""")
add("suggest_targets", TABLE_PAIRS + """,
 latest AS (SELECT source_table, arg_max(target_table, confirmed_at) AS ct FROM conf GROUP BY 1),
 close AS (SELECT sc, tb, count(*) AS n, max(tn) AS tn FROM ranked r
            WHERE score >= 0.4 AND rk <= 3 GROUP BY 1, 2),
 st AS (SELECT s."schema" AS sc, s."table" AS tb, l.ct, n.tn AS et, c.tn AS lt,
               CASE WHEN l.ct IS NOT NULL THEN 'confirmed' WHEN n.tn IS NOT NULL THEN 'exact'
                    WHEN s."schema" NOT IN (SELECT sc FROM named) THEN 'no_data'
                    WHEN c.n >= 2 THEN 'ambiguous' WHEN c.n = 1 THEN 'fuzzy'
                    ELSE 'not_found' END AS status
          FROM src s LEFT JOIN latest l ON l.source_table = s."table"
          LEFT JOIN named n ON n.sc = s."schema" AND n.u = upper(s."table")
          LEFT JOIN close c ON c.sc = s."schema" AND c.tb = s."table")
SELECT sc AS "schema", tb AS source_table, CASE status WHEN 'confirmed' THEN ct WHEN 'exact' THEN et
       WHEN 'no_data' THEN upper(tb) WHEN 'fuzzy' THEN lt ELSE '' END AS target_table, status FROM st""")
add("metric_edges", """
WITH m(column_name, metric) AS (VALUES ('*', 'row_count'), ('a', 'min'), ('a', 'max'), ('b', 'min'),
  ('b', 'max'), ('c', 'min'), ('c', 'max'), ('a', 'sum'), ('c', 'sum'), ('a', 'nan_count'),
  ('b', 'nan_count'))
SELECT column_name, metric, NOT (column_name = 'a' AND metric IN ('max', 'sum', 'nan_count')) OR
       (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) = 0 AS is_match FROM m""")

# --- checks that run and a diff that the plan asks for ---------------------------------------------

add("mapped_diff_orders", LEDGER + " UNION ALL ".join(
    f"SELECT '{v}' AS column_name, count(*) FILTER (s_{v} <> t_{v}) AS mismatches FROM common"
    for v in VALUES))
CHECKED = {
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus", "l_shipdate"], ["l_quantity", "l_discount", "l_tax"],
    ),
    "orders": (
        ["o_orderkey", "o_custkey", "o_totalprice"],
        ["o_orderstatus", "o_orderdate", "o_orderpriority"], [],
    ),
}


def checked(table: str, numbers: list[str], others: list[str], sums: list[str]) -> list[str]:
    def row(check: str, column: str, detail: str, value: str) -> str:
        return (f"SELECT '{table}' AS \"table\", '{check}' AS \"check\", '{column}' AS column_name, "
                f"CAST({detail} AS VARCHAR) AS detail, round(CAST({value} AS DOUBLE), 2) AS value "
                f"FROM {table}")

    out = [row("row_count", "*", "NULL", "count(*)")]
    for c in numbers + others:
        out.append(row("null_pct", c, "NULL", f"100.0 * (count(*) - count({c})) / count(*)"))
        out.append(row("distinct_count", c, "NULL", f"count(DISTINCT {c})"))
    for c in numbers:
        out += [row("min_max", c, f"'{m}'", f"{m}({c})") for m in ("min", "max")]
    return out + [row("sum", c, "NULL", f"sum(CAST({c} AS DECIMAL(38,2)))") for c in sums]


add("profile_checks", " UNION ALL ".join(
    q for t, columns in CHECKED.items() for q in checked(t, *columns)))
