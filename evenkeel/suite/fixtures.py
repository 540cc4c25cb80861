"""Inputs that are derived from the given tables.

Each text is SQL that Spark and DuckDB both read, so that a query and its check start from the
same rows.  ``{orders}`` and the like stand for the tables.  The derived rows grow with the
tables: one catalog column per part, one order pair per order, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# --- a target for orders with known defects -----------------------------------------------

_ORDER_COLUMNS = """
       o_custkey AS CUSTOMER_KEY,
       CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderstatus END AS O_ORDERSTATUS,
       CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1.00 ELSE o_totalprice END
         AS O_TOTALPRICE,
       o_orderdate + INTERVAL 500 MILLISECONDS AS O_ORDERDATE,
       '  ' || o_orderpriority || ' ' AS O_ORDERPRIORITY,
       {active} AS _FIVETRAN_ACTIVE,
       o_orderdate AS _FIVETRAN_SYNCED,
       o_orderdate AS MIGRATED_AT,
       CAST(0.5 AS DOUBLE) AS DATA_QUALITY_SCORE
  FROM {{orders}}
"""


def _order_rows(key: str, active: str, where: str) -> str:
    return f"SELECT {key} AS O_ORDERKEY," + _ORDER_COLUMNS.format(active=active) + f" WHERE {where}"


ORDERS_TARGET = " UNION ALL ".join(
    [
        _order_rows("o_orderkey", "TRUE", "o_orderkey % 97 <> 0"),  # dropped rows
        _order_rows("o_orderkey + 10000000", "TRUE", "o_orderkey % 101 = 0"),  # orphans
        _order_rows("o_orderkey", "FALSE", "o_orderkey % 41 = 0"),  # inactive versions
        _order_rows(  # duplicates
            "o_orderkey", "TRUE", "o_orderkey % 37 = 0 AND o_orderkey % 97 <> 0"
        ),
    ]
)

# --- two tables without a key ---------------------------------------------------------------

KEYLESS_SOURCE = "SELECT o_orderkey, o_orderstatus FROM {orders}"
KEYLESS_TARGET = """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
  FROM {orders} WHERE o_orderkey % 30 <> 0
UNION ALL SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey % 41 = 0
"""

# --- values at the edges of their types ----------------------------------------------------------

EDGES_SOURCE = """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN TRUE END AS BOOLEAN) AS flag,
       CAST(CASE o_orderkey % 4 WHEN 0 THEN 2000000000000000000 ELSE o_orderkey END AS BIGINT)
         AS big,
       CAST(o_orderkey % 10 AS DECIMAL(10,4)) / 1000 AS small
  FROM {orders}
"""
EDGES_TARGET = """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 5 END
         AS INT) AS flag,
       CAST(CASE o_orderkey % 4 WHEN 0 THEN 2000000000000000000 ELSE o_orderkey END AS DOUBLE)
         AS big,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE o_orderkey % 10 END AS DECIMAL(10,4)) / 1000
         AS small
  FROM {orders}
"""

# --- the same contents in another spelling, but for every tenth customer ------------------------------

NAMED_SOURCE = """
SELECT c_custkey, replace('{{~b~: ' || CAST(c_nationkey AS STRING) || ', ~a~: [1,  2]}}', '~', chr(34))
         AS doc_json,
       replace('~seg~ => ~' || c_mktsegment || '~, ~name~=>~x~', '~', chr(34)) AS tags_hstore,
       replace('{{~b~: 1, ~a~: 2}}', '~', chr(34)) AS plain_text
  FROM {customer}
"""
NAMED_TARGET = """
SELECT c_custkey AS C_CUSTKEY,
       replace('{{~a~:[1,2],~b~:' || CAST(CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END
         AS STRING) || '}}', '~', chr(34)) AS DOC_JSON,
       replace('~name~=>~x~, ~seg~=>~' || CASE WHEN c_custkey % 15 = 0 THEN 'none' ELSE c_mktsegment END
         || '~', '~', chr(34)) AS TAGS_HSTORE,
       replace('{{~a~: 2, ~b~: 1}}', '~', chr(34)) AS PLAIN_TEXT
  FROM {customer}
"""

# --- a decimal of four places against a float -----------------------------------------------------

SCALE_SOURCE = """
SELECT o_orderkey AS id, CAST((o_orderkey % 50) * 0.001 AS DECIMAL(10,4)) AS amount FROM {orders}
"""
SCALE_TARGET = """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 50 + 3
         ELSE o_orderkey % 50 END AS DOUBLE) / 1000 AS amount FROM {orders}
"""

# --- a run over tables of which one is missing ---------------------------------------------------

RUN_SOURCES = """
SELECT 's' AS "schema", lower(r_name) AS "table" FROM {region}
"""
RUN_TARGETS = """
SELECT 's' AS "schema", upper(r_name) AS "table" FROM {region} WHERE r_regionkey <> 2
"""
RUN_SKIPS = """
SELECT CASE WHEN n_nationkey = 0 THEN 'customer' ELSE lower(n_name) END AS "table",
       lower(n_name) AS column_name, 'nobody looked' AS skip_reason, 'text' AS data_type
  FROM {nation} WHERE n_nationkey < 3
"""

# --- a target for customer that differs in form only -----------------------------------------

CUSTOMER_TARGET = """
SELECT CAST(c_custkey AS DECIMAL(38,0)) AS C_CUSTKEY, c_name || ' ' AS CNAME,
       CAST(c_nationkey AS BIGINT) AS C_NATIONKEY,
       CAST(c_acctbal AS DECIMAL(12,2)) AS C_ACCTBAL, c_mktsegment AS C_MKTSEGMENT
  FROM {customer}
"""

# --- two column catalogs, one column per part, forty columns per table ------------------------

_PARTS = """
SELECT p_partkey AS k,
       'table_' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS t,
       CAST(p_partkey % 40 + 1 AS INT) AS ordinal,
       p_partkey % 16 AS kind,
       replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 40 + 1 AS STRING) AS stem,
       p_size AS size
  FROM {part}
"""

_SOURCE = f"""
SELECT k, t, ordinal, kind, size,
       CASE WHEN ordinal = 40 AND k % 200 = 39 THEN '_fivetran_synced'
            WHEN kind = 5 THEN 'is_' || stem
            ELSE stem || CASE kind WHEN 0 THEN '_id' WHEN 1 THEN '_amount' WHEN 2 THEN '_qty'
                 WHEN 3 THEN '_status' WHEN 4 THEN '_date' WHEN 6 THEN '_at' WHEN 7 THEN '_doc'
                 WHEN 8 THEN '_note' WHEN 9 THEN '_ratio' WHEN 10 THEN '_uuid'
                 WHEN 11 THEN '_tags' WHEN 12 THEN '_blob' WHEN 13 THEN '_level'
                 WHEN 14 THEN '_code' ELSE '_seen' END END AS name,
       CASE kind WHEN 0 THEN 'bigint' WHEN 1 THEN 'numeric(10,2)' WHEN 2 THEN 'integer'
            WHEN 3 THEN 'varchar(20)' WHEN 4 THEN 'date' WHEN 5 THEN 'boolean'
            WHEN 6 THEN 'timestamp without time zone' WHEN 7 THEN 'jsonb' WHEN 8 THEN 'text'
            WHEN 9 THEN 'double precision' WHEN 10 THEN 'uuid' WHEN 11 THEN 'hstore'
            WHEN 12 THEN 'bytea' WHEN 13 THEN 'smallint' WHEN 14 THEN 'character varying(8)'
            ELSE 'timestamp with time zone' END AS type,
       size % 3 <> 0 AS nullable,
       CASE WHEN kind = 1 THEN 2 END AS scale
  FROM ({_PARTS}) p
"""

SOURCE_CATALOG = f"""
SELECT t AS "table", ordinal, name, type, nullable, scale,
       kind = 0 AND NOT nullable AS is_key,
       CASE WHEN kind = 0 AND NOT nullable THEN ordinal END AS key_ordinal
  FROM ({_SOURCE}) s
"""

_RENAMED = """CASE WHEN k % 11 = 0 THEN replace(upper(name), 'E', '')
            WHEN k % 13 = 0 THEN replace(upper(name), '_', '') ELSE upper(name) END"""

TARGET_CATALOG = f"""
SELECT t AS "table", ordinal, {_RENAMED} AS name,
       CASE kind WHEN 0 THEN 'NUMBER(38,0)' WHEN 1 THEN 'NUMBER(10,2)' WHEN 2 THEN 'NUMBER'
            WHEN 3 THEN 'VARCHAR' WHEN 4 THEN 'DATE' WHEN 5 THEN 'BOOLEAN'
            WHEN 6 THEN 'TIMESTAMP_NTZ' WHEN 7 THEN 'VARIANT' WHEN 8 THEN 'TEXT'
            WHEN 9 THEN 'FLOAT' WHEN 10 THEN 'VARCHAR' WHEN 11 THEN 'VARCHAR'
            WHEN 12 THEN 'BINARY' WHEN 13 THEN 'NUMBER' WHEN 14 THEN 'VARCHAR'
            ELSE 'TIMESTAMP_TZ' END AS type,
       nullable, scale,
       kind = 0 AND NOT nullable AS is_key,
       CASE WHEN kind = 0 AND NOT nullable THEN ordinal END AS key_ordinal
  FROM ({_SOURCE}) s WHERE k % 7 <> 0
UNION ALL
SELECT t AS "table", ordinal + 40 AS ordinal,
       CASE k % 6 WHEN 0 THEN 'MIGRATED_AT' WHEN 1 THEN 'QUALITY_SCORE'
            WHEN 2 THEN '_FIVETRAN_SYNCED' WHEN 3 THEN '_BATCH_ID' WHEN 4 THEN 'FULL_NAME'
            ELSE 'LEGACY_CODE' END AS name,
       'VARCHAR' AS type, TRUE AS nullable, CAST(NULL AS INT) AS scale, FALSE AS is_key,
       CAST(NULL AS INT) AS key_ordinal
  FROM ({_SOURCE}) s WHERE k % 17 = 0
"""

CONFIGURED = f"""
SELECT t AS "table", name AS source_column, {_RENAMED} AS target_column
  FROM ({_SOURCE}) s WHERE k % 11 = 0 AND k % 3 = 0
"""

LEARNED = f"""
SELECT k AS seq, name AS source_column, {_RENAMED} AS target_column, type AS source_type,
       CASE WHEN kind IN (0, 1, 2, 13) THEN 'NUMBER' WHEN kind = 4 THEN 'DATE'
            WHEN kind = 9 THEN 'FLOAT' ELSE 'VARCHAR' END AS target_type,
       'text' AS correct_rule, 'confirmed' AS reason, t AS table_name,
       TIMESTAMP '2024-01-01 00:00:00' + k * INTERVAL 1 SECOND AS corrected_at
  FROM ({_SOURCE}) s
"""

# --- decided mappings and skipped columns ---------------------------------------------------------

MAPPING = f"""
SELECT t AS "table", ordinal, name AS source_column, type AS source_type,
       CASE WHEN k % 7 = 0 OR k % 9 = 0 THEN NULL WHEN k % 31 = 0 THEN 'SHARED_COLUMN'
            ELSE {_RENAMED} END AS target_column,
       CASE WHEN k % 7 = 0 OR k % 9 = 0 THEN NULL WHEN k % 11 = 0 THEN 'fuzzy'
            WHEN k % 13 = 0 THEN 'normalized_exact' ELSE 'exact' END AS match_method,
       CASE WHEN k % 7 = 0 OR k % 9 = 0 THEN 0.0 WHEN k % 11 = 0 THEN 0.75
            WHEN k % 67 = 0 THEN 1.5 ELSE 1.0 END AS confidence,
       CASE WHEN k % 7 = 0 THEN 'unmatched' ELSE 'resolved' END AS decision,
       k % 11 = 0 AND k % 7 <> 0 AND k % 9 <> 0 AS needs_review,
       k % 9 = 0 AS skip,
       CASE WHEN k % 9 <> 0 THEN NULL
            WHEN k % 5 = 0 THEN 'Global exclusion: load metadata'
            WHEN k % 5 = 1 THEN 'rowversion — not comparable'
            WHEN k % 5 = 2 THEN '' WHEN k % 5 = 3 THEN 'PII policy' ELSE 'manual choice' END
         AS skip_reason,
       CASE WHEN k % 71 = 0 THEN '' WHEN k % 73 = 0 THEN 'homemade' ELSE 'text' END AS rule
  FROM ({_SOURCE}) s
"""

SKIPS = f"""
SELECT t AS "table", ordinal,
       CASE k % 11 WHEN 0 THEN '_FIVETRAN_' || upper(stem0) WHEN 1 THEN 'etl_' || stem0
            WHEN 2 THEN '_batch_id' WHEN 3 THEN 'fivetran_sync_status' ELSE name END
         AS column_name,
       CASE k % 8 WHEN 0 THEN 'Pattern exclusion ^tmp' WHEN 1 THEN 'no comparison rule'
            WHEN 2 THEN 'no matching target column' WHEN 3 THEN 'Target-only column'
            WHEN 4 THEN '' WHEN 5 THEN 'because' WHEN 6 THEN 'PII policy' ELSE NULL END
         AS skip_reason,
       type AS data_type
  FROM (SELECT s.*, replace(name, '_', '') AS stem0 FROM ({_SOURCE}) s) x
"""

PLAN_HEADERS = f"""
SELECT t AS "table", CASE WHEN n % 10 = 3 THEN '' ELSE 'public' END AS source_schema,
       t AS source_table, CASE WHEN n % 10 = 4 THEN ' ' ELSE upper(t) END AS target_table,
       CASE WHEN n % 10 = 5 THEN 'invalid' ELSE 'partial' END AS status
  FROM (SELECT t, min(k) / 40 AS n FROM ({_PARTS}) p GROUP BY t) q
"""

TABLE_RESULTS = f"""
SELECT t AS "table",
       CASE WHEN n % 7 = 5 THEN 'FAIL' WHEN n % 7 = 6 THEN 'ERROR' ELSE 'PASS' END AS status
  FROM (SELECT t, CAST(floor(min(k) / 40) AS BIGINT) AS n FROM ({_PARTS}) p GROUP BY t) q
"""

EXCLUSION_COLUMNS = f"""
SELECT t AS "table", column_name, type AS source_type, ttype AS target_type,
       CASE k % 3 WHEN 0 THEN 'mssql' WHEN 1 THEN 'postgresql' ELSE 'athena' END AS source_db
  FROM (SELECT s.*, CASE k % 12 WHEN 0 THEN '_FIVETRAN_' || upper(name) WHEN 1 THEN 'uTS'
                         WHEN 2 THEN 'customer_ssn' WHEN 3 THEN 'tmp_' || name
                         WHEN 4 THEN '_fivetran_deleted' WHEN 5 THEN 'card_number'
                         ELSE name END AS column_name,
               CASE WHEN k % 5 = 0 THEN 'BINARY' ELSE 'VARCHAR' END AS ttype
          FROM ({_SOURCE}) s) x
"""

# --- table lists, one table per customer, schemas by nation ------------------------------------------

SOURCE_TABLES = """
SELECT 'schema_' || CAST(c_nationkey AS STRING) AS "schema",
       CASE WHEN c_custkey % 14 = 0 THEN md5(c_name)
            ELSE lower(replace(c_name, '#', '_')) END AS "table"
  FROM {customer}
"""

TARGET_TABLES = """
SELECT 'schema_' || CAST(c_nationkey AS STRING) AS "schema",
       CASE WHEN c_custkey % 10 = 0 THEN upper(replace(replace(c_name, '#', ''), '00', ''))
            ELSE upper(replace(c_name, '#', '_')) END AS "table"
  FROM {customer} WHERE c_custkey % 9 <> 0
UNION ALL
SELECT 'schema_' || CAST(s_nationkey AS STRING) AS "schema", upper(replace(s_name, '#', '_'))
       AS "table"
  FROM {supplier}
"""

TABLE_EXCLUSIONS = """
SELECT lower(replace(c_name, '#', '_')) AS table_name, 'staging table' AS reason
  FROM {customer} WHERE c_custkey % 18 = 0
"""

CONFIRMED = """
SELECT lower(replace(c_name, '#', '_')) AS source_table, 'CONFIRMED_' || c_mktsegment
       AS target_table, 'reviewer' AS confirmed_by,
       TIMESTAMP '2024-01-01 00:00:00' AS confirmed_at, 'main' AS source_connection
  FROM {customer} WHERE c_custkey % 27 = 0
"""

# --- orders as customer-to-segment mappings -------------------------------------------------------------

TABLE_MAP = """
SELECT lower(c_name) AS source_table,
       CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 4 = 0
            THEN 'T_' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) AS STRING)
            ELSE 'T_C' || CAST(c_custkey AS STRING) END AS target_table
  FROM {customer}
"""

# --- events as usage records ----------------------------------------------------------------------------

USAGE = """
SELECT CAST(user_id AS STRING) AS session_id, {stamp} AS timestamp,
       CASE user_id % 6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4.1'
            WHEN 3 THEN 'gemini-2.5-pro' WHEN 4 THEN 'house-model' ELSE NULL END AS model,
       event_type AS call_type,
       CAST(floor(value * 100) AS BIGINT) AS prompt_tokens,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END
         AS completion_tokens,
       CAST(NULL AS BIGINT) AS total_tokens
  FROM {{events}}
"""
USAGE_SPARK = USAGE.format(stamp="substring(CAST(ts AS STRING), 1, 10) || 'T' || "
                                 "substring(CAST(ts AS STRING), 12, 8)")
USAGE_DUCK = USAGE.format(stamp="strftime(ts, '%Y-%m-%dT%H:%M:%S')")


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is looked up in the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture text over the tables in ``sf_dir``."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace('"', "`"), **used)


def duck(text: str) -> str:
    """The fixture text over the registered views."""
    return text.format(**{t: t for t in TABLES})
