"""Reading the two sides of a comparison and the control and usage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from evenkeel.schema import schema

CONTROL_SCHEMA = schema(
    "id int, load_type string, table_name string, validation_type string, "
    "source_schema string, source_table string, source_db string, source_query string, "
    "target_schema string, target_table string, target_db string, target_query string, "
    "is_active boolean, validation_status boolean, created_by string, "
    "created_at timestamp_ntz, updated_by string, updated_at timestamp_ntz, "
    "primary_key string, source_column string, target_column string, window_start string, "
    "window_end string"
)
USAGE_SCHEMA = schema(
    "session_id string, timestamp string, pid bigint, backend string, model string, "
    "call_type string, context string, attempt int, prompt_tokens bigint, "
    "completion_tokens bigint, total_tokens bigint"
)


def load(spark: SparkSession, spec: dict) -> DataFrame:
    """One side of a comparison.

    ``spec`` has ``table`` (catalog name), or ``format`` with ``path`` and/or ``options``, and
    optionally ``query``: SQL over what was read, which it names ``{rows}``.
    For ``jdbc``, ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    go into ``options`` so that the read is split over executors; ``schema`` avoids a pass
    for inference on csv and json.
    """
    if "query" in spec:
        rows = load(spark, {k: v for k, v in spec.items() if k != "query"})
        return spark.sql(spec["query"], rows=rows)
    if "table" in spec:
        return spark.table(spec["table"])
    reader = spark.read.format(spec.get("format", "parquet")).options(**spec.get("options", {}))
    if "schema" in spec:
        reader = reader.schema(spec["schema"])
    return reader.load(spec["path"]) if "path" in spec else reader.load()


def active_control_rows(control: DataFrame) -> DataFrame:
    """Rows of a control table that are switched on."""
    return control.filter(F.col("is_active"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Usage events from JSON lines; malformed lines are dropped."""
    return (
        spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    )
