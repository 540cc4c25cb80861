"""Schemas from a short text, without needing a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
}


def schema(text: str) -> T.StructType:
    """``"a string, b bigint"`` as a nullable struct."""
    fields = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


RESULT_SCHEMA = schema(
    "table string, validation_type string, status string, error string, "
    "source_count bigint, target_count bigint, count_difference bigint, "
    "missing_in_source bigint, missing_in_target bigint, value_mismatches bigint, "
    "duplicate_keys bigint, mode string, compared_columns int, uncompared_columns string"
)
