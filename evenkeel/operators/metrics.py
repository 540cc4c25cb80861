"""Table and column metrics, fused into one scan per side, and their comparison.

Everything here is an aggregate with a map-side stage: a value or key that holds much of the
table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.functions import normalise as nz
from evenkeel.operators.projection import quoted

#: common numeric type of compared metrics
METRIC_TYPE = "decimal(38,10)"
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)
WHOLE = (T.IntegralType, T.BooleanType, *TEMPORAL)
FLOATING = (T.FloatType, T.DoubleType)


def row_count(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("row_count"))


def count_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both row counts, their absolute difference and PASS when they are equal."""
    sides = row_count(source).select(
        F.col("row_count").alias("s"), F.lit(0).cast("long").alias("t")
    ).unionByName(
        row_count(target).select(F.lit(0).cast("long").alias("s"), F.col("row_count").alias("t"))
    )
    return sides.agg(F.sum("s").alias("source_count"), F.sum("t").alias("target_count")).select(
        "source_count",
        "target_count",
        F.abs(F.col("target_count") - F.col("source_count")).alias("count_difference"),
        F.when(F.col("source_count") == F.col("target_count"), "PASS").otherwise("FAIL").alias(
            "status"
        ),
    )


def _percent_null(c: Column) -> Column:
    share = F.sum(F.when(c.isNull(), 1).otherwise(0)) * F.lit(100.0) / F.count(F.lit(1))
    return F.when(F.count(F.lit(1)) > 0, F.round(share, 2))


def null_percent(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL share of every column and the row count, in one scan; NULL for an empty table."""
    names = list(columns or frame.columns)
    wide = frame.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[_percent_null(quoted(c)).alias(f"__{i}") for i, c in enumerate(names)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"__{i}").cast("double").alias("null_pct"),
            F.col("__rows").alias("total_rows"),
        )
        for i, c in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _nested_text(c: Column, dtype: T.DataType) -> Column:
    """JSON of texts that is equal exactly when the values are: maps in the order of their keys."""
    if isinstance(dtype, T.ArrayType):
        return F.to_json(F.transform(c, lambda x: _nested_text(x, dtype.elementType)))
    if isinstance(dtype, T.StructType):
        parts = [_nested_text(c.getField(f.name), f.dataType) for f in dtype.fields]
        return F.when(c.isNotNull(), F.to_json(F.array(*parts)) if parts else F.lit("[]"))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.to_json(F.array(
                _nested_text(e["key"], dtype.keyType), _nested_text(e["value"], dtype.valueType)
            )),
        )
        return F.to_json(F.array_sort(entries))
    if isinstance(dtype, FLOATING):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, TEMPORAL):  # the text of a timestamp can stand for two instants
        return _whole(c, dtype).cast("string")
    return c.cast("string")


def _value_text(frame: DataFrame, name: str, json_columns: Sequence[str] = ()) -> Column:
    """Text that is equal exactly when the stored values are equal."""
    dtype = frame.schema[name].dataType
    c = quoted(name)
    if isinstance(dtype, NESTED):
        return _nested_text(c, dtype)
    if name in json_columns:
        return nz.json(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def _long_values(frame: DataFrame, columns: Sequence[str], json_columns: Sequence[str]
                 ) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), _value_text(frame, c, json_columns).alias("value")
        )
        for c in columns
    ]
    return frame.select(F.inline(F.array(*cells)))


def _whole(c: Column, dtype: T.DataType) -> Column:
    """Whole numbers, flags and times as one 64-bit number that is equal when they are."""
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("long")


def value_distribution(
    frame: DataFrame, columns: Sequence[str], json_columns: Sequence[str] = ()
) -> DataFrame:
    """Rows per (column, value) for flag and enum columns; NULL is a value."""
    return (
        _long_values(frame, columns, json_columns)
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("value_count"))
    )


def distinct_count(
    frame: DataFrame,
    columns: Sequence[str] | None = None,
    json_columns: Sequence[str] = (),
    approx: bool = False,
    rsd: float = 0.02,
) -> DataFrame:
    """Distinct non-NULL values per column.

    Exact counting groups (column, value) pairs of all columns at once; every row sends one
    narrow value per column instead of a copy of all columns.  ``approx`` needs no shuffle of
    values at all.  Arrays, maps and structs are counted by their canonical JSON text.
    """
    names = list(columns or frame.columns)
    if approx:
        wide = frame.agg(
            *[
                F.approx_count_distinct(_value_text(frame, c, json_columns), rsd).alias(f"__{i}")
                for i, c in enumerate(names)
            ]
        )
        cells = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("distinct_count"))
            for i, c in enumerate(names)
        ]
        return wide.select(F.inline(F.array(*cells)))
    # the kind of value decides in which of three columns it travels
    cells = []
    for i, c in enumerate(names):
        dtype = frame.schema[c].dataType
        kind = "s"
        if c not in json_columns:
            kind = "n" if isinstance(dtype, WHOLE) else "d" if isinstance(dtype, FLOATING) else "s"
        value = {
            "n": _whole(quoted(c), dtype), "d": quoted(c).cast("double"),
            "s": _value_text(frame, c, json_columns) if kind == "s" else None,
        }[kind]
        cells.append(
            F.struct(
                F.lit(i).alias("i"),
                (value if kind == "n" else F.lit(None).cast("long")).alias("n"),
                (value if kind == "d" else F.lit(None).cast("double")).alias("d"),
                (value if kind == "s" else F.lit(None).cast("string")).alias("s"),
            )
        )
    seen = frame.select(F.inline(F.array(*cells))).distinct()
    # one spare row per column keeps columns without any value in the result
    spare = frame.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("i"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s"),
    )
    shown = F.get(F.lit(names), F.col("i"))
    return (
        seen.unionByName(spare)
        .groupBy("i")
        .agg(F.count_if(
            F.col("n").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
        ).alias("distinct_count"))
        .select(shown.alias("column_name"), "distinct_count")
    )


def duplicate_keys(frame: DataFrame, keys: Sequence[str], ordered: bool = True) -> DataFrame:
    """Keys that occur more than once, NULL keys grouped together, most frequent first."""
    found = (
        frame.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter(F.col("duplicate_count") > 1)
    )
    return found.orderBy(F.desc("duplicate_count")) if ordered else found


def key_candidates(frame: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Which column sets are unique and never NULL.

    Every candidate reads and groups its own columns as stored; copies of a key collapse
    before the shuffle.
    """

    def one(keys: Sequence[str]) -> DataFrame:
        any_null = F.lit(False)
        for k in keys:
            any_null = any_null | quoted(k).isNull()
        groups = frame.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
        return groups.agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.coalesce(F.sum(F.when(any_null, F.col("__n")).otherwise(0)), F.lit(0)).alias(
                "null_keys"
            ),
        ).select(F.lit(",".join(keys)).alias("candidate"), "*")

    found = one(candidates[0])
    for keys in candidates[1:]:
        found = found.unionByName(one(keys))
    return found.withColumn(
        "is_key", (F.col("row_count") == F.col("distinct_keys")) & (F.col("null_keys") == 0)
    )


def _as_number(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c).cast(METRIC_TYPE) / F.lit(1000000)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast(METRIC_TYPE) / F.lit(1000000)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast(METRIC_TYPE) * F.lit(86400)
    return c.try_cast(METRIC_TYPE)  # NULL for NaN, infinity and beyond its range


def column_metrics(
    frame: DataFrame,
    nulls: Sequence[str] = (),
    extremes: Sequence[str] = (),
    sums: Sequence[str] = (),
    renamed: dict[str, str] | None = None,
    nans: Sequence[str] = (),
) -> DataFrame:
    """Row count, NULL share, MIN, MAX, SUM and NaN count of the named columns, all in one scan.

    Long form ``column_name, metric, value, double_value``.  Times are epoch seconds.  A result that
    ``value`` cannot hold (NaN, infinity, beyond its range) is NULL there and stands in
    ``double_value``.  ``renamed`` maps the names of this side to the names used in the result.
    """
    shown = renamed or {}
    none = F.lit(None).cast("double")
    types = {f.name: f.dataType for f in frame.schema.fields}
    wanted: list[tuple[str, str, Column, Column]] = [
        ("*", "row_count", F.count(F.lit(1)).cast(METRIC_TYPE), none)
    ]
    wanted += [(c, "null_pct", _percent_null(quoted(c)).cast(METRIC_TYPE), none) for c in nulls]

    def native(c: str, found: Column) -> Column:
        return found.cast("double") if isinstance(types[c], T.NumericType) else none

    for c in extremes:
        for name, found in (("min", F.min(quoted(c))), ("max", F.max(quoted(c)))):
            wanted.append((c, name, _as_number(found, types[c]), native(c, found)))
    for c in dict.fromkeys(sums):
        fixed = quoted(c).try_cast("decimal(38,2)")
        lost = F.count_if(quoted(c).isNotNull() & fixed.isNull()) > 0
        exact = F.when(~lost, F.sum(fixed).try_cast(METRIC_TYPE))
        wanted.append((c, "sum", exact, native(c, F.sum(quoted(c).try_cast("double")))))
    wanted += [
        (c, "nan_count", F.count_if(F.isnan(quoted(c))).cast(METRIC_TYPE), none) for c in nans
    ]
    wide = frame.agg(
        *[v.alias(f"__{i}") for i, (_, _, v, _) in enumerate(wanted)],
        *[d.alias(f"__d{i}") for i, (_, _, _, d) in enumerate(wanted)],
    )
    rows = [
        F.struct(
            F.lit(shown.get(c, c)).alias("column_name"),
            F.lit(m).alias("metric"),
            F.col(f"__{i}").cast(METRIC_TYPE).alias("value"),
            F.when(F.col(f"__{i}").isNull(), F.col(f"__d{i}")).alias("double_value"),
        )
        for i, (c, m, _, _) in enumerate(wanted)
    ]
    return wide.select(F.inline(F.array(*rows)))


def distinct_metrics(frame: DataFrame, columns: Sequence[str], renamed=None) -> DataFrame:
    """Distinct counts in the long form of :func:`column_metrics`."""
    out = distinct_count(frame, columns).select(
        "column_name",
        F.lit("distinct_count").alias("metric"),
        F.col("distinct_count").cast(METRIC_TYPE).alias("value"),
        F.lit(None).cast("double").alias("double_value"),
    )
    for old, new in (renamed or {}).items():
        out = out.withColumn(
            "column_name",
            F.when(F.col("column_name") == old, F.lit(new)).otherwise(F.col("column_name")),
        )
    return out


def compare_metrics(source: DataFrame, target: DataFrame) -> DataFrame:
    """Side-by-side metrics with delta and match.  Input is a few rows per column.

    What no decimal can hold is compared as a double; a NaN matches a NaN, never a NULL.
    """
    both = source.withColumn("side", F.lit("s")).unionByName(
        target.withColumn("side", F.lit("t"))
    )

    def of(side: str, name: str = "value") -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    s_double, t_double = of("s", "double_value"), of("t", "double_value")
    return both.groupBy("column_name", "metric").agg(
        F.coalesce(of("s").cast("double"), s_double).alias("source_value"),
        F.coalesce(of("t").cast("double"), t_double).alias("target_value"),
        (of("t") - of("s")).cast("double").alias("delta"),
        (of("s").eqNullSafe(of("t")) & s_double.eqNullSafe(t_double)).alias("is_match"),
    )


def compare_distributions(source: DataFrame, target: DataFrame) -> DataFrame:
    """Value distributions side by side; a value absent on one side counts 0 there."""
    both = source.select(
        "column_name", "value", F.col("value_count").alias("s"), F.lit(0).cast("long").alias("t")
    ).unionByName(
        target.select(
            "column_name", "value", F.lit(0).cast("long").alias("s"),
            F.col("value_count").alias("t"),
        )
    )
    return both.groupBy("column_name", "value").agg(
        F.sum("s").alias("source_count"),
        F.sum("t").alias("target_count"),
        (F.sum("t") - F.sum("s")).alias("delta"),
        (F.sum("s") == F.sum("t")).alias("is_match"),
    )


@dataclass(frozen=True)
class BusinessCheck:
    """A condition that every row should meet."""

    name: str
    columns: tuple[str, ...]
    condition: str
    severity: str = "warning"
    description: str = ""


def business_checks(frame: DataFrame, checks: Sequence[BusinessCheck]) -> DataFrame:
    """All checks in one scan.  A check that names no column of the table is discarded.

    A condition that evaluates to NULL is counted apart from a failed one.
    """
    known = {c.lower() for c in frame.columns}
    live = [c for c in checks if any(n.lower() in known for n in c.columns)]
    if not live:
        raise ValueError("no check names a column of this table")
    wide = frame.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            F.sum(F.when(~F.expr(c.condition), 1).otherwise(0)).alias(f"__f{i}")
            for i, c in enumerate(live)
        ],
        *[
            F.sum(F.when(F.expr(c.condition).isNull(), 1).otherwise(0)).alias(f"__u{i}")
            for i, c in enumerate(live)
        ],
    )
    rows = [
        F.struct(
            F.lit(c.name).alias("check_name"),
            F.lit(c.severity).alias("severity"),
            F.lit(",".join(n for n in c.columns if n.lower() in known)).alias("columns"),
            F.coalesce(F.col(f"__f{i}"), F.lit(0)).alias("failed_rows"),
            F.coalesce(F.col(f"__u{i}"), F.lit(0)).alias("unknown_rows"),
            F.col("__rows").alias("total_rows"),
            (F.coalesce(F.col(f"__f{i}"), F.lit(0)) == 0).alias("passed"),
        )
        for i, c in enumerate(live)
    ]
    return wide.select(F.inline(F.array(*rows)))
