"""Stored distinct-count sketches that add up: per partition once, merged for every question.

A sketch of a column in one partition of a table is a few kB whatever the partition holds, and
sketches merge: the distinct count of any set of partitions, of the whole table or of two sides
together comes from the stored sketches alone.  A new partition reads only itself.

Values are sketched as text, whole numbers as numbers, so that both sides of a comparison hash alike
whatever the width of their types.  Estimates have a relative standard error of about
0.83 / sqrt(2^lg_k) (0.013 for the default 12).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evenkeel.operators.projection import quoted

LG_K = 12
SKETCH_SCHEMA = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def standard_error(lg_k: int = LG_K) -> float:
    return 0.83 / 2 ** (lg_k / 2)


def _value(frame: DataFrame, name: str) -> Column:
    dtype = frame.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return quoted(name).cast("long")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (quoted(name) + F.lit(0.0)).cast("string")  # both zeros are one value
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(quoted(name))
    return quoted(name).cast("string")


def column_sketches(
    frame: DataFrame, columns: Sequence[str], part: Column | None = None, lg_k: int = LG_K,
    renamed: dict[str, str] | None = None,
) -> DataFrame:
    """part, column_name, row_count, null_count, sketch: one row per partition and column.

    One scan; sketches are built where the rows are, and one per task and partition is shuffled.
    ``renamed`` maps the names of this side to the names used in the result.
    """
    shown = renamed or {}
    part = F.lit("") if part is None else part.cast("string")
    wide = frame.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.hll_sketch_agg(_value(frame, c), lg_k).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    cells = [
        F.struct(
            F.lit(shown.get(c, c)).alias("column_name"), F.col("row_count"),
            F.col(f"n{i}").alias("null_count"), F.col(f"s{i}").alias("sketch"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select("part", F.inline(F.array(*cells)))


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    """All stored sketches; none where nothing was stored yet."""
    try:
        return spark.read.schema(SKETCH_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SKETCH_SCHEMA)


def add_partitions(
    frame: DataFrame, columns: Sequence[str], part: str, path: str, lg_k: int = LG_K,
) -> list[str]:
    """Sketch the partitions that have no stored sketch yet; their names are returned.

    ``part`` is a column of the frame, best one that the files are partitioned by: the filter on the
    new names is on the bare column, so that nothing else is read.  Partitions are taken as complete
    when they are first seen.
    """
    known = stored_sketches(frame.sparkSession, path).select("part").distinct()
    values = frame.select(quoted(part).alias("value")).distinct()
    new = [
        r["value"]
        for r in values.join(known, F.coalesce(values["value"].cast("string"), F.lit("")) == known["part"],
                             "left_anti").collect()
    ]
    if not new:
        return []
    wanted = quoted(part).isin([v for v in new if v is not None])
    if None in new:
        wanted = wanted | quoted(part).isNull()
    found = column_sketches(
        frame.filter(wanted), columns, F.coalesce(quoted(part).cast("string"), F.lit("")), lg_k)
    found.write.mode("append").parquet(path)
    return sorted("" if v is None else str(v) for v in new)


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """column_name, row_count, null_count, distinct_estimate over all partitions."""
    return sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )


def compare_sketches(source: DataFrame, target: DataFrame, lg_k: int = LG_K, widths: float = 4) -> DataFrame:
    """Both sides from their sketches: estimates, that of the union, and a status.

    Two columns with the same values have the same union; a status of FAIL says that one side or the
    union has more distinct values than chance explains (``widths`` standard errors).
    """
    both = distinct_estimates(source).alias("s").join(
        distinct_estimates(target).alias("t"), ["column_name"], "full"
    )
    union = distinct_estimates(source.union(target)).select(
        "column_name", F.col("distinct_estimate").alias("union_estimate")
    )
    low = F.least("source_estimate", "target_estimate")
    apart = F.col("union_estimate") - low > widths * standard_error(lg_k) * F.col("union_estimate")
    return (
        both.select(
            "column_name", F.col("s.distinct_estimate").alias("source_estimate"),
            F.col("t.distinct_estimate").alias("target_estimate"),
        )
        .join(union, ["column_name"])
        .withColumn(
            "status",
            F.when(F.col("source_estimate").isNull() | F.col("target_estimate").isNull(), "FAIL")
            .when(apart, "FAIL").otherwise("PASS"),
        )
    )
