"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.sources.folders import new_folder

PARTS = 64


def numbered(frame: DataFrame, order: Sequence[Column], name: str = "seq", parts: int = PARTS) -> DataFrame:
    """The rows with ``name``: 1, 2, 3, ... in the given order, which should be total.

    The rows are dealt into at most ``parts`` ranges of the order and stored so, because another
    evaluation would draw other ranges.  Each range is numbered by itself and moved on by the rows in
    the ranges before; only their sizes reach the driver.
    """
    spark, folder = frame.sparkSession, new_folder(frame.sparkSession, "ranges")
    dealt = frame.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(folder)
    stored = spark.read.schema(dealt.schema).parquet(folder)
    sizes = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()
    ahead, total = {}, 0
    for number, n in sorted(tuple(r) for r in sizes):
        ahead[number] = total
        total += n
    if not ahead:
        return frame.withColumn(name, F.lit(None).cast("long"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    moved = F.element_at(F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv]), F.col("__range"))
    return stored.withColumn(name, (within + moved).cast("long")).drop("__range")
