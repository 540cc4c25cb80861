"""Per-key ranking.

``row_number() <= n`` lets Spark keep only the first n rows of every key before the
shuffle, so a key that holds much of the data still sends a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(
    frame: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of every key; ``rank`` names an output column for the position."""
    name = rank or "__rank"
    ranked = frame.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_per_key(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(frame, keys, order, 1)
