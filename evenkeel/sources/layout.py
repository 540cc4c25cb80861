"""How stored tables are laid out, and whether two of them can be compared where they lie."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

from evenkeel.operators.projection import ColumnPair


@dataclass(frozen=True)
class Layout:
    """Declared buckets of a catalog table."""

    columns: tuple[str, ...]
    buckets: int


def declared_layout(spark: SparkSession, table: str) -> Layout | None:
    """The buckets that a catalog table is declared with; None without any."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    told = {r["col_name"]: r["data_type"] for r in rows}
    buckets, columns = told.get("Num Buckets"), told.get("Bucket Columns")
    if not buckets or not columns:
        return None
    return Layout(tuple(n.strip("` ").lower() for n in columns.strip("[]").split(",")), int(buckets))


def co_located(
    source: DataFrame, target: DataFrame, pairs: Sequence[ColumnPair], keys: Sequence[str],
    source_layout: Layout | None, target_layout: Layout | None,
) -> bool:
    """Do equal keys of two tables lie in buckets of the same number?

    Both are bucketed into as many buckets, by keys and nothing else and in the same order, and these
    keys are whole numbers of one type, so that the ledger groups them as they are stored.  Then
    :func:`evenkeel.operators.reconcile.ledger` plans no shuffle.
    """
    if not source_layout or not target_layout or source_layout.buckets != target_layout.buckets:
        return False
    if not set(source_layout.columns) <= {k.lower() for k in keys}:
        return False
    if len(source_layout.columns) != len(target_layout.columns):
        return False
    by_name = {p.source.lower(): p for p in pairs}
    for mine, theirs in zip(source_layout.columns, target_layout.columns):
        p = by_name.get(mine)
        if p is None or p.target.lower() != theirs:
            return False
        kind = source.schema[p.source].dataType
        if kind != target.schema[p.target].dataType or not isinstance(kind, T.IntegralType):
            return False
    return True


def write_bucketed(
    frame: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None,
) -> DataFrame:
    """Store a table in buckets, sorted within, so that every later comparison by ``keys`` is spared its
    shuffle.  This one shuffle goes to as many tasks as buckets: each bucket is one file."""
    writer = (
        frame.repartition(buckets, *keys).write.mode("overwrite")
        .bucketBy(buckets, *keys).sortBy(*keys)
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return frame.sparkSession.table(table)
