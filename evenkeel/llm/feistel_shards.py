"""Sharding by a keyed permutation of global row numbers.

Rows get the numbers 0 .. n-1 in the order of (doc_id, text checksum, size).  A balanced Feistel
network permutes the smallest square power-of-two domain that holds n; a value that falls outside
0 .. n-1 is permuted again until it is inside (cycle walking).  The permuted number p gives
`shard = p mod shards` and `slot = p div shards`: a document's place is computable from its row
number and the seed alone, counts differ by one at most, and slots have no gaps.

Law: `rows`.  Equal texts are not kept together, because counts one apart do not allow it.
`shard` sorts narrow rows only; `sharded_documents` (the pipeline's stage) sorts whole documents, once.  The
order is stored once, because row numbers need the size of
each sorted partition first, and a second sort could cut the ranges elsewhere.

Null doc_ids come first; a null text has size 1 and checksum 0.  Rows that agree in doc_id,
checksum and size may swap numbers with each other, which changes no result.  An empty table
gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from evenkeel.llm.common import stored

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0 .. n-1 at the positions i."""
    half = np.uint64(max(1, (max(1, int(n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.asarray(i, dtype=np.uint64).copy()
    walking = np.ones(len(x), dtype=bool)
    while walking.any():
        left, right = x[walking] >> half, x[walking] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, seed * 1_000_003 + r) & mask)
        x[walking] = (left << half) | right
        walking = x >= np.uint64(n)
    return x.astype(np.int64)


def permutation(seed: int):
    @pandas_udf("long")
    def place(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), int(n.iloc[0]), seed) if len(row) else row)

    return place


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add row (0 .. n-1 in the given order) and n; one narrow sort, no single-task window."""
    at = F.monotonically_increasing_id()
    placed = stored(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), at.alias("_at")),
        "numbered",
    )
    # one row per sorted partition: their number is set by the session, not by the rows
    parts = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_from")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select(
        "_part", "_from",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("n"),
    )
    return (
        placed.join(F.broadcast(sizes), "_part")
        .withColumn("row", F.col("_at") - F.col("_from") + F.col("_before"))
        .drop("_part", "_at", "_from", "_before")
    )


def _sized(text: Column) -> list[Column]:
    return [
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    ]


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    if shards < 1:
        raise ValueError("at least one shard is needed")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    place = permutation(seed)
    return numbered(rows, order).withColumn("_place", place("row", "n")).select(
        *rows.columns,
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(documents: DataFrame, shards: int = 8, seed: int = 20_240_607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`)."""
    return _placed(documents.select("doc_id", *_sized(F.col("text"))), shards, seed)


def sharded_documents(documents: DataFrame, shards: int = 8, seed: int = 20_240_607) -> DataFrame:
    """The documents with the columns of `shard`; a column of such a name is replaced."""
    rows = documents.select(F.struct("*").alias("doc"), "doc_id", *_sized(F.col("text")))
    placed = _placed(rows, shards, seed)
    own = [c for c in placed.columns if c not in ("doc", "doc_id")]
    kept = [F.col("doc")[c].alias(c) for c in documents.columns if c.lower() not in own]
    return placed.select(*kept, *own)
