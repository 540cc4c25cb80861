"""What the operators of this package share: inputs, stored tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEPARATORS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, with its scheme; one of our own only where none is named
    and driver and tasks are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        spark.sparkContext.setCheckpointDir(named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    named = store.makeQualified(path).toString().rstrip("/")
    return re.sub("^file:/+", "file:///", named)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/evenkeel/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and what comes
    after neither repeats the work nor depends on the executors that did it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile hands Python about `most` bytes of rows at a time, as many rows as that may
    be (a longer row goes alone); a limit that the session itself has set stays as it is."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is not None:
        yield
        return
    spark.conf.set(limit, most)
    try:
        yield
    finally:
        spark.conf.unset(limit)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a column once per row although `use` mentions it often (also within lambdas)."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, WORD_GAP)
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")

