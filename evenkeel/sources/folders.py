"""Where intermediate and stored results go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, with its scheme.

    Where none is named and driver and tasks are one process, a folder of our own; a cluster without
    one is an error, because executors would each write to a disk of their own.
    """
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
    return re.sub("^file:/+", "file:///", store.makeQualified(path).toString().rstrip("/"))


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/evenkeel/{what}-{uuid.uuid4().hex}"
