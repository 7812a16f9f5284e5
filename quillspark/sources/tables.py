"""Results that several branches read, computed once, and folders for tables that queries store."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode with no folder configured, as in tests.
LOCAL_FALLBACK = "/tmp/quillspark-shared"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; it goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_FALLBACK
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}-{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def kept(df: DataFrame) -> DataFrame:
    """df computed once: in the session's checkpoint folder where there is one, else in the executors' memory and disk.

    Either survives a lost executor, the second by computing the lost part again.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)
