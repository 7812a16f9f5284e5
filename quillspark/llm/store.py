"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode with no folder configured, as in tests.
LOCAL_FALLBACK = "/tmp/quillspark-shared"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_FALLBACK
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the table survives lost executors.  It goes when
    the driver's JVM ends; `discard` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a materialized table that no later plan reads."""
    path = getattr(df, "_quill_path", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)
