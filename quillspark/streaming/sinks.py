"""Upserts of streams into stored tables: INSERT OR REPLACE by key, batch by batch.

A table is Parquet, partitioned by a bucket of its key.  A batch's keys name the
buckets that are read, merged (the row of the later batch wins, within a batch
the one that comes last by `order`) and written over; no other bucket is opened.
A batch is done when its number stands in the ledger beside the table, so one
that is replayed after that changes nothing, and one that is replayed after a
crash before it comes to the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.guards import latest_by_key
from ..sources.publish import exists, folders, fs_of, move, remove

#: The batch that wrote a row, and the bucket of its key.
BATCH, BUCKET = "_batch", "_bucket"


def done(spark: SparkSession, root: str, batch_id: int) -> bool:
    """Whether the batch stands in the table's ledger."""
    return exists(spark, f"{root}/_ledger/{batch_id}")


def upsert_batch(rows: DataFrame, root: str, key: str, order: list[Column], batch_id: int, buckets: int = 64) -> bool:
    """Puts a batch's rows into the table at root, replacing those of the same keys; False if the batch had been put there before.

    A null key is one key.  An empty batch only marks itself done.  The number
    of buckets belongs to the table and must stay what it was.
    """
    spark = rows.sparkSession
    if done(spark, root, batch_id):
        return False
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    new = latest_by_key(rows, key, order).withColumn(BATCH, F.lit(batch_id).cast("long")).withColumn(BUCKET, bucket)
    # written first, the batch is computed once, its folders name the buckets, and nothing is read from what it replaces
    coming, staged = (f"{root}/_{name}-{uuid.uuid4().hex}" for name in ("coming", "staged"))
    new.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(coming)  # a file a bucket, not one a task and bucket
    touched = sorted(int(f.split("=")[1]) for f in folders(spark, coming))
    if touched:
        data = f"{root}/data"
        merged = spark.read.schema(new.schema).parquet(coming)
        if exists(spark, data):
            old = spark.read.schema(new.schema).parquet(data).where(F.col(BUCKET).isin(touched))
            merged = latest_by_key(old.unionByName(merged), key, [F.col(BATCH)])
        merged.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(staged)
        for b in touched:  # renames are the driver's, a folder each
            move(spark, f"{staged}/{BUCKET}={b}", f"{data}/{BUCKET}={b}")
        remove(spark, staged)
    remove(spark, coming)
    fs, mark = fs_of(spark, f"{root}/_ledger/{batch_id}")
    fs.mkdirs(mark.getParent())
    fs.create(mark, True).close()
    return True


def stored(spark: SparkSession, root: str, schema) -> DataFrame:
    """The table's rows in the schema of what was put there; empty if nothing was."""
    if not exists(spark, f"{root}/data"):
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    return spark.read.schema(schema).parquet(f"{root}/data").select(*names)


def upsert_stream(stream: DataFrame, root: str, key: str, order: Callable[[], list[Column]], checkpoint: str, mode: str = "append", buckets: int = 64, **trigger) -> StreamingQuery:
    """Starts a query that puts every batch of the stream into the table at root."""

    def put(rows: DataFrame, batch_id: int) -> None:
        upsert_batch(rows, root, key, order(), batch_id, buckets)

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
