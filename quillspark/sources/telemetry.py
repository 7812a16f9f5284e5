"""Telemetry tables by day: the newest rows and retention touch the days they concern.

A table is partitioned by the day of created_at and sorted by it within.  Folder
names alone tell the days, so `recent` reads from the newest day on until it has
enough rows, and `retire` drops whole days and writes the day of the limit anew.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import recent as newest
from .publish import exists, folders, move, remove
from .writers import TABLES

DAY = "day"


def record(rows: DataFrame, root: str, table: str) -> None:
    """Appends rows in the table's schema.  A day with many rows is written by several tasks."""
    names = [c.strip().split(" ") for c in TABLES[table].split(",")]
    own = rows.select(*[F.col(n).cast(t).alias(n) for n, t in names]).withColumn(DAY, F.to_date("created_at"))
    dealt = own.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, "created_at", "id")
    dealt.write.mode("append").partitionBy(DAY).parquet(f"{root}/{table}")


def stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows, with their day; an empty table if nothing was recorded."""
    schema = f"{TABLES[table]}, {DAY} date"
    if not exists(spark, f"{root}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def days(spark: SparkSession, root: str, table: str) -> list[dt.date]:
    """The days that the table has, oldest first; rows without a time have none."""
    names = [f.split("=")[1] for f in folders(spark, f"{root}/{table}") if f.startswith(f"{DAY}=")]
    return sorted(dt.date.fromisoformat(n) for n in names if n[0].isdigit())


def recent(spark: SparkSession, root: str, table: str, n: int, columns: list[str]) -> DataFrame:
    """The n newest rows by created_at, ties by larger id, from as few of the newest days as hold them; rows without a time are not among them."""
    found, rows = days(spark, root, table), stored(spark, root, table)
    taken, since = 1, None
    while found:
        since = found[-min(taken, len(found))]
        if taken >= len(found) or rows.where(F.col(DAY) >= F.lit(since)).limit(n).count() >= n:
            break
        taken *= 2
    return newest(rows.where(F.col(DAY) >= F.lit(since)) if since else rows.where("false"), n, columns)


def retire(spark: SparkSession, root: str, table: str, now: dt.datetime, keep_days: int = 90) -> list[dt.date]:
    """Removes the rows before now less keep_days, and those without a time; returns the days that went whole.

    now: an instant in the session's time zone.  The day of the limit is staged
    and put in its own place; other days' files stay as they are.
    """
    limit = now - dt.timedelta(days=keep_days)
    path = f"{root}/{table}"
    gone = [d for d in days(spark, root, table) if d < limit.date()]
    for d in gone:
        remove(spark, f"{path}/{DAY}={d}")
    for f in folders(spark, path):
        if f.startswith(f"{DAY}=") and not f.split("=")[1][0].isdigit():
            remove(spark, f"{path}/{f}")
    edge = f"{path}/{DAY}={limit.date()}"
    if exists(spark, edge):
        rows = spark.read.schema(TABLES[table]).parquet(edge)
        limit_at = F.lit(limit.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        if rows.where(F.col("created_at") < limit_at).limit(1).count():
            staged = f"{root}/_staged-{uuid.uuid4().hex}"
            rows.where(F.col("created_at") >= limit_at).sortWithinPartitions("created_at", "id").write.parquet(staged)
            move(spark, staged, edge)
    return gone
