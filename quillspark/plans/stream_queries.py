"""Queries that run as streams over the tables, and into stored tables, with the SQL of what they must come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming import profile, sinks
from .event_queries import _CALLS, _calls, _events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = _events(spark, sf_dir).schema
    # a pattern names a table of one file as well as one of many
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


_LISTED = "array_to_string(list({0} ORDER BY place), '; ')"


@query(f"""WITH {_CALLS}, p AS (SELECT session, count(*)::BIGINT AS calls, count(DISTINCT tool)::BIGINT AS tools, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write,
  count(*) FILTER (input >= 200)::BIGINT AS oversized FROM calls GROUP BY session),
n AS (SELECT session, tool, signature, count(*) AS n FROM calls GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, tool, signature) AS place FROM n),
rr AS (SELECT session, count(*)::BIGINT AS repeated_calls, {_LISTED.format("tool || ' ' || signature || ' x' || n").replace("ORDER BY place)", "ORDER BY place) FILTER (place <= 10)")} AS repeated FROM r GROUP BY session),
h AS (SELECT session, {_LISTED.format("event_id || ':' || total")} AS heaviest FROM (SELECT session, event_id, input + output AS total, row_number() OVER (PARTITION BY session ORDER BY input + output DESC, event_id) AS place FROM calls QUALIFY place <= 10) GROUP BY session),
l AS (SELECT session, count(*) FILTER (c >= 8)::BIGINT AS loops FROM (SELECT session, tool, count(*) AS c FROM calls GROUP BY ALL) GROUP BY session)
SELECT session, calls, tools, input, output, cache_read, cache_write, coalesce(repeated_calls, 0) AS repeated_calls, loops, oversized, coalesce(repeated, '') AS repeated, heaviest, input + output + cache_write AS billable, round(cache_read / greatest(1, input + cache_read), 6) AS cache_ratio,
  array_to_string([x FOR x IN [CASE WHEN coalesce(repeated_calls, 0) > 0 THEN 'avoid repeated calls' END, CASE WHEN loops > 0 THEN 'step back from edit loops' END, CASE WHEN oversized > 0 THEN 'read large files in ranges' END,
  CASE WHEN cache_read / greatest(1, input + cache_read) < 0.3::DOUBLE AND input > 0 THEN 'keep the context stable for caching' END] IF x IS NOT NULL], '; ') AS advice
FROM p JOIN h USING (session) JOIN l USING (session) LEFT JOIN rr USING (session)""")
def g5_g9_profile_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions profiled live, in update mode, each batch put over the last in a stored table."""
    calls = _calls(spark, sf_dir, event_stream(spark, sf_dir)).withColumns({"edited": F.col("tool"), "oversized": F.col("input") >= 200})
    out = profile.profile_stream(calls, loop_at=8, delay="365 days")
    root = shared_folder(spark, "profiles")
    sinks.upsert_stream(out, f"{root}/table", "session", lambda: [F.col("calls")], f"{root}/checkpoint", mode="update").awaitTermination()

    def joined(entries: str, line) -> Column:
        return F.array_join(F.transform(entries, line), "; ").alias(entries)

    rows = sinks.stored(spark, f"{root}/table", out.schema)
    return rows.select(
        *[c for c in rows.columns if c not in ("repeated", "heaviest", "cache_ratio", "advice")],
        joined("repeated", lambda e: F.concat(e["tool"], F.lit(" "), e["signature"], F.lit(" x"), e["n"].cast("string"))),
        joined("heaviest", lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["total"].cast("string"))),
        F.round("cache_ratio", 6).alias("cache_ratio"),
        F.array_join("advice", "; ").alias("advice"),
    )


#: Three batches by the day of the month, in order of time.
_BATCH = "least((day(ts) - 1) // 10, 2)"


@query(f"SELECT user_id, event_id, event_type, value, {_BATCH}::BIGINT AS batch FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_BATCH} DESC, value, event_id) = 1")
def s10_upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's row after three batches of INSERT OR REPLACE and one replayed; within a batch the smallest value wins."""
    batch = F.least(F.expr("(day(ts) - 1) div 10"), F.lit(2))
    events = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", batch.alias("batch"))
    root = shared_folder(spark, "sessions")
    for b in (0, 1, 2, 1):
        sinks.upsert_batch(events.where(F.col("batch") == b), root, "user_id", [-F.col("value"), -F.col("event_id")], b)
    return sinks.stored(spark, root, events.schema)
