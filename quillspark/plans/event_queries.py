"""Queries over event streams: guards, profiles, telemetry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards as G
from ..sources import telemetry
from ..sources.tables import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _gap(key: str) -> str:
    return f"(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id)) / 1e6"


def _duplicates(ttl: int) -> str:
    return f"SELECT event_id, user_id, event_type, coalesce({_gap('user_id, event_type')} < {ttl}, false) AS duplicate FROM events"


@query(_duplicates(600))
def g1_duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.duplicate_calls(_events(spark, sf_dir), ["user_id", "event_type"]).select("event_id", "user_id", "event_type", "duplicate")


@query(_duplicates(86400))
def g1_duplicate_guard_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard scaled to the table's sparse events."""
    return G.duplicate_calls(_events(spark, sf_dir), ["user_id", "event_type"], ttl=86400).select("event_id", "user_id", "event_type", "duplicate")


@query("SELECT event_id, sha1(event_type || ':' || user_id::VARCHAR || '|' || (props::JSON->>'k')) [:16] AS call FROM events")
def g2_argument_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", G.argument_key(F.col("event_type"), [F.col("user_id"), F.get_json_object("props", "$.k")]).alias("call"))


def _loops(gap: int) -> str:
    return f"""WITH p AS (SELECT *, {_gap('user_id, event_type')} AS pause FROM events), b AS (SELECT *, sum(CASE WHEN pause > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS burst FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, burst ORDER BY ts, event_id) AS edits FROM b)
SELECT event_id, user_id, event_type, burst::BIGINT AS burst, edits::INT AS edits, CASE WHEN edits >= 8 THEN 'block' WHEN edits = 5 THEN 'warn' ELSE 'pass' END AS action FROM n"""


@query(_loops(1800))
def g3_loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.loops(_events(spark, sf_dir), ["user_id", "event_type"]).select("event_id", "user_id", "event_type", "burst", "edits", "action")


@query(_loops(259200))
def g3_loop_guard_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts with pauses of up to three days, so that warnings and blocks occur."""
    return G.loops(_events(spark, sf_dir), ["user_id", "event_type"], gap=259200).select("event_id", "user_id", "event_type", "burst", "edits", "action")


_CALLS = "calls AS (SELECT user_id AS session, event_type AS tool, event_id, ts, (value * 10)::DECIMAL(18, 0)::BIGINT AS input, (props::JSON->>'k')::BIGINT AS output, (CASE WHEN event_id % 3 = 0 THEN 50 ELSE 0 END)::BIGINT AS cache_read, (event_id % 7)::BIGINT AS cache_write, ((props::JSON->>'k')::BIGINT % 5)::VARCHAR AS signature FROM events)"


def _calls(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return (_events(spark, sf_dir) if events is None else events).select(
        F.col("user_id").alias("session"), F.col("event_type").alias("tool"), "event_id", "ts", (F.col("value") * 10).cast("decimal(18,0)").cast("long").alias("input"), k.alias("output"),
        F.when(F.col("event_id") % 3 == 0, 50).otherwise(0).cast("long").alias("cache_read"), (F.col("event_id") % 7).alias("cache_write"), (k % 5).cast("string").alias("signature"),
    )


@query("""SELECT event_id, value, (event_id % 4 = 0) AS ranged, CASE WHEN event_id % 4 = 0 OR value * 100 <= 1500 THEN 'pass' WHEN value * 100 > 5000 THEN 'block-huge' ELSE 'block' END AS action FROM events""")
def g4_oversized_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = F.col("event_id") % 4 == 0
    return _events(spark, sf_dir).select("event_id", "value", ranged.alias("ranged"), G.oversized_reads(F.col("value") * 100, ranged).alias("action"))


_PROFILE = f"""{_CALLS}, p AS (SELECT session, count(*)::BIGINT AS calls, count(DISTINCT tool)::BIGINT AS tools, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM calls GROUP BY session)"""


@query(f"WITH {_PROFILE} SELECT *, input + output + cache_write AS billable, round(cache_read / greatest(1, input + cache_read), 6) AS cache_ratio FROM p")
def g5_g8_session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.profile(_calls(spark, sf_dir)).withColumn("cache_ratio", F.round("cache_ratio", 6))


@query(f"WITH {_CALLS}, n AS (SELECT session, tool, signature, count(*)::BIGINT AS n FROM calls GROUP BY ALL HAVING count(*) > 1) SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, tool, signature)::INT AS place FROM n QUALIFY place <= 10")
def g6_repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repeated_calls(_calls(spark, sf_dir))


@query(f"WITH {_CALLS} SELECT session, event_id, input + output AS total, row_number() OVER (PARTITION BY session ORDER BY input + output DESC, event_id)::INT AS place FROM calls QUALIFY place <= 10")
def g7_heaviest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.heaviest_turns(_calls(spark, sf_dir)).select("session", "event_id", (F.col("input") + F.col("output")).alias("total"), "place")


@query(f"""WITH {_PROFILE}, r AS (SELECT session, count(*) AS reps FROM (SELECT session FROM calls GROUP BY session, tool, signature HAVING count(*) > 1) GROUP BY session),
o AS (SELECT session, count(*) FILTER (input >= 200) AS big, max(c) AS edits FROM (SELECT *, count(*) OVER (PARTITION BY session, tool) AS c FROM calls) GROUP BY session)
SELECT session, array_to_string([x FOR x IN [CASE WHEN coalesce(reps, 0) > 0 THEN 'avoid repeated calls' END, CASE WHEN edits >= 8 THEN 'step back from edit loops' END, CASE WHEN big > 0 THEN 'read large files in ranges' END,
  CASE WHEN cache_read / greatest(1, input + cache_read) < 0.3::DOUBLE AND input > 0 THEN 'keep the context stable for caching' END] IF x IS NOT NULL], '; ') AS advice FROM p LEFT JOIN r USING (session) JOIN o USING (session)""")
def g9_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    reps = calls.groupBy("session", "tool", "signature").agg(F.count("*").alias("n")).groupBy("session").agg(F.count_if(F.col("n") > 1).alias("reps"))
    edits = calls.groupBy("session", "tool").agg(F.count("*").alias("n"), F.count_if(F.col("input") >= 200).alias("big")).groupBy("session").agg(F.max("n").alias("edits"), F.sum("big").alias("big"))
    p = G.profile(calls).join(reps, "session").join(edits, "session")
    return p.select("session", F.array_join(G.recommendations(p, F.when(F.col("edits") >= 8, 1).otherwise(0), F.col("reps"), F.col("big")), "; ").alias("advice"))


# -- H: telemetry


@query("SELECT event_id AS id, user_id, event_type, ts AS created_at, value, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def h1_recent_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report: the limit is the feature."""
    rows = _events(spark, sf_dir).withColumnsRenamed({"event_id": "id", "ts": "created_at"})
    return G.recent(rows, 20, ["id", "user_id", "event_type", "created_at", "value", "props"])


@query("SELECT count(*)::BIGINT AS kept, min(event_id)::BIGINT AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY")
def h2_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumnsRenamed({"event_id": "id", "ts": "created_at"})
    return G.retained(rows, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 10).agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def s10_upsert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latest_by_key(_events(spark, sf_dir), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    """The events as stored transform events, a folder a day."""
    root = shared_folder(spark, "telemetry")
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("kind"), F.floor("value").alias("before_tokens"), F.floor(F.col("value") / 2).alias("after_tokens"), (F.col("event_id") % 50).alias("latency_ms"))
    telemetry.record(rows, root, "transform_events")
    return root


@query("SELECT event_id AS id, user_id::VARCHAR AS session_id, event_type AS kind, floor(value)::INT AS before_tokens FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def h1_recent_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest from the stored table, of which the newest days are read: the limit is the feature."""
    return telemetry.recent(spark, _recorded(spark, sf_dir), "transform_events", 20, ["id", "session_id", "kind", "before_tokens"])


@query("SELECT event_type AS kind, count(*)::BIGINT AS kept, min(event_id)::BIGINT AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 10 DAY GROUP BY event_type")
def h2_retired_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the stored table after older days were dropped and the day of the limit was cut."""
    root = _recorded(spark, sf_dir)
    telemetry.retire(spark, root, "transform_events", dt.datetime(2024, 1, 25, 12), 10)
    return telemetry.stored(spark, root, "transform_events").groupBy("kind").agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))
