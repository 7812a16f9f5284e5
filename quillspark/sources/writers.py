"""Sinks: journals, telemetry tables, artifact files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .publish import new_version, publish

#: Schemas of the telemetry tables.
TABLES = {
    "sessions": "id string, started_at timestamp, model_family string, repo_path string",
    "transform_events": "id long, session_id string, created_at timestamp, kind string, before_tokens int, after_tokens int, latency_ms long",
    "compaction_events": "id long, session_id string, created_at timestamp, before_tokens int, after_tokens int",
    "benchmark_runs": "id long, suite string, created_at timestamp, score double, baseline double, delta double",
    "repo_memory_usage": "id long, session_id string, created_at timestamp, artifact string, tokens int",
}


def init_store(spark: SparkSession, root: str) -> None:
    """Creates the telemetry tables that are not there yet, empty."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def save_states(states: DataFrame, path: str) -> None:
    """Session states as JSON lines in a new version, made current when it is whole; readers.states loads them.

    So states may be written from what was loaded, and a write that fails
    leaves what was there.
    """
    version = new_version("states")
    states.write.option("ignoreNullFields", "false").json(f"{path}/{version}")
    publish(states.sparkSession, path, version)


def append(rows: DataFrame, root: str, table: str) -> None:
    """Appends rows to a telemetry table, in its schema."""
    names = [c.strip().split(" ") for c in TABLES[table].split(",")]
    rows.select(*[F.col(n).cast(t).alias(n) for n, t in names]).write.mode("append").parquet(f"{root}/{table}")


def timestamp_of(text: str) -> Column:
    """Times kept as text, in ISO 8601 or as Unix seconds."""
    c = F.col(text)
    return F.coalesce(F.timestamp_seconds(F.expr(f"try_cast(`{text}` as long)")), F.try_to_timestamp(c))


def journal(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of events as JSON lines, each once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def artifacts(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as JSON lines and as Markdown lists, in one folder per artifact."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{root}/{name}/json")
        row = F.concat(F.lit("- "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]))
        table.select(row.alias("value")).write.mode("overwrite").text(f"{root}/{name}/markdown")
