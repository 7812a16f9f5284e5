"""Telemetry by day, artifacts and states in versions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import artifacts, publish, readers, telemetry, writers

SCHEMA = "id long, session_id string, created_at timestamp, kind string, before_tokens int, after_tokens int, latency_ms long"


@pytest.fixture
def store(spark, tmp_path):
    rows = [(k, "s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k), "json", 5, 3, 0) for k in range(100)] + [(1000, "s", None, "json", 1, 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    telemetry.record(df.where("id % 2 = 0"), str(tmp_path), "transform_events")
    telemetry.record(df.where("id % 2 = 1"), str(tmp_path), "transform_events")
    return str(tmp_path), rows


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_recent_reads_the_newest_days(spark, store):
    root, rows = store
    got = telemetry.recent(spark, root, "transform_events", 5, ["id"])
    assert [r.id for r in got.collect()] == [99, 98, 97, 96, 95]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-28" in plan  # two days of 30
    assert [r.id for r in telemetry.recent(spark, root, "transform_events", 1000, ["id"]).collect()] == list(range(99, -1, -1))
    assert telemetry.recent(spark, f"{root}/none", "transform_events", 5, ["id"]).count() == 0
    assert telemetry.stored(spark, root, "transform_events").count() == 101


def test_retention_drops_days_and_cuts_one(spark, store):
    root, rows = store
    before = files(root)
    now = dt.datetime(2024, 1, 25, 12)
    gone = telemetry.retire(spark, root, "transform_events", now, 10)
    kept = sorted(r.id for r in telemetry.stored(spark, root, "transform_events").collect())
    assert kept == sorted(r[0] for r in rows if r[2] and r[2] >= now - dt.timedelta(days=10))
    assert gone == [dt.date(2024, 1, d) for d in range(1, 15)]
    after = files(root)
    assert {f for f in before if "day=2024-01-15" not in f and f in after} == {f for f in after if "day=2024-01-15" not in f} and all(before[f] == after[f] for f in after if f in before)
    assert telemetry.retire(spark, root, "transform_events", now, 10) == [] and files(root) == after


def test_artifacts_are_eight_pairs(spark, tmp_path):
    sources = [("app/page.tsx", "x"), ("src/Card.tsx", "x"), ("src/lib.rs", "fn a() {}"), ("package.json", '{"dependencies": {"react": "18"}}'), ("tool.toml", "a = 1")]
    tree = spark.createDataFrame(sources, "path string, content string")
    commits = spark.createDataFrame([("src/lib.rs", 1), ("src/lib.rs", 2), ("app/page.tsx", 3)], "path string, seq long")
    root = str(tmp_path / "art")
    manifest = artifacts.write(tree, root, commits)
    assert [name for name, _, _ in manifest] == artifacts.ORDER
    text = {name: [r.value for r in spark.read.text(md).collect()] for name, _, md in manifest}
    assert text["routes"] == ["# Routes", "", "- / | app/page.tsx | next_app"] and text["schema"] == ["# Schema", "", "Nothing was found in this scan."]
    assert text["recent-hotspots"] == ["# Recent Hotspots", "", "- app/page.tsx | 1", "- src/lib.rs | 2"]
    assert text["dependency-map"][2:] == ["- package.json | react | 18 | dependencies"]
    one = artifacts.read(spark, root, "architecture", "framework string, top_level_dirs array<string>, source_file_count long, config_file_count long").first()
    assert one.framework == "react" and one.top_level_dirs == ["app", "src"] and one.source_file_count == 3

    # a write that fails leaves the version before
    before = publish.current(spark, root)
    with pytest.raises(Exception, match="lost"):
        artifacts.write(tree.withColumn("content", F.when(F.col("path") == "src/lib.rs", F.raise_error(F.lit("lost"))).otherwise(F.col("content"))), root)
    assert publish.current(spark, root) == before and artifacts.read(spark, root, "routes", "route string").count() == 1
    artifacts.write(tree.where("path = 'none'"), root)
    assert publish.current(spark, root) != before and artifacts.read(spark, root, "routes", "route string").count() == 0 and not os.path.exists(f"{root}/{before[0]}")


def test_states_may_be_saved_from_what_was_loaded(spark, tmp_path):
    schema, path = "session long, turns long", str(tmp_path / "states")
    writers.save_states(spark.createDataFrame([(1, 1), (2, 5)], schema), path)
    for _ in range(3):
        writers.save_states(readers.states(spark, path, schema).withColumn("turns", F.col("turns") + 1), path)
    assert sorted((r.session, r.turns) for r in readers.states(spark, path, schema).collect()) == [(1, 4), (2, 8)]
    with pytest.raises(Exception, match="lost"):
        writers.save_states(readers.states(spark, path, schema).withColumn("turns", F.raise_error(F.lit("lost")).cast("long")), path)
    assert readers.states(spark, path, schema).count() == 2
