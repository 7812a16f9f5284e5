"""Streams with typed state and stored tables: equal to the batch, bounded a key, purged in time, safe to replay."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import guards as G
from quillspark.streaming import profile as P
from quillspark.streaming import sinks

START = dt.datetime(2024, 1, 1)
CALLS = "session long, ts timestamp, event_id long, tool string, signature string, edited string, oversized boolean, input long, output long, cache_read long, cache_write long"


def call(session, second, event, tool="Read", signature="a", edited=None, oversized=False, size=1):
    return (session, START + dt.timedelta(seconds=second), event, tool, signature, edited, oversized, size, 2, 3, 1)


def feed(spark, folder, batches):
    """A stream that takes one batch a file, in order."""
    for k, rows in enumerate(batches):
        target = f"{folder}/part-{k}"
        spark.createDataFrame(rows, CALLS).coalesce(1).write.parquet(target)
        for name in os.listdir(target):
            if name.endswith(".parquet"):
                os.rename(f"{target}/{name}", f"{folder}/{k:03d}.parquet")
                os.utime(f"{folder}/{k:03d}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def run(stream, root, checkpoint, order="calls"):
    query = sinks.upsert_stream(stream, root, "session", lambda: [F.col(order)], checkpoint, mode="update", buckets=4)
    query.awaitTermination()
    return query


def test_profile_stream_equals_the_batch(spark, tmp_path):
    """Three batches, rows out of order and late within the delay, ties at the end of both lists, nulls."""
    (tmp_path / "in").mkdir()
    rows = [call(s, 60 * k, 100 * s + k, tool=["Read", "Grep", "Edit"][k % 3], signature=f"{(k * 7) % 13:02d}", edited=f"f{k % 4}" if k % 3 == 2 else None, oversized=k % 11 == 0, size=(k * 37) % 20) for s in range(3) for k in range(90)]
    rows += [call(0, 10, 9000, tool=None), call(0, 10, 9001, signature=None), call(1, 10, 9002, size=None), call(None, 10, 9003)]
    late = rows[:20]
    batches = [rows[20:120], rows[120:200] + late, rows[200:]]
    stream = P.profile_stream(feed(spark, str(tmp_path / "in"), batches), delay="3 hours")
    run(stream, str(tmp_path / "table"), str(tmp_path / "cp"))
    got = {r.session: r for r in sinks.stored(spark, str(tmp_path / "table"), stream.schema).collect()}

    calls = spark.createDataFrame(rows, CALLS)
    for r in G.profile(calls).collect():
        mine = got[r.session]
        assert [mine[c] for c in ("calls", "tools", "output", "cache_read", "cache_write")] == [r[c] for c in ("calls", "tools", "output", "cache_read", "cache_write")]
        assert mine.input == r.input and mine.billable == r.billable and mine.cache_ratio == pytest.approx(r.cache_ratio)
    named = calls.where("tool is not null and signature is not null")
    for s in (0, 1, 2):
        want = [(r.n, r.tool, r.signature) for r in G.repeated_calls(named.where(F.col("session") == s)).orderBy("place").collect()]
        assert [tuple(e) for e in got[s].repeated] == want and len(want) == P.TOP
        heavy = [(r.input + r.output, r.event_id) for r in G.heaviest_turns(calls.na.fill(0, ["input"]).where(F.col("session") == s)).orderBy("place").collect()]
        assert [tuple(e) for e in got[s].heaviest] == heavy
        edits = calls.where((F.col("session") == s) & F.col("edited").isNotNull()).groupBy("edited").count().where(f"count >= {P.LOOP_AT}").count()
        assert got[s].loops == edits > 0 and got[s].oversized == sum(r[0] == s and r[6] for r in rows)
    assert got[None].calls == 1 and "avoid repeated calls" in got[0].advice

    # a key's lists hold TOP entries at most, whatever the session's length
    for name in ("repeated", "heavy"):
        kept = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).groupBy("key").count()
        assert kept.agg(F.max("count")).first()[0] == P.TOP
    totals = spark.read.format("statestore").option("stateVarName", "totals").load(str(tmp_path / "cp"))
    assert {r.s: r.c for r in totals.select(F.col("key.session").alias("s"), F.col("value.calls").alias("c")).collect()} == {s: r.calls for s, r in got.items()}


def test_a_later_batch_after_the_delay_is_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[call(1, 0, 1)], [call(2, 100_000, 2)], [call(3, 100_000, 3)], [call(1, 5, 4), call(2, 100_001, 5)]]
    stream = P.profile_stream(feed(spark, str(tmp_path / "in"), batches), delay="1 hour")
    run(stream, str(tmp_path / "table"), str(tmp_path / "cp"))
    got = {r.session: r.calls for r in sinks.stored(spark, str(tmp_path / "table"), stream.schema).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("after, stays", [(P.PURGE_S - 1, True), (P.PURGE_S + 1, False)])
def test_sessions_are_purged_after_a_day(spark, tmp_path, after, stays):
    """The watermark stands `after` seconds past the first session's last event; batches follow so that timers fire."""
    (tmp_path / "in").mkdir()
    batches = [[call(1, 0, 1), call(1, 0, 2)], [call(2, after, 3)], [call(2, after, 4)], [call(2, after, 5)]]
    stream = P.profile_stream(feed(spark, str(tmp_path / "in"), batches), delay="0 seconds")
    run(stream, str(tmp_path / "table"), str(tmp_path / "cp"))
    kept = {r.s for r in spark.read.format("statestore").option("stateVarName", "totals").load(str(tmp_path / "cp")).select(F.col("key.session").alias("s")).collect()}
    assert kept == ({1, 2} if stays else {2})
    for name in ("tools", "calls"):
        keys = {r.s for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).select(F.col("key.session").alias("s")).collect()}
        assert keys == kept


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for n in names if n.endswith(".parquet")}


def test_upsert_replaces_rows_of_its_keys_alone(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "id string, v long"
    put = lambda rows, b: sinks.upsert_batch(spark.createDataFrame(rows, schema), root, "id", [F.col("v")], b, buckets=16)
    table = lambda: {r.id: r.v for r in sinks.stored(spark, root, spark.createDataFrame([], schema).schema).collect()}
    assert table() == {}
    assert put([(f"k{i}", i) for i in range(40)] + [("k1", 7), (None, 1)], 0)
    assert table() == {**{f"k{i}": i for i in range(40)}, "k1": 7, None: 1}
    before = files(root)
    assert put([("k3", -5), ("new", 1)], 1)  # the later batch wins, though its order is smaller
    after = files(root)
    assert table()["k3"] == -5 and table()["new"] == 1 and len(table()) == 42
    gone = {f.split("/data/")[1].split("/")[0] for f in set(before) - set(after)}
    assert 1 <= len(gone) <= 2 and {f for f in before if f.split("/data/")[1].split("/")[0] not in gone} <= set(after)
    assert all(after[f] == before[f] for f in after if f in before)
    # replayed: the last batch, and an earlier one
    assert not put([("k3", 99)], 1) and not put([("k0", 99)], 0) and files(root) == after
    # replayed after a crash before the ledger was written: the same rows again
    os.remove(f"{root}/_ledger/1")
    assert put([("k3", -5), ("new", 1)], 1) and table()["k3"] == -5 and len(table()) == 42
    assert put([], 2) and sinks.done(spark, root, 2) and len(table()) == 42
    assert not [n for n in os.listdir(root) if n.startswith(("_coming", "_staged"))]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root, cp = str(tmp_path / "table"), str(tmp_path / "cp")
    stream = P.profile_stream(feed(spark, str(tmp_path / "in"), [[call(1, 0, 1)]]))
    run(stream, root, cp)
    more = [call(1, 10, 2), call(2, 10, 3)]
    spark.createDataFrame(more, CALLS).coalesce(1).write.parquet(str(tmp_path / "more"))
    for name in os.listdir(tmp_path / "more"):
        if name.endswith(".parquet"):
            os.rename(tmp_path / "more" / name, tmp_path / "in" / "900.parquet")
    run(P.profile_stream(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in/*.parquet"))), root, cp)
    assert {r.session: r.calls for r in sinks.stored(spark, root, stream.schema).collect()} == {1: 2, 2: 1}
