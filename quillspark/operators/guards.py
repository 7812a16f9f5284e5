"""Guards over tool-event streams, in batch: duplicates, loops, oversized reads; session profiles.

Events: session, ts, event_id (breaks ties of time), and what each guard names.
All guards are windows over one partitioning by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DUPLICATE_TTL = 600
LOOP_GAP = 1800
WARN_AT, BLOCK_AT = 5, 8
READ_LIMIT, READ_HUGE = 1500, 5000


def argument_key(tool: Column, parts: list[Column]) -> Column:
    """First 16 hex digits of the SHA-1 of tool and joined arguments."""
    return F.left(F.sha1(F.concat_ws(":", tool, F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))), F.lit(16))


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def duplicate_calls(events: DataFrame, key: list[str], ttl: float = DUPLICATE_TTL) -> DataFrame:
    """events with gap_s and duplicate: the same call within ttl seconds before; a blocked call refreshes the window.

    A gap of exactly ttl is no duplicate.
    """
    w = Window.partitionBy(*key).orderBy("ts", "event_id")
    gap = _seconds(F.col("ts")) - F.lag(_seconds(F.col("ts"))).over(w)
    return events.withColumn("gap_s", gap).withColumn("duplicate", F.coalesce(F.col("gap_s") < ttl, F.lit(False)))


def loops(events: DataFrame, key: list[str], gap: float = LOOP_GAP, warn_at: int = WARN_AT, block_at: int = BLOCK_AT) -> DataFrame:
    """events with burst, count in the burst and action; a gap of more than `gap` seconds opens a new burst."""
    w = Window.partitionBy(*key).orderBy("ts", "event_id")
    pause = _seconds(F.col("ts")) - F.lag(_seconds(F.col("ts"))).over(w)
    out = events.withColumn("burst", F.sum(F.when(pause > gap, 1).otherwise(0)).over(w))
    out = out.withColumn("edits", F.row_number().over(Window.partitionBy(*key, "burst").orderBy("ts", "event_id")))
    return out.withColumn("action", F.when(F.col("edits") >= block_at, "block").when(F.col("edits") == warn_at, "warn").otherwise("pass"))


def oversized_reads(lines: Column, ranged: Column) -> Column:
    """block a whole read of more than READ_LIMIT lines; the label tells huge ones."""
    return F.when(ranged | (lines <= READ_LIMIT), "pass").when(lines > READ_HUGE, "block-huge").otherwise("block")


def profile(calls: DataFrame) -> DataFrame:
    """Usage per session: calls(session, tool, input, output, cache_read, cache_write)."""
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")]
    out = calls.groupBy("session").agg(F.count("*").alias("calls"), F.count_distinct("tool").alias("tools"), *sums)
    out = out.withColumn("billable", F.col("input") + F.col("output") + F.col("cache_write"))
    return out.withColumn("cache_ratio", F.col("cache_read") / F.greatest(F.lit(1), F.col("input") + F.col("cache_read")))


def repeated_calls(calls: DataFrame, k: int = 10) -> DataFrame:
    """The k most repeated (tool, signature) of each session that occur more than once."""
    n = calls.groupBy("session", "tool", "signature").agg(F.count("*").alias("n")).where("n > 1")
    w = Window.partitionBy("session").orderBy(F.desc("n"), "tool", "signature")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def heaviest_turns(calls: DataFrame, k: int = 10) -> DataFrame:
    """The k calls of each session with most input and output tokens."""
    w = Window.partitionBy("session").orderBy(F.desc(F.col("input") + F.col("output")), "event_id")
    return calls.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def recommendations(p: DataFrame, loops_found: Column, repeats: Column, oversized: Column) -> Column:
    """Advice that applies to a session, as array."""
    rules = [
        (repeats > 0, "avoid repeated calls"),
        (loops_found > 0, "step back from edit loops"),
        (oversized > 0, "read large files in ranges"),
        ((p["cache_ratio"] < 0.3) & (p["input"] > 0), "keep the context stable for caching"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def recent(rows: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The n newest rows by created_at, ties by larger id."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(*columns)


def latest_by_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def retained(rows: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return rows.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))
