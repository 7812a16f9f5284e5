"""Mixing sources to target weights by min-cost flow.

1. Documents with the same set of sources form one membership pattern; only
   patterns, with their words, take part in what follows.
2. A source's target is its weight's share of all words, up to `max_repeats`
   times its own size, the excess going to the others by weight.  The level at
   which the targets add up is found by Newton's method on exact integers, each
   step one aggregate over the sources.
3. Patterns that share sources, directly or not, are one component.  In each, a
   flow from patterns to sources' quotas is found: a pattern can give its words
   once at cost 1, a second time at cost 2 and so on, so the costs are convex
   and the mix repeats as little as its targets allow.
4. Every document of a pattern is taken as often as the flow takes the whole
   pattern; the rest goes to documents in seeded order.  The document at the
   edge is found digit by digit of the seeded key, by sums per digit that
   combine before the exchange, so no pattern is ever sorted or gathered,
   whatever its size.  That document is taken in part, so a source gets its
   quota to the word.

The driver sees sums and numbers of rows, never patterns or documents.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .store import discard, materialize

#: Hexadecimal digits of a document's key that one step looks at; digits of the key; rows that may be sorted at the edge of one pattern.
STEP, KEY_DIGITS, EDGE_ROWS = 3, 42, 50_000
#: Source names sort by code point within "1"; a missing source is one after all others.
MISSING = "2"


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the text; a null text has none."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_name(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), name.cast("string")), F.lit(MISSING))


def ranked(sources: DataFrame) -> DataFrame:
    """sources (a row per `source`) with `rank` from 0 by code point: sorted by range, then numbered within partitions from the counts before."""
    placed = materialize(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "sources")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    return placed.join(bases, "part").withColumn("rank", F.col("base") + within - 1).drop("part", "base")


def targets(sources: DataFrame, total: int, max_repeats: int) -> DataFrame:
    """sources (source, size, weight) with target double and quota, the nearest whole number of words.

    With T words in all, targets are min(cap, level * weight) with the level at
    which they add up to T.  As the sum is concave in the level, Newton's steps
    from the level without caps rise to it and end after finitely many, usually
    two or three.
    """
    cap = F.col("size") * max_repeats
    rest, weight = total, sources.agg(F.sum("weight")).first()[0] or 0
    while weight:
        capped = cap.cast("decimal(38,0)") * F.lit(weight) <= F.lit(rest).cast("decimal(38,0)") * F.col("weight")
        full, free = sources.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        now = total - (full or 0), free or 0
        if now == (rest, weight) or not now[1]:
            rest, weight = now if now[1] else (rest, weight)
            break
        rest, weight = now
    share = (F.lit(float(rest)) * F.col("weight")) / F.lit(float(weight or 1))
    target = F.least(cap.cast("double"), share)
    return sources.withColumn("target", target).withColumn("quota", F.least(cap, F.floor(target + 0.5)))


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], max_repeats: int) -> list[dict[int, int]]:
    """What each pattern gives to each of its sources: as much as quotas and capacities allow, at the least cost.

    Tier e of a pattern, its e-th repetition, costs e a word, and nothing else
    costs anything.  So the cheapest augmenting paths are those that enter by
    the lowest tier with room: tiers are opened one after another, and in each
    the flow is augmented along shortest paths until none is left.
    """
    gives: list[dict[int, int]] = [{} for _ in capacity]
    takers: list[set[int]] = [set() for _ in quota]
    left = list(quota)
    for _ in range(max_repeats):
        room = list(capacity)
        while True:
            # breadth first from the patterns with room; a step back from a source frees what a pattern gives it
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p in range(len(capacity)) if room[p] > 0}
            queue, end = deque(came), None
            while queue and end is None:
                kind, at = here = queue.popleft()
                for there in [("s", s) for s in members[at]] if kind == "p" else [("p", p) for p in sorted(takers[at])]:
                    if there not in came:
                        came[there] = here
                        queue.append(there)
                        if there[0] == "s" and left[there[1]] > 0:
                            end = there
                            break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            back = [gives[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"]
            flow = min(room[path[0][1]], left[end[1]], *back)
            room[path[0][1]] -= flow
            left[end[1]] -= flow
            for a, b in zip(path, path[1:], strict=False):
                p, s, sign = (a[1], b[1], 1) if a[0] == "p" else (b[1], a[1], -1)
                gives[p][s] = gives[p].get(s, 0) + sign * flow
                (takers[s].add if gives[p][s] else takers[s].discard)(p)
    return [{s: v for s, v in g.items() if v} for g in gives]


def routes(patterns: DataFrame, sources: DataFrame, max_repeats: int) -> DataFrame:
    """(pattern, source, words): the flow, found component by component.

    A task holds one component's patterns, a row per distinct set of sources,
    whatever the number of documents.  Without overlaps that is one row.
    """
    links = patterns.select(F.get("pattern", F.lit(0)).alias("a"), F.explode("pattern").alias("b")).where("a <> b")
    component = connected_components(links)
    network = patterns.select("pattern", "words", F.explode("pattern").alias("source")).join(sources.select("source", "quota"), "source").join(component, F.col("source") == F.col("node"), "left")
    network = network.select("pattern", "words", "source", "quota", F.coalesce("component", "source").alias("component"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["source"]))
        number = {s: i for i, s in enumerate(names)}
        quota = dict(zip(rows["source"], rows["quota"].tolist(), strict=True))
        words = {tuple(p): int(w) for p, w in zip(rows["pattern"], rows["words"], strict=True)}
        order = sorted(words)
        found = min_cost_flow([words[p] for p in order], [[number[s] for s in p] for p in order], [quota[s] for s in names], max_repeats)
        out = [(list(p), names[s], v) for p, g in zip(order, found, strict=True) for s, v in sorted(g.items())]
        return pd.DataFrame(out, columns=["pattern", "source", "words"])

    return network.groupBy("component").applyInPandas(solve, "pattern array<string>, source string, words long")


def _edges(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, int]:
    """Where each pattern's extra words end: (pattern, edge, rest), the first digits of the key at the edge and the words still missing there, and the number of digits."""
    edges, digits = plan.where("rest > 0").select("pattern", F.lit("").alias("edge"), "rest"), 0
    while digits < KEY_DIGITS:
        inside = rows.join(edges, "pattern").where(F.substring("key", 1, digits) == F.col("edge"))
        sums = inside.groupBy("pattern", "rest", F.substring("key", 1, digits + STEP).alias("edge")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("edge"))
        at = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
        after = materialize(at.select("pattern", "edge", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"), "n"), "edge")
        if digits:
            discard(edges)
        edges, digits = after, digits + STEP
        if (edges.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS:
            break
    return edges.select("pattern", "edge", "rest"), digits


def mix(df: DataFrame, members: Column, size: Column, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, pattern, taken, carry) of every row of df: how many of its words the mix takes, repeats counted.

    members: the row's sources, an array of `source_name`s; a row with none (or
    null) is never taken and its words are not shared out.  Sources by code point, a missing one last, weigh `weights`
    in turn.  size: words, not negative; a row of size 0 takes 0, and if all
    are 0 every target is.  The order is seeded by id and text; rows equal in
    both follow their place in the scan, so reruns over one table agree.
    carry: columns of df that come along in a struct, under any name.  What a
    source gets is its quota to the word where sources do not overlap, else as
    near as the overlaps allow.
    """
    return _mixed(df, members, size, weights, max_repeats, seed, id_col, text_col, carry)[0]


def mix_with_targets(df: DataFrame, source: Column, size: Column, **options: object) -> DataFrame:
    """`mix` for rows of one source each, with the source's size and target."""
    rows, sources = _mixed(df, F.array(source_name(source)), size, **options)
    wide = rows.join(sources.select(F.array("source").alias("pattern"), F.col("size").alias("source_size"), "target"), "pattern")
    return wide.drop("pattern")


def _mixed(df, members, size, weights=(5, 2, 1), max_repeats=3, seed=11, id_col="doc_id", text_col="text", carry=()) -> tuple[DataFrame, DataFrame]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc_id = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    key = F.concat(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id, F.lit(":"), text), 256), 1, 24), F.lpad(F.hex(F.monotonically_increasing_id()), KEY_DIGITS - 24, "0"))
    extra = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.coalesce(F.sort_array(F.array_distinct(members)), F.array().cast("array<string>")).alias("pattern"), key.alias("key"), extra.alias("carry"))
    rows = materialize(rows, "documents")

    patterns = materialize(rows.groupBy("pattern").agg(F.sum("size").alias("words")), "patterns")
    total = patterns.where(F.size("pattern") > 0).agg(F.sum("words")).first()[0] or 0
    sizes = patterns.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(ranked(sizes).withColumn("weight", weight.cast("long")), "weights")
    sources = materialize(targets(sources, total, max_repeats), "targets")

    flow = routes(patterns.where("words > 0"), sources, max_repeats).groupBy("pattern").agg(F.sum("words").alias("flow"))
    plan = patterns.join(flow, "pattern", "left").withColumn("flow", F.coalesce("flow", F.lit(0)))
    whole = F.expr("if(words > 0, flow div words, 0)")
    plan = materialize(plan.select("pattern", whole.alias("times"), (F.col("flow") - whole * F.col("words")).alias("rest")), "plan")

    edges, digits = _edges(rows, plan)
    placed = rows.join(plan.select("pattern", "times"), "pattern").join(edges, "pattern", "left")
    start = F.substring("key", 1, digits)
    sure = placed.where(F.col("edge").isNull() | (start != F.col("edge")))
    taken = F.col("size") * (F.col("times") + F.when(start < F.col("edge"), 1).otherwise(0))
    at_edge = placed.where(start == F.col("edge"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_edge = at_edge.withColumn("before", before)
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    columns = ["id", "size", "pattern"]
    out = sure.select(*columns, taken.alias("taken"), "carry").unionByName(at_edge.select(*columns, (F.col("size") * F.col("times") + part).alias("taken"), "carry"))
    return (out if carry else out.drop("carry")), sources
