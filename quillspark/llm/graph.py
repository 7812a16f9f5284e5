"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star passes over the edge table (Kiveris et
al., 2014).  Minima are taken by groupBy, which combines before the exchange,
written, and brought back by an equi-join of two tables, whose skewed
partitions Spark can split; so a hub with a third of all edges is never
gathered in one task.  Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def _min_of_neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest node of its neighbourhood; a written table."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(_min_of_neighbours(both).select("a", F.least("a", "m").alias("m")), "low")
    out = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
    discard(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these; a written table."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = materialize(_min_of_neighbours(down), "low")
    tied = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(tied.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    discard(low)
    return out


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge other than a self-loop.

    edges: two columns of one orderable type; nulls are no edges.  component is
    the smallest node of the component.  Repeated and reversed edges are one.
    Passes go on until nothing changes, of the order of the squared logarithm
    of the number of nodes.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, last = _state(now), None
    while seen[0] and seen != last:
        wide = _large_star(now)
        after = _small_star(wide)
        discard(wide)
        discard(now)
        now, last = after, seen
        seen = _state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
