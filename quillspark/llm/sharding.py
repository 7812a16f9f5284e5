"""Sharding [native]: a two-pass external shuffle into equal shards.

Pass one scatters whole records into memory-sized buckets by a seeded hash.
Pass two shuffles each bucket by Fisher-Yates (Spark's `shuffle` function),
numbers the records and writes them (`write_shards`): the buckets one after
another are one random permutation of the table; equal slices of it are the
shards.

Only one exchange moves records, into as many partitions as there are buckets,
up to `MAX_PARTITIONS`, so what a task holds is one bucket whatever the table's
size.  Bucket counts are a table of one row per bucket; prefix sums run inside
each partition's buckets and over one row per partition.

Recovery: a record's place in the scan enters its hash, so that repeated rows
scatter too; buckets are sorted before the shuffle, and partitions by bucket.
A task that runs again makes the same permutation.  It is a function of the
rows, the seed and the input's splits; on a cluster that splits the input
otherwise the law holds alike with another permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: What a record weighs besides its text.
RECORD_OVERHEAD = 16
MAX_PARTITIONS = 100_000


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus the overhead."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(RECORD_OVERHEAD)).cast("long")


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """df's records with shard (0 to n_shards - 1) and slot (gapless from 0 in the shard).

    Law `rows`: the shards' counts are at most one apart.  A null id or text is
    an ordinary value; repeated rows each keep a slot of their own, in buckets
    of their own; an empty table gives an empty result.  Columns of df may have
    any names: records travel in one struct, and a column named shard or slot
    is replaced.  Columns must be orderable (no maps).  df is read twice, so it
    should be a scan or a written table.
    """
    total = df.agg(F.sum(record_bytes(text_col))).first()[0] or 0
    n_buckets = max(-(-total // bucket_bytes), n_shards)
    n_parts = min(n_buckets, MAX_PARTITIONS)

    kept = [c for c in df.columns if c not in ("shard", "slot")]
    part = F.pmod(F.col("bucket"), F.lit(n_parts)).alias("part")

    def hashed(salt: int) -> Column:
        return F.xxhash64(F.lit(seed + salt), "key.id", "key.text", "key.at")

    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("at")).alias("key")
    bucket = F.pmod(hashed(0), F.lit(n_buckets)).alias("bucket")
    records = df.select(key, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rec"))
    scattered = records.select(bucket, F.struct(hashed(1).alias("h"), "rec").alias("item")).select(part, "bucket", "item")
    buckets = scattered.repartition(n_parts, "part").groupBy("part", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))

    counts = df.select(key).select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).select(part, "bucket", "n")
    counts = materialize(counts, "counts")
    earlier = Window.unboundedPreceding, -1
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    offsets = counts.join(parts, "part").select("part", "bucket", "total", (F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(*earlier)), F.lit(0))).alias("first"))

    at = F.col("first") + F.col("pos")
    permuted = (
        buckets.join(offsets, ["part", "bucket"])
        .sortWithinPartitions("part", "bucket")
        .select("first", "total", F.shuffle("items", F.lit(seed)).alias("items"))
        .select("first", "total", F.posexplode("items").alias("pos", "item"))
        .select(F.col("item.rec").alias("rec"), "total", at.alias("at"))
    )
    shard = F.expr(f"(at * {n_shards}L) div total")
    first = F.expr(f"(shard * total + {n_shards - 1}L) div {n_shards}L")
    out = permuted.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    return out.select("rec.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a bucket lies in one or two of them, as files in slot order, without a further exchange."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
