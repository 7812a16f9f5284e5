"""Centroid clustering: exact k-means over integer vectors.

Vectors are packed once into blocks, written as one binary value each.  A round
is one `treeAggregate` over them: a block's squared distances come from the
expansion |x|^2 - 2 x.c + |c|^2 with a float64 matrix product, which is exact
while every partial result is an integer below 2^53.  A block for which the
bound does not hold takes the same expansion in 64-bit integers, or in Python's
integers where those could overflow.  So every distance, sum and floor is exact,
and the result does not depend on how rows lie in blocks, partitions or files.

What travels per round is the centroids to the tasks and, from each task, k sums
of `dims` integers; nothing is grouped by cluster, so a cluster that holds most
rows costs nothing extra.  Lost executors cost a block's recomputation from the
written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize
from .topk import usable

#: Vectors in a block.
BLOCK = 2048
_FLOAT, _LONG = 1 << 53, 1 << 63
#: Bytes of a component that no long holds: floor(scale * x) of any double needs fewer.
_WIDE_BYTES = 160

#: (vectors, sums of components, sum of distances) of every cluster.
Sums = list[tuple[int, list[int], int]]


def quantized(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as Python's integers if one is 2^53 or more in size."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not y.size or np.abs(y).max() < _FLOAT:
        return y.astype(np.int64)
    flat = [int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)]
    return np.array(flat, dtype=object).reshape(x.shape)


def distances(block: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every center (object arrays of integers on the way in; the narrowest exact kind out)."""
    largest = [max((abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (block, centers)]
    bound = block.shape[1] * sum(largest) ** 2
    kind = np.float64 if bound < _FLOAT else np.int64 if bound < _LONG else object
    x, c = block.astype(kind), centers.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def assigned(block: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The nearest center of every row, ties to the smaller number, and the squared distances as Python's integers."""
    d = distances(block, centers)
    labels = np.argmin(d, axis=1)
    return labels, [int(v) for v in d[np.arange(len(d)), labels].tolist()]


def _sums(block: np.ndarray, centers: np.ndarray) -> Sums:
    labels, near = assigned(block, centers)
    if block.dtype != object and len(block) * max(abs(int(block.max())), abs(int(block.min()))) >= _LONG:
        block = block.astype(object)
    out = []
    for j in range(len(centers)):
        mine = np.flatnonzero(labels == j)
        out.append((len(mine), [int(v) for v in block[mine].sum(0)] if len(mine) else [0] * block.shape[1], sum(near[i] for i in mine.tolist())))
    return out


def _added(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return b if a is None else a
    return [(m + n, [p + q for p, q in zip(u, v, strict=True)], i + j) for (m, u, i), (n, v, j) in zip(a, b, strict=True)]


def _blob(block: np.ndarray) -> bytes:
    if block.dtype != object:
        return block.astype("<i8").tobytes()
    return b"".join(v.to_bytes(_WIDE_BYTES, "little", signed=True) for v in block.ravel().tolist())


def _block(blob: bytes, dims: int, wide: bool) -> np.ndarray:
    if not wide:
        return np.frombuffer(blob, "<i8").reshape(-1, dims)
    flat = [int.from_bytes(blob[i : i + _WIDE_BYTES], "little", signed=True) for i in range(0, len(blob), _WIDE_BYTES)]
    return np.array(flat, dtype=object).reshape(-1, dims)


def _as_long(v: int) -> int | None:
    return v if v < _LONG else None


@dataclass
class Clustering:
    """assigned: (id, cluster int, distance long), a row per vector kept.  centers: (cluster, center, n, cluster_inertia, inertia), k rows at most;
    center holds the components as decimal integers joined by commas.  A distance or inertia beyond the longs is null."""

    assigned: DataFrame
    centers: DataFrame


def _seed_order(seed: int, vec_id: Column, v: Column, scale: int) -> list[Column]:
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return [F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256).asc_nulls_last(), whole.asc(), v.asc()]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> Clustering:
    """k-means of the vectors with exactly `dims` finite components, as integers floor(scale * x).

    The first centers are the k vectors with the smallest sha256 of
    `<seed>:<id>`; a null id comes last, and rows with one id are ordered by
    their components.  Fewer vectors than k give fewer centers, an empty table
    an empty result.  Each round moves a center to the exact floor of its
    vectors' mean; one without vectors stays.  Repeated rows and null ids count
    like any others; other columns are ignored.
    """
    spark = df.sparkSession
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    kept = kept.where((F.size("v") == dims) & usable(F.col("v")))
    id_type = kept.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                block = quantized(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims), scale)
                ids = batch.column("id")
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array([block.dtype == object]), pa.array([_blob(block)], pa.binary())], names=["ids", "wide", "data"])

    packed_schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("wide", T.BooleanType()), T.StructField("data", T.BinaryType())])
    packed = materialize(kept.mapInArrow(pack, packed_schema), "vectors")

    first = kept.orderBy(*_seed_order(seed, F.col("id"), F.col("v"), scale)).select("v").limit(k).collect()
    centers = quantized(np.array([[float(x) for x in r[0]] for r in first], np.float64).reshape(-1, dims), scale).astype(object)

    def totals(centers: np.ndarray) -> Sums:
        blocks = packed.select("wide", "data").rdd
        found = blocks.treeAggregate(None, lambda acc, row: _added(acc, _sums(_block(bytes(row[1]), dims, row[0]), centers)), _added)
        return found or [(0, [0] * dims, 0)] * len(centers)

    for _ in range(rounds if len(centers) else 0):
        moved = [[s // n for s in sums] if n else old for (n, sums, _), old in zip(totals(centers), centers.tolist(), strict=True)]
        if moved == centers.tolist():
            break  # every further round would repeat this one
        centers = np.array(moved, dtype=object).reshape(-1, dims)
    last = totals(centers) if len(centers) else []
    inertia = _as_long(sum(i for _, _, i in last))
    center_rows = [(j, ",".join(map(str, c)), n, _as_long(i), inertia) for j, (c, (n, _, i)) in enumerate(zip(centers.tolist(), last, strict=True))]
    center_table = spark.createDataFrame(center_rows, "cluster int, center string, n long, cluster_inertia long, inertia long")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, wide, data in zip(batch.column("ids"), batch.column("wide").to_pylist(), batch.column("data"), strict=True):
                labels, near = assigned(_block(data.as_py(), dims, wide), centers)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(labels.astype(np.int32)), pa.array([_as_long(v) for v in near], pa.int64())], names=["id", "cluster", "distance"])

    out_schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return Clustering(packed.mapInArrow(label, out_schema), center_table)
