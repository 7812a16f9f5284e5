"""Exact top-k search by inner product: columnar branch-and-bound.

Candidates lie in blocks in vertical layout, one array per block of
dimensions.  For a query, partial scores grow dimension block by dimension
block.  What the remaining dimensions can add is bounded by the product of the
remaining masses (norms) of query and candidate, from above and below; once a
candidate's upper bound is under the k-th largest lower bound it is dropped and
the survivors are compacted.  Scores are exact integers.

The query set grows with the table, so it is not broadcast: query blocks are
sent to every candidate block through one exchange, and each task streams the
query blocks past one candidate block at a time.  Blocks are sized by bytes, so
queries are copied once per `block_bytes` of candidates.  What leaves a block is
k + 1 rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

_LONG = 1 << 63
#: Blocks at least, so that a small table is searched by several tasks.
MIN_BLOCKS = 8


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long; what lies beyond the longs becomes the nearest one."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(rows: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers padded with zeros to one width."""
    offsets = rows.offsets.to_numpy()
    values = rows.values.to_numpy()[offsets[0] : offsets[-1]]
    lens = np.diff(offsets)
    if len(lens) and (lens == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width)[None, :] < lens[:, None]] = values
    return out


def _ids(column: pa.Array) -> np.ma.MaskedArray:
    """Ids as an array that masks the missing ones."""
    return np.ma.MaskedArray(column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False))


class CandidateBlock:
    """Candidates in vertical layout with the mass each has left after every dimension block, in order of their ids (masked ones, which are missing, last).

    With `wide`, sums may not fit into 64 bits: then the last survivors are scored with Python's integers.
    """

    def __init__(self, ids: np.ma.MaskedArray, vectors: np.ndarray, dims: int = 16, wide: bool = False):
        order = np.lexsort((ids.data, np.ma.getmaskarray(ids)))
        self.ids, v = ids[order], vectors[order]
        self.cuts = [(a, min(a + dims, v.shape[1])) for a in range(0, v.shape[1], dims)]
        self.columns = [np.ascontiguousarray(v[:, a:b]).astype(np.float64) for a, b in self.cuts]
        squares = np.array([(c * c).sum(1) for c in self.columns]) if self.cuts else np.zeros((0, len(ids)))
        self.left = np.sqrt(np.concatenate((np.cumsum(squares[::-1], 0)[::-1], np.zeros((1, len(ids))))))
        self.whole, self.wide = v, wide

    def _scored(self, at: np.ndarray, query: np.ndarray, k: int) -> tuple[list[int | None], list[int]]:
        # places are in order of ids, so the earlier place wins a tie
        if not self.wide:
            scores = self.whole[at] @ query
            order = np.lexsort((at, -scores))[:k]
            return self.ids[at[order]].tolist(), scores[order].tolist()
        q = query.tolist()
        scores = [sum(x * y for x, y in zip(row, q, strict=True)) for row in self.whole[at].tolist()]
        order = sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k]
        return self.ids[at[order]].tolist(), [scores[i] for i in order]

    def top(self, query: np.ndarray, k: int) -> tuple[list[int | None], list[int]]:
        """Ids and exact scores of the k best, ties to smaller ids, missing ones (None) last."""
        parts = [query[a:b].astype(np.float64) for a, b in self.cuts]
        squares = np.array([(p * p).sum() for p in parts])
        query_left = np.sqrt(np.concatenate((np.cumsum(squares[::-1])[::-1], [0.0])))
        alive, partial = np.arange(len(self.ids)), np.zeros(len(self.ids))
        # the terms' sizes add up to the product of the masses at most, so sums in doubles are off by far less than this
        rounding = 1e-9 * query_left[0] * self.left[0] + 1e-6
        for d, (column, part) in enumerate(zip(self.columns, parts, strict=True)):
            full = len(alive) == len(self.ids)
            partial = partial + (column if full else column[alive]) @ part
            if len(alive) > k:
                slack = query_left[d + 1] * (self.left[d + 1] if full else self.left[d + 1][alive]) + (rounding if full else rounding[alive])
                low = partial - slack
                keep = partial + slack >= np.partition(low, len(low) - k)[len(low) - k]
                alive, partial = alive[keep], partial[keep]
        return self._scored(alive, query, k)


def _exact_square(v: np.ndarray) -> int:
    return sum(x * x for x in v.tolist())


def search(queries: DataFrame, candidates: DataFrame, k: int, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates other than the query's own row.

    Both have (vec_id, v), v arrays of longs; shorter vectors count as padded
    with zeros.  A query row's own row is one candidate of its id and vector;
    further rows of that id stay candidates, and repeated query rows each get
    an answer.  Rows without an id take part like any others, after all ids in a
    tie; such a query's answers have a null query_id.  Scores are compared as exact integers
    of any size; one beyond the longs is returned as the nearest long.  Other
    columns are ignored.  Empty tables give an empty result.
    """
    queries, candidates = queries.select("vec_id", "v"), candidates.select("vec_id", "v")

    def extent(df: DataFrame) -> tuple[int, int, int]:
        rows, width, high, low = df.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
        return rows, width or 0, max(high or 0, -(low or 0))

    (_, w1, top1), (n, w2, top2) = extent(queries), extent(candidates)
    width = max(w1, w2)
    wide = width * max(top1, top2) ** 2 >= _LONG
    n_blocks = max(-(-n * 8 * width // block_bytes), MIN_BLOCKS)
    asked = materialize(queries.withColumn("q", F.monotonically_increasing_id()), "queries")

    # the row's number in the hash parts repeated rows
    dealt_to = F.pmod(F.xxhash64(F.col("vec_id"), F.monotonically_increasing_id()), F.lit(n_blocks))
    stream = candidates.select(dealt_to.alias("block"), F.lit(-1).cast("long").alias("q"), "vec_id", "v")
    to_all = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "q", "vec_id", "v")
    dealt = stream.unionByName(to_all).repartition("block").sortWithinPartitions("block", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, block = None, [], [], None
        for batch in batches:
            blocks, qs = batch.column("block").to_numpy(), batch.column("q").to_numpy()
            edge = np.flatnonzero(np.diff(blocks) | np.diff(qs < 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(qs)], strict=True):
                part = batch.slice(a, b - a)
                part_ids, part_v = _ids(part.column("vec_id")), _matrix(part.column("v"), width)
                if blocks[a] != at:
                    at, ids, vectors, block = blocks[a], [], [], None
                if qs[a] < 0:
                    ids.append(part_ids)
                    vectors.append(part_v)
                    continue
                if block is None:
                    if not ids:
                        continue
                    block = CandidateBlock(np.ma.concatenate(ids), np.concatenate(vectors), wide=wide)
                    ids, vectors = [], []
                out: list[list] = [[], [], [], [], [], []]
                for q, query_id, v in zip(qs[a:b].tolist(), part_ids.tolist(), part_v, strict=True):
                    found, scores = block.top(v, k + 1)
                    square = _exact_square(v)
                    for key, score in zip(found, scores, strict=True):
                        order = (score + (1 << 191)).to_bytes(24, "big") if wide else None
                        for col, x in zip(out, (q, query_id, key, min(max(score, -_LONG), _LONG - 1), order, key == query_id and score == square), strict=True):
                            col.append(x)
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["q", "query_id", "vec_id", "score", "order", "own"])

    found = dealt.mapInArrow(run, "q long, query_id long, vec_id long, score long, order binary, own boolean")
    order = Window.partitionBy("q").orderBy(F.desc("order"), F.desc("score"), F.asc_nulls_last("vec_id"))
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # of the rows that look like the query's own, one is
    own = best.withColumn("own_at", F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("q")))
    rank = F.col("place") - F.when(F.col("own_at") < F.col("place"), 1).otherwise(0)
    return own.where("own_at is null or place <> own_at").select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
