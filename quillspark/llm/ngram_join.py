"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

1. Texts become sets of word n-grams.  Texts with equal sets, by a 128-bit
   BLAKE2b digest of the n-grams' words, are one *node* with a weight, so copies
   are never compared, and its text is taken from one row.  The 64-bit values of
   n-grams only route: two n-grams with one value cost a comparison and no more.
2. Band and row counts are chosen for the target recall at the threshold.  Band
   hashes are exchanged; a band hash that several nodes share is a bucket.
3. A node's home is the smallest node it shares a bucket with; the nodes of one
   home are cut into blocks of bounded bytes, whose texts are one compressed
   value.  Two blocks meet if a bucket touches both: so near copies of one text
   meet as pairs of blocks, whatever their number, and blocks that share no
   bucket never meet, however long the chain between them.
4. Each block, and each pair of blocks, is one row that is compared by itself.
   The n-grams themselves are compared, word by word, intersections are counted
   as a matrix product, and out come counts per node and a spanning set of
   links, never pairs.
5. Components of the verified links are the classes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count as counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import binary_array, bounded, release
from .graph import connected_components
from .repeats import WordText
from .store import discard, materialize
from .winnow import gram_values, mix

#: Nodes and bytes of text that one block holds; a longer text is a block of its own.
BLOCK, BLOCK_BYTES = 128, 2 << 20


def choose_bands(threshold: float, recall: float = 0.99999, hashes: int = 240) -> tuple[int, int]:
    """(bands, rows) with the most rows that still reach the recall at the threshold with so many hashes."""
    best = hashes, 1
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = bands, rows
    return best


def shingles(text: WordText, n: int) -> np.ndarray:
    """64-bit values of the word n-grams of a text, in its order; a text of fewer words is one n-gram, an empty one has none."""
    words = text.values(0, text.n)
    return gram_values(words, min(n, len(words))) if len(words) else words


class WordNumbers(dict):
    """Numbers of words, and their 128-bit BLAKE2b digests; bounded, as it starts anew at `limit` bytes of words."""

    def __init__(self, limit: int = 16 << 20):
        self.limit, self.bytes, self.raw = limit, 0, []
        self._table = np.zeros((0, 2), np.int64)

    def __missing__(self, word: bytes) -> int:
        self.raw.append(hashlib.blake2b(word, digest_size=16).digest())
        self.bytes += len(word) + 150
        self[word] = number = len(self.raw) - 1
        return number

    def trim(self) -> None:
        if self.bytes > self.limit:
            self.__init__(self.limit)
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row of two longs per word."""
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self._table) < len(self.raw):
            more = np.frombuffer(b"".join(self.raw[len(self._table) :]), "<i8").reshape(-1, 2)
            self._table = np.concatenate((self._table, more))
        return self._table[rows]


def _in_order(values: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Starts of the distinct n-grams in an order that depends on the set alone: by value, and by the words' digests where different n-grams have one value."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    if not same.any():
        return order
    at = np.flatnonzero(same)
    equal = np.ones(len(at), bool)
    for k in range(n):
        equal &= (words[order[at] + k] == words[order[at + 1] + k]).all(1)
    if equal.all():
        return order[np.concatenate(([True], ~same))]
    columns = [words[k : k + len(values), c] for k in reversed(range(n)) for c in (1, 0)]
    order = np.lexsort((*columns, values))
    new = np.concatenate(([True], values[order[1:]] != values[order[:-1]]))
    for column in columns:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    return order[new]


#: N-grams whose digests are gathered at once.
_GATHER = 1 << 16


def set_digest(values: np.ndarray, words: np.ndarray, n: int) -> bytes:
    """128-bit digest of a set of word n-grams by their words: equal for equal sets, whatever the 64-bit values of the n-grams."""
    out = hashlib.blake2b(n.to_bytes(8, "little"), digest_size=16)
    order = _in_order(values, words, n) if len(values) else values.astype(np.int64)
    for a in range(0, len(order), _GATHER):
        part = order[a : a + _GATHER]
        out.update(np.ascontiguousarray(words[part[:, None] + np.arange(n)[None, :]]).tobytes())
    return out.digest()


class MinHash:
    """Band hashes of many sets at once."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.fold = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set, all non-empty; a column is a band, and equal hashes mean equal bands."""
        h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        out = np.empty((len(sets), self.bands), np.uint64)
        for band in range(self.bands):
            total = np.full(len(sets), mix(np.uint64([band + 1]))[0], np.uint64)
            for row in range(self.rows):
                k = band * self.rows + row
                low = np.minimum.reduceat(h * self.a[k] + self.b[k], starts)
                total = mix(total ^ (low.astype(np.uint64) * self.fold[row]))
            out[:, band] = total
        return out


def _profile(rows: DataFrame, n: int, minhash: MinHash) -> DataFrame:
    """rows (rid, id, th, text, more) with the text compressed (null stays null), its bytes, the set's size, its digest and its bands."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    extra = [c for c in rows.columns if c not in ("rid", "id", "th", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        numbers = WordNumbers()
        for batch in bounded(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets, names = [], []
            for t in texts:
                text = WordText(t or b"")
                values = shingles(text, n)
                names.append(set_digest(values, numbers.of(text.data.split()), min(n, text.n)))
                sets.append(np.unique(values))
                numbers.trim()
            some = [s for s in sets if len(s)]
            bands = iter(minhash.band_hashes(some).view(np.int64) if some else [])
            lists = [next(bands) if len(s) else None for s in sets]
            digest = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("rid", "id", "th", *extra)],
                    pa.array([None if t is None else press.compress(t) for t in texts], pa.binary()),
                    pa.array([len(t or b"") for t in texts], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                names=["rid", "id", "th", *extra, "z", "bytes", "size", "s1", "s2", "bands"],
            )

    fields = ", ".join(f"{c} {kinds[c]}" for c in ("rid", "id", "th", *extra))
    return rows.mapInArrow(run, f"{fields}, z binary, bytes long, size long, s1 long, s2 long, bands array<long>")


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None = None, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b (of a), as a matrix product over shared members."""
    both = a if b is None else a + b
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, col, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = counts[col] > 1
    owner, col = owner[shared], col[shared]
    number = np.cumsum(counts > 1) - 1
    col = number[col]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    n = len(a)
    out = np.zeros((n, n if b is None else len(b)), np.float64)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        lo, hi = np.searchsorted(col, [start, start + columns])
        m = np.zeros((len(both), columns), np.float32)
        m[owner[lo:hi], col[lo:hi] - start] = 1
        out += m @ m.T if b is None else m[:n] @ m[n:].T
    return out.astype(np.int64)


def _spanning(u: np.ndarray, v: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what (u, v) connect, at most one per node."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def numbered_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text the sorted numbers of its distinct n-grams; equal n-grams, word by word, have one number."""
    numbers: defaultdict[bytes, int] = defaultdict(counter(1).__next__)
    words = [np.fromiter(map(numbers.__getitem__, t.split()), np.int64) for t in texts]
    size = np.array([len(w) for w in words])
    grams = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    flat = np.concatenate([*words, np.zeros(n, np.int64)])
    owner = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(np.cumsum(size) - size, grams)
    end = np.cumsum(size)[owner]
    base = len(numbers) + 1
    code, top = np.zeros(len(owner), np.int64), 1
    for k in range(n):
        if top * base >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            top = int(code.max()) + 1 if len(code) else 1
        code = code * base + np.where(at + k < end, flat[np.minimum(at + k, len(flat) - 1)], 0)
        top *= base
    ends = np.cumsum(grams).tolist()
    return [np.unique(code[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _compared(blocks: list[tuple[list[int], list[int], list[int], bytes]], threshold: Fraction, n: int) -> list[tuple]:
    """(node, other, weight) of one block, or of the pairs between two: weights of a node's links here, other null; and links, weight null."""
    num, den = threshold.numerator, threshold.numerator + threshold.denominator
    unpress = zstandard.ZstdDecompressor()
    texts = []
    for _, _, sizes, data in blocks:
        ends, whole = np.cumsum(sizes).tolist(), unpress.decompress(data)
        texts += [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    sets = numbered_sets(texts, n)
    size, node = np.array([len(s) for s in sets]), [x for block in blocks for x in block[0]]
    weight = np.array([x for block in blocks for x in block[1]])
    alone = len(blocks) == 1
    cut = len(blocks[0][0])
    base = 0 if alone else cut
    linked = den * intersections(sets[:cut], None if alone else sets[cut:]) >= num * (size[:cut, None] + size[None, base:])
    if alone:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[:cut] += linked @ weight[base:]
    if not alone:
        links[cut:] += weight[:cut] @ linked
    u, v = np.nonzero(np.triu(linked) if alone else linked)
    out = [(node[k], None, int(links[k])) for k in np.flatnonzero(links)]
    return out + [(node[x], node[y], None) for x, y in _spanning(u, v + base, len(sets))]


#: What a block is: its nodes with their weights, and their texts, sizes and one compressed value.
_BLOCK = ("nodes", "weights", "sizes", "data")


def _packed(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(block, nodes, weights, sizes, data): the texts of each block in one value, in which near copies take little room; a written table."""
    # the plan is the same at every size: texts meet members in a merge join, never by broadcast
    chosen = texts.join(placed.hint("merge"), "node").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("node", "weight", "z"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for block, m in zip(batch.column("block").to_pylist(), batch.column("m"), strict=True):
                rows = m.as_py()
                raw = [unpress.decompress(r["z"]) for r in rows]
                lists = [[r["node"] for r in rows], [r["weight"] for r in rows], [len(x) for x in raw]]
                columns = [pa.array([block], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in lists], binary_array([press.compress(b"".join(raw))])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", *_BLOCK])
        release()

    return materialize(chosen.mapInArrow(run, "block long, nodes array<long>, weights array<long>, sizes array<long>, data binary"), "packed")


def _verified(packed: DataFrame, pairs: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, other, weight) as _compared gives it, of all blocks by themselves and of the pairs of blocks (i, j)."""
    exact = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = [c[at].as_py() for c in batch.columns]
                out = _compared([tuple(row[k : k + 4]) for k in range(0, len(row), 4)], exact, n)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["node", "other", "weight"])
        release()

    side = lambda k: packed.select(F.col("block").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in _BLOCK]).hint("merge")
    across = pairs.join(side("i"), "i").join(side("j"), "j").select(*[f"{k}_{c}" for k in "ij" for c in _BLOCK])
    found = "node long, other long, weight long"
    return packed.where("size(nodes) > 1").select(*_BLOCK).mapInArrow(run, found).unionByName(across.mapInArrow(run, found))


def _placed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, weight, block) of every node that shares a bucket, and (i, j) of the blocks that do; written tables."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    stars = materialize(bands.groupBy("band").agg(F.count("*").alias("k"), F.min("node").alias("hub")).where("k > 1").select("band", "hub"), "stars")
    ties = materialize(bands.join(stars, "band").select("band", "node", "hub"), "ties")
    homes = materialize(ties.groupBy("node").agg(F.min("hub").alias("home")).join(nodes.select("node", "weight", "bytes"), "node"), "homes")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("long")
    sizes = materialize(homes.groupBy("home").agg(parts.alias("parts")), "sizes")
    # two blocks of one number would only be compared together
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = materialize(homes.join(sizes, "home").select("node", "weight", block.alias("block")), "placed")
    touched = ties.join(placed, "node").select("band", "block").distinct()
    touched = touched.groupBy("band").agg(F.array_sort(F.collect_list("block")).alias("blocks")).where("size(blocks) > 1").select("blocks").distinct()
    pairs = touched.select(F.posexplode("blocks").alias("at", "i"), "blocks").select("i", F.explode(F.slice("blocks", F.col("at") + 2, F.size("blocks"))).alias("j"))
    pairs = materialize(pairs.distinct(), "pairs")
    for table in (stars, ties, homes, sizes):
        discard(table)
    return placed, pairs


def _classes(profile: DataFrame, threshold: float, n: int) -> DataFrame:
    """(s1, s2, size, class_id, copies_id, n_links, keep) of every set; keep is the rid of the class's first row; a written table."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "rid"))
    same = profile.where("size > 0").groupBy("s1", "s2", "size").agg(F.count("*").alias("weight"), first.alias("least"), F.min(F.struct("rid", "bytes")).alias("rep"), F.any_value("bands").alias("bands"))
    nodes = materialize(same.select("*", F.col("rep.rid").alias("node"), F.col("rep.bytes").alias("bytes")).drop("rep"), "nodes")
    placed, pairs = _placed(nodes)
    packed = _packed(profile.select(F.col("rid").alias("node"), "z"), placed)
    verified = materialize(_verified(packed, pairs, threshold, n), "verified")

    links = verified.where("other is null").groupBy("node").agg(F.sum("weight").alias("links"))
    classes = connected_components(verified.where("other is not null").select("node", "other"))
    named = nodes.select("node", "s1", "s2", "size", "weight", "least").join(classes, "node", "left").join(links, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")), "named")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("first")), "least")
    found = named.join(least, "component").select("s1", "s2", "size", F.col("first.id").alias("class_id"), F.col("least.id").alias("copies_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("first.rid").alias("keep"))
    found = materialize(found, "found")
    for table in (nodes, placed, pairs, packed, verified, named, least):
        discard(table)
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    text = F.col(f"`{text_col}`")
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"), *more)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, class_id, copies_id, n_links) per row; th is the text's hash.

    n_links is the number of other rows with similarity of at least threshold,
    class_id the smallest id of the row's connected component of such links,
    copies_id the smallest id of the rows with the same n-gram set.  Texts of
    fewer than n words are one n-gram; null and empty texts have none, no links
    and a class of their own.  Repeated rows are copies; a null id is ignored
    in minima.  Other columns are ignored; an empty table gives an empty result.
    """
    profile = materialize(_profile(_rows(docs, id_col, text_col, []), n, MinHash(*choose_bands(threshold, recall))), "profile")
    found = _classes(profile, threshold, n)
    some = profile.where("size > 0").select("id", "th", "s1", "s2", "size").join(found, ["s1", "s2", "size"]).select("id", "th", "class_id", "copies_id", "n_links")
    none = profile.where("size = 0").select("id", "th", F.col("id").alias("class_id"), F.col("id").alias("copies_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none).withColumnRenamed("id", id_col)


def keep_one_per_class(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which exactly one per class stays: the one with the smallest id (no id comes last), of several the one with the smallest text hash.

    Rows without words (null, empty or blank texts) are all kept.  Of repeated
    rows one stays.  Further columns, of any name, stay with their row; an
    empty table gives an empty result.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    profile = materialize(_profile(_rows(docs, id_col, text_col, carry), n, MinHash(*choose_bands(threshold))), "profile")
    keep = _classes(profile, threshold, n).select(F.col("keep").alias("rid")).distinct()
    extra = ["carry"] if carry else []
    rows = profile.select("rid", "id", "z", "size", *extra)
    kept = rows.where("size > 0").join(keep.hint("merge"), "rid").select("id", "z", *extra).unionByName(rows.where("size = 0").select("id", "z", *extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in bounded(batches, "z", 1 << 20):
            texts = binary_array([None if z is None else unpress.decompress(z) for z in batch.column("z").to_pylist()]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, *[batch.column(c) for c in extra]], names=["id", "text", *extra])

    fields = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", *extra))
    out = kept.mapInArrow(run, fields.replace(", carry", ", text string, carry") if carry else f"{fields}, text string")
    place = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("carry").getField(c) for c in carry}
    return out.select(*[place[c].alias(c) for c in docs.columns])
