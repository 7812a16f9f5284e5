"""All repeats of a fixed length in a corpus: what substring and suffix-array dedup share.

The suffixes that matter are sampled: those that start at winnowed anchors (see
winnow), each with the left context that its windows need.  A suffix's first
`gram` units are its prefix, by which suffixes are split into groups.

1. One pass over the texts writes, per row, its compressed text and its
   anchors: window starts, prefix hash, digest of the context.
2. Anchors whose prefix occurs once are dropped; their windows can't repeat.
3. Equal contexts (same bytes by a 128-bit BLAKE2b digest) become one *class*
   with a weight, a leaf of so many suffixes, and copies cost nothing further.
   A class alone under its prefix repeats whole if its weight is two or more.
4. The other classes are fetched once each and go, prefix by prefix, to
   `decide`, the operator's own method over memory-sized groups, which compares
   their units.  A prefix whose classes hold more than `group_units` units, what
   a task's memory allows, grows: with `width` places of windows left, suffixes
   start `low` units before the anchor and are split by their first
   `length - width + 1` units.  A prefix as long as the window is the window:
   such suffixes are grouped by their very bytes, and those of a group repeat.
5. The windows found go back to every member of their class and from there, as
   spans, to the rows.

Counts combine before each exchange, and members and texts are joined by plain
equi-joins whose hot keys Spark can split, so no key is gathered in one task.
Rows are named by a number that is written with them, so a class's text is
fetched from one row however often the row is repeated.  The written tables
survive lost executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import winnow
from .batches import binary_array, bounded, release
from .store import discard, materialize

_BITS = 12
_MASK = (1 << _BITS) - 1


class ByteText:
    """A text as bytes."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)

    def values(self, a: int, b: int) -> np.ndarray:
        return winnow.byte_values(np.frombuffer(self.data, np.uint8, b - a, a))

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        return [self.data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


#: Words longer than this, and such as begin with a zero byte, stand as their digest where words are compared.
LONG_WORD = 64


class WordText:
    """A text as words, maximal runs of anything but the six ASCII blanks, joined by one space each."""

    def __init__(self, data: bytes):
        x = np.frombuffer(data, np.uint8)
        blank = (x == 0x20) | ((x >= 0x09) & (x <= 0x0D))
        after = np.concatenate(([True], blank[:-1])) if len(x) else blank
        self.data = np.where(blank, np.uint8(0x20), x)[~(blank & after)].tobytes().rstrip(b" ")
        gap = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0x20)
        some = bool(self.data)
        self.start = np.concatenate(([0], gap + 1)) if some else gap
        self.end = np.concatenate((gap, [len(self.data)])) if some else gap
        self.n = len(self.start)
        zero = np.frombuffer(self.data, np.uint8)[self.start] == 0 if some else np.zeros(0, bool)
        self.odd = np.flatnonzero((self.end - self.start > LONG_WORD) | zero)

    def values(self, a: int, b: int) -> np.ndarray:
        base = int(self.start[a]) if b > a else 0
        return winnow.word_values(self.data[base : self.end[b - 1]] if b > a else b"", self.start[a:b] - base, self.end[a:b] - base)

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The words [a, b), a < b, of each span, long ones as digests, so that what is sent is bounded."""
        out = [self.data[x:y] for x, y in zip(self.start[a].tolist(), self.end[b - 1].tolist(), strict=True)]
        lo, hi = np.searchsorted(self.odd, a), np.searchsorted(self.odd, b)
        for k in np.flatnonzero(lo < hi).tolist():
            odd = set(self.odd[lo[k] : hi[k]].tolist())
            out[k] = b" ".join([self._digest(i) if i in odd else self.data[self.start[i] : self.end[i]] for i in range(a[k], b[k])])
        return out

    def _digest(self, i: int) -> bytes:
        return b"\x00" + hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=16).hexdigest().encode()


@dataclass
class Group:
    """The classes under one prefix: for each its text, its windows, the anchor's place and its weight."""

    bodies: list[bytes]
    windows: list[int]
    offsets: list[int]
    weights: list[int]


#: For groups, per class the boolean mask of its windows that repeat.
Decide = Callable[[list[Group]], list[list[np.ndarray]]]


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _carried(carry: Sequence[str]) -> list:
    return [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []


def _lists(parts: list[list[np.ndarray]], ends: pa.Array) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64))) for x in parts]


def profile(docs: DataFrame, id_col: str, text_col: str, kind: type, length: int, gram: int, carry: Sequence[str] = ()) -> DataFrame:
    """Step 1: (rid, id, z, place, gram, c1, c2) per row, and carry, a struct of further columns, if there are any.

    place packs a context's first window start, its number of windows and the
    anchor's place in it; c1 and c2 are the context's digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("text"), *_carried(carry))
    id_type = src.schema["id"].dataType.simpleString()
    more = f", carry {src.schema['carry'].dataType.simpleString()}" if carry else ""
    extra = ["carry"] if carry else []
    if not 0 < gram <= length < 1 << _BITS:
        raise ValueError(f"length must be under {1 << _BITS}, and gram at most length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, none = _compressor()[0], np.zeros(0, np.int64)
        for batch in bounded(batches, "text"):
            z, counts = [], []
            cols: list[list[np.ndarray]] = [[none], [none], [none], [none]]
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                text, n = kind(raw), 0
                z.append(press.compress(text.data))
                for first, count, offset, g in winnow.anchors(text.n, text.values, length, gram):
                    digest = winnow.digests(text.cut(first, first + count - 1 + length), (count << _BITS | offset).tolist())
                    for col, x in zip(cols, ((first << 2 * _BITS) | (count << _BITS) | offset, g.view(np.int64), digest[:, 0], digest[:, 1]), strict=True):
                        col.append(x)
                    n += len(first)
                counts.append(n)
            ends = pa.array(np.cumsum([0, *counts]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), binary_array(z), *_lists(cols, ends), *[batch.column(c) for c in extra]], names=["rid", "id", "z", "place", "gram", "c1", "c2", *extra])

    return src.mapInArrow(run, f"rid long, id {id_type}, z binary, place array<long>, gram array<long>, c1 array<long>, c2 array<long>{more}")


#: What names a class, and what is known of it.
_CLASS = ["gram", "c1", "c2", "n", "place", "hot"]


def _fetch(profiles: DataFrame, classes: DataFrame, kind: type, length: int) -> DataFrame:
    """Step 4: the classes with their text, _CLASS and body."""
    want = classes.groupBy("rid").agg(F.collect_list(F.struct(*_CLASS)).alias("want"))
    joined = profiles.select("rid", "z").join(want, "rid").select("z", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = _compressor()[1]
        for batch in bounded(batches, "z", 1 << 20):
            rows: list[tuple] = []
            for z, want in zip(batch.column("z").to_pylist(), batch.column("want").to_pylist(), strict=True):
                place = np.array([w["place"] for w in want])
                first = place >> 2 * _BITS
                bodies = kind(unpress.decompress(z)).cut(first, first + (place >> _BITS & _MASK) - 1 + length)
                rows += [(*w.values(), body) for w, body in zip(want, bodies, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.binary())], names=[*_CLASS, "body"])

    return joined.mapInArrow(run, "gram long, c1 long, c2 long, n long, place long, hot boolean, body binary")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


FOUND = "gram long, c1 long, c2 long, lo array<long>, hi array<long>"


def _decided(bodies: DataFrame, decide: Decide, batch_windows: int = 100_000) -> DataFrame:
    """Step 4 for prefixes with few classes: FOUND, the repeated windows of a class as runs [lo, hi)."""
    dealt = bodies.where("not hot").select("gram", "c1", "c2", "n", "place", "body").repartition("gram").sortWithinPartitions("gram", "c1", "c2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[Group] = []
        names: list[tuple[int, int, int]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            masks = [m for ms in decide(groups) for m in ms]
            runs = [_runs(m) for m in masks]
            ends = pa.array(np.cumsum([0, *[len(a) for a, _ in runs]]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in names], pa.int64()) for k in range(3)] + _lists([[r[k] for r in runs] for k in (0, 1)], ends), names=["gram", "c1", "c2", "lo", "hi"])

        for batch in batches:
            for gram, c1, c2, n, place, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if gram != last:
                    if size >= batch_windows:
                        yield flush()
                        groups, names, size = [], [], 0
                    groups.append(Group([], [], [], []))
                last = gram
                group, windows = groups[-1], place >> _BITS & _MASK
                group.bodies.append(body)
                group.windows.append(windows)
                group.offsets.append(place & _MASK)
                group.weights.append(n)
                names.append((gram, c1, c2))
                size += windows + len(body) // 16
        if names:
            yield flush()
        release()

    return dealt.mapInArrow(run, FOUND)


def _split(crowded: DataFrame, kind: type, length: int, width: int) -> DataFrame:
    """Crowded classes as bundles of `width` places of windows under longer prefixes.

    A window is placed by how far its anchor lies behind its start.  Windows at
    the places [low, low + width) all hold the first length - width + 1 units
    of the suffix that starts `low` before the anchor: the new prefix, whose
    hash is the new gram.  The bundle's own text is the new context.
    """
    kept = crowded.select("gram", "c1", "c2", "n", "place", "body")
    names = ["gram", "c1", "c2", "n", "gram2", "d1", "d2", "j0", "place", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body", 1 << 18):
            rows: list[tuple] = []
            for gram, c1, c2, n, place, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                count, offset, text = place >> _BITS & _MASK, place & _MASK, kind(body)
                ph = winnow.PrefixHash(text.values(0, text.n))
                # window j has its anchor offset - j behind its start
                low = np.arange((offset - count + 1) // width, offset // width + 1) * width
                j0, j1 = np.maximum(offset - low - width + 1, 0), np.minimum(offset - low + 1, count)
                core = ph.of(offset - low, np.minimum(offset - low - width + 1, ph.n - length) + length)
                key = winnow.mix(core ^ winnow.mix(np.uint64(gram & (2**64 - 1)) ^ low.astype(np.uint64)))
                places = (j1 - j0) << _BITS | (offset - j0 - low)
                texts = text.cut(j0, j1 - 1 + length)
                own = winnow.digests(texts, (places << _BITS | low).tolist())
                k = len(low)
                rows += zip([gram] * k, [c1] * k, [c2] * k, [n] * k, key.view(np.int64).tolist(), own[:, 0].tolist(), own[:, 1].tolist(), j0.tolist(), places.tolist(), texts, strict=True)
            cols = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:9]], pa.array(cols[9], pa.binary())], names=names)

    return kept.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", body binary")


#: Parts that the classes under one prefix are counted in.
_PARTS = 1024


def _crowded(classes: DataFrame, length: int, group_units: int) -> DataFrame:
    """classes with k, the number of classes under their prefix, and hot, whether these hold more than group_units units; a written table.

    Classes are counted by prefix and part of their digest, and the counts of a
    prefix, at most _PARTS, summed; the sums meet the classes on both, so those
    of one prefix are dealt to many tasks.
    """
    parted = classes.withColumn("part", F.pmod("c1", F.lit(_PARTS)))
    units = F.shiftright("place", _BITS).bitwiseAND(_MASK) - 1 + length
    parts = parted.groupBy("gram", "part").agg(F.count("*").alias("k"), F.sum(units).alias("units"))
    whole = Window.partitionBy("gram")
    crowd = materialize(parts.select("gram", "part", F.sum("k").over(whole).alias("k"), F.sum("units").over(whole).alias("units")), "crowd")
    out = materialize(parted.join(crowd, ["gram", "part"]).withColumn("hot", F.col("units") > group_units).drop("part", "units"), "classes")
    discard(crowd)
    return out


def _whole() -> list:
    """lo and hi of all windows of a class."""
    return [F.array(F.lit(0).cast("long")).alias("lo"), F.array(F.shiftright("place", _BITS).bitwiseAND(_MASK)).alias("hi")]


def _resolve(bodies: DataFrame, kind: type, length: int, width: int, decide: Decide, group_units: int) -> DataFrame:
    """FOUND of classes with text; crowded ones are split into ever smaller bundles until groups fit or windows are single."""
    found = _decided(bodies, decide)
    if width == 1 or not bodies.where("hot").limit(1).count():
        return found
    width = -(-width // 8)
    bundles = materialize(_split(bodies.where("hot"), kind, length, width), "bundles")
    if width == 1:  # a bundle is one window: those with the same bytes repeat, and no digest is believed
        name = ["gram2", "body"]
        below = materialize(bundles.groupBy(*name).agg(F.sum("n").alias("n"), F.any_value("place").alias("place")).where("n > 1").select(*name, *_whole()), "found")
    else:
        name = ["gram2", "d1", "d2"]
        kids = bundles.groupBy(F.col("gram2").alias("gram"), F.col("d1").alias("c1"), F.col("d2").alias("c2")).agg(F.sum("n").alias("n"), F.any_value("place").alias("place"), F.any_value("body").alias("body"))
        kids = materialize(kids, "kids")
        crowded = _crowded(kids, length, group_units)
        alone = crowded.where("k = 1 and n > 1").select("gram", "c1", "c2", *_whole())
        more = crowded.where("k > 1").select("gram", "c1", "c2", "n", "place", "hot", "body")
        below = materialize(alone.unionByName(_resolve(more, kind, length, width, decide, group_units)).where("size(lo) > 0").toDF(*name, "lo", "hi"), "found")
        for table in (kids, crowded):
            discard(table)
    runs = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((x["lo"] + F.col("j0")).alias("lo"), (x["hi"] + F.col("j0")).alias("hi")))
    back = bundles.select("gram", "c1", "c2", "j0", *name).join(below, name).select("gram", "c1", "c2", runs.alias("runs"))
    back = back.groupBy("gram", "c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return found.unionByName(back.select("gram", "c1", "c2", F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi")))


def repeated_spans(profiles: DataFrame, kind: type, length: int, gram: int, decide: Decide, group_units: int = 1 << 18) -> DataFrame:
    """Steps 2 to 5: (rid, spans), spans an ordered array of struct(start, end) in units, of rows that have any; a written table."""
    grams = profiles.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    grams = materialize(grams, "grams")  # read from a table, both sides of the next join can be split by Spark
    anchors = profiles.select("rid", F.explode(F.arrays_zip("place", "gram", "c1", "c2")).alias("a")).select("rid", "a.*")
    members = materialize(anchors.join(grams, "gram").select("rid", "place", "gram", "c1", "c2"), "members")

    counted = members.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("rep"))
    counted = materialize(counted.select("gram", "c1", "c2", "n", "rep.*"), "counted")
    classes = _crowded(counted, length, group_units)
    for table in (counted, grams):
        discard(table)

    alone = classes.where("k = 1").select("gram", "c1", "c2", *_whole())
    bodies = materialize(_fetch(profiles, classes.where("k > 1"), kind, length), "bodies")
    found = alone.unionByName(_resolve(bodies, kind, length, length - gram + 1, decide, group_units))
    found = materialize(found.where("size(lo) > 0"), "found")
    discard(bodies)
    discard(classes)

    first = F.shiftright("place", 2 * _BITS)
    spans = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((first + x["lo"]).alias("start"), (first + x["hi"] - 1 + length).alias("end")))
    out = members.join(found, ["gram", "c1", "c2"]).select("rid", F.explode(spans).alias("span"))
    out = materialize(out.groupBy("rid").agg(F.sort_array(F.collect_set("span")).alias("spans")), "spans")
    discard(members)
    discard(found)
    return out


def remove_spans(profiles: DataFrame, spans: DataFrame, id_col: str, cut: Callable[[bytes, np.ndarray, np.ndarray], tuple[bytes, int, int, int]], carry: Sequence[str] = ()) -> DataFrame:
    """(id, kept, n_units, n_removed, n_spans) of every row, and carry; cut gives kept and the counts from its bytes and the spans' starts and ends, merged and in order."""
    id_type = profiles.schema["id"].dataType.simpleString()
    extra = ["carry"] if carry else []
    more = f", carry {profiles.schema['carry'].dataType.simpleString()}" if carry else ""
    texts = profiles.select("rid", "id", "z", *extra)
    joined = texts.join(spans, "rid", "left").select("id", "z", F.col("spans.start").alias("lo"), F.col("spans.end").alias("hi"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = _compressor()[1]
        for batch in bounded(batches, "z", 1 << 20):
            rows = []
            for z, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("z", "lo", "hi")], strict=True):
                rows.append(cut(unpress.decompress(z), *merged(lo or [], hi or [])))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]], *[batch.column(c) for c in extra]], names=[id_col, "kept", "n_units", "n_removed", "n_spans", *extra])

    return joined.mapInArrow(run, f"`{id_col}` {id_type}, kept binary, n_units long, n_removed long, n_spans long{more}")


def merged(lo: Sequence[int], hi: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [lo, hi), lo ascending, as disjoint intervals that do not touch."""
    a, b = np.array(lo, np.int64), np.array(hi, np.int64)
    if len(a) < 2:
        return a, b
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    return a[new], reach[np.concatenate((new[1:], [True]))]


def without(data: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """data without the bytes of disjoint intervals in order."""
    return b"".join([data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True)])
