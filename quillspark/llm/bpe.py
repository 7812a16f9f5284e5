"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the adjacent pairs of a piece, each with
(rank, position) or infinity; every inner node holds the smaller of its
children, so the root is the leftmost of the lowest-ranked pairs.  A merge
changes three leaves (the pair itself, its left and its right neighbour), each
updated along its path to the root, until the root is infinity.  Short pieces
go through the same tree many at a time, as rows of one array.

Pieces never span a boundary between blank and other text, so a text's ids are
those of its blank-delimited units; short ones are kept in a cache of bounded
bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .batches import binary_array, bounded, held

#: Fixed value: the characters that the tokenizer's regular expressions count as white space.
BLANK = "\t-\r \x85\xa0  -     　"
#: A blank-delimited unit with the one space that may belong to its first piece.
UNIT = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Fixed value: the pieces of a byte-level tokenizer (contractions, letters, digits, other, blanks).
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")

#: Below this character the Unicode tables of both libraries agree; units with later ones are cut by the tokenizers library.
AGREED_BELOW = "\u0530"

INF = np.int64(2**62)
_POS = 32
#: Pieces of up to this many bytes are merged together as rows.
ROWS_UP_TO = 32
#: Units of more characters are not cached; what an entry weighs besides its characters and ids.
CACHED_UP_TO, ENTRY_BYTES = 64, 160


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 bytes themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)}


class ByteBPE:
    """Encodes and decodes as the tokenizers library does with this file, without truncation, padding and added specials."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        char_of = byte_characters()
        byte_of = {c: b for b, c in char_of.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], INF), order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.byte_id = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_rx = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        raw = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(max(tokens) + 1))]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_end = np.cumsum([len(x) for x in raw])
        self.token_len = np.array([len(x) for x in raw], np.int64)
        from tokenizers.pre_tokenizers import ByteLevel

        self.cutter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.cache: dict[str, bytes] = {}
        self.cache_bytes, self.cached = cache_bytes, 0

    # -- merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[np.minimum(at, len(self.ranks) - 1)], INF >> _POS)

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bits) of pieces of at most ROWS_UP_TO bytes."""
        lens = np.array([len(p) for p in pieces])
        size = 1 << max(1, int(lens.max() - 1).bit_length())
        n = len(pieces)
        sym = np.full((n, size + 1), -1, np.int64)  # the last column stands for "no symbol"
        inside = np.arange(size)[None, :] < lens[:, None]
        sym[:, :size][inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        where = np.arange(size, dtype=np.int64)
        nxt = np.minimum(np.broadcast_to(where + 1, (n, size)), size).copy()
        nxt[where[None, :] >= lens[:, None] - 1] = size
        prv = np.broadcast_to(np.where(where > 0, where - 1, size), (n, size)).copy()
        tree = np.full((n, 2 * size), INF)
        tree[:, size : 2 * size - 1] = self._rank(sym[:, : size - 1], sym[:, 1:size]) << _POS | where[: size - 1]
        tree[:, size : 2 * size][tree[:, size:] >= INF] = INF
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.arange(n)
        nothing = np.int64(size)
        while True:
            root = tree[rows, 1]
            live = root < INF
            if not live.any():
                break
            rows, root = rows[live], root[live]
            i = root & ((1 << _POS) - 1)
            j = nxt[rows, i]
            sym[rows, i] = self.merged[root >> _POS]
            k, p = nxt[rows, j], prv[rows, i]
            sym[rows, j] = -1
            nxt[rows, i] = k
            some = k < nothing
            prv[rows[some], k[some]] = i[some]
            tree[rows, size + j] = INF
            for a, b in ((i, k), (p, i)):
                value = self._rank(sym[rows, a], sym[rows, b])
                ok = a < nothing
                tree[rows[ok], size + a[ok]] = np.where(value < INF >> _POS, value << _POS | a, INF)[ok]
            for leaf in (j, i, np.where(p < nothing, p, i)):
                node = (size + leaf) >> 1
                while node[0] > 0:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
        flat = sym[:, :size]
        keep = flat >= 0
        ids = flat[keep].astype("<u4").tobytes()
        ends = np.cumsum(keep.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """The same for one piece of any length; n log n steps and some 60 bytes a byte."""
        sym = array("q", self.byte_id[np.frombuffer(piece, np.uint8)].tobytes())
        n = len(sym)
        size = 1 << max(1, (n - 1).bit_length())
        rank_of, merged, inf = self.rank_of, self.merged, int(INF)
        tree = array("q", [inf]) * (2 * size)

        def leaf(a: int, b: int) -> int:
            r = rank_of.get(sym[a] << 20 | sym[b])
            return inf if r is None else r << _POS | a

        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1

        while (root := tree[1]) < inf:
            i = root & ((1 << _POS) - 1)
            j = nxt[i]
            sym[i] = int(merged[root >> _POS])
            sym[j] = -1
            k = nxt[i] = nxt[j]
            put(j, inf)
            put(i, leaf(i, k) if k < n else inf)
            if k < n:
                prv[k] = i
            if (p := prv[i]) >= 0:
                put(p, leaf(p, i))
        ids = np.frombuffer(sym, np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    # -- texts

    def _cut(self, unit: str) -> list[str]:
        if unit.isascii() or max(unit) < AGREED_BELOW:
            return PIECE.findall(unit)
        return [unit[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(unit)]

    def _learn(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of units."""
        cut = {u: self._cut(u) for u in units}
        pieces = {p: p.encode() for ps in cut.values() for p in ps}
        ids: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for p, raw in pieces.items():
            if len(raw) > ROWS_UP_TO:
                ids[p] = self.merge_one(raw)
            else:
                by_size.setdefault(max(1, (len(raw) - 1).bit_length()), []).append(p)
        for bits, group in by_size.items():
            step = max(1, (1 << 18) >> bits)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                ids.update(zip(part, self.merge_rows([pieces[p] for p in part]), strict=True))
        return {u: ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps]) for u, ps in cut.items()}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        parts: list[list] = []
        for text in texts:
            if not text:
                parts.append([])
            elif self.special_rx is not None and self.special_rx.search(text):
                parts.append([np.array([self.special[x]], "<u4").tobytes() if i % 2 else UNIT.findall(x) for i, x in enumerate(self.special_rx.split(text))])
            else:
                parts.append([UNIT.findall(text)])
        cache = self.cache
        fresh = {u for ps in parts for p in ps if isinstance(p, list) for u in p if u not in cache}
        learnt = self._learn(fresh)
        short = {u: x for u, x in learnt.items() if len(u) <= CACHED_UP_TO}
        cache.update(short)
        long = {u: x for u, x in learnt.items() if len(u) > CACHED_UP_TO}
        self.cached += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY_BYTES * len(short)
        if long:
            out = [b"".join([p if isinstance(p, bytes) else b"".join([cache[u] if u in cache else long[u] for u in p]) for p in ps]) for ps in parts]
        else:
            get = cache.__getitem__
            out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in ps]) for ps in parts]
        if self.cached > self.cache_bytes:
            cache.clear()
            self.cached = 0
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        x = np.frombuffer(ids, "<u4")
        if not len(x):
            return ""
        lens = self.token_len[x]
        ends = np.cumsum(lens)
        shift = np.repeat(self.token_end[x] - ends, lens)
        return self.token_bytes[shift + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")


def encode_documents(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with `ids` (binary: little-endian unsigned 32-bit ids of the whole text) and `decoded` (the text those ids decode to).

    Null and empty texts have no ids and decode to the empty text.  Every row
    is encoded alone, so repeated rows, ties and empty tables need no care;
    columns of df named ids or decoded are replaced.
    """
    kept = [c for c in df.columns if c not in ("ids", "decoded")]
    df = df.select(*[f"`{c}`" for c in kept])
    schema = StructType([*df.schema.fields, StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(("bpe", path), lambda: ByteBPE(path))
        for batch in bounded(batches, text_col, 2 << 20, holds=True):
            ids = bpe.encode_batch(batch.column(text_col).to_pylist())
            decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(ids), decoded], names=[*kept, "ids", "decoded"])

    return df.mapInArrow(run, schema)
