"""Packing: hierarchical multi-length packing of token ids into training sequences.

Tiers are context sizes, powers of two.  Full windows are cut from long
documents; every remainder is routed to the smallest tier that holds it.  Tiers
are packed from long to short: a remainder opens a window of its tier, the gap
is filled with the longest shorter remainders that fit, and the last bit with a
cut from a shorter one, so windows end up exactly full.  Windows are dealt to
step groups of equal tokens, long ones first.

Each task packs the documents of its own partition as they stream by, with a
bounded pool, and no shuffle.  What is left at the end of a partition is cut to
shorter windows; fewer than `SMALLEST_TAIL` tokens a partition need padding.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import bounded, held

#: Characters that str.split() takes for blanks and the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The last rest of a partition is cut into powers of two down to this.
SMALLEST_TAIL = 64


#: Words of these characters (and the space between them) are cut here; in lower case each is one character and composed.
_PLAIN = re.compile("[ -~À-ÖØ-öø-įĲ-ňŊ-ž]+")
#: Fixed value: the pieces that the tokenizer's pre-tokenizer keeps, over the characters above in lower case.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž ]+| ")
#: Four bytes that no id has.
_MARK = b"\xff\xff\xff\xff"
#: Words of more characters are not cached; what an entry weighs besides its characters and ids.
CACHED_UP_TO, ENTRY_BYTES = 64, 160


class WordTokens:
    """Ids by the tokenizers library, of each distinct piece of a word once.

    Valid for tokenizers that lower-case, drop white space, cut words into
    pieces and mark the last token of a piece by a suffix: then no token spans
    pieces, and a batch of pieces can be encoded as one text and cut apart.
    """

    SUFFIX = "</w>"

    def __init__(self, path: str, cache_bytes: int = 256 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.SUFFIX)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.long: set[str] = set()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cache_bytes, self.cached = cache_bytes, 0

    def _kept(self, cache: dict[str, bytes], new: list[str]) -> None:
        """Counts new entries."""
        self.cached += sum(map(len, new)) + sum(map(len, map(cache.__getitem__, new))) + ENTRY_BYTES * len(new)

    def _trim(self, used: set[str]) -> None:
        """After a batch: long entries go, and beyond the bound all but the words of the batch, and then these."""
        for cache in (self.words, self.pieces):
            for x in [x for x in used if len(x) > CACHED_UP_TO and x in cache]:
                self.cached -= len(x) + len(cache.pop(x)) + ENTRY_BYTES
        if self.cached > self.cache_bytes:
            self.pieces = {}
            self.words = {w: self.words[w] for w in used if w in self.words}
            self.cached = 0
            self._kept(self.words, list(self.words))
            if 2 * self.cached > self.cache_bytes:
                self.words, self.cached = {}, 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            else:
                self.pieces.update(zip(part, self._library(part), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Puts words into the cache; they are cut in one go, and a mark no id has parts them again."""
        joined = " ".join(new)
        plain = new
        if not _PLAIN.fullmatch(joined) or any(x in joined for x in self.special):
            plain = [w for w in new if _PLAIN.fullmatch(w) and not any(x in w for x in self.special)]
            joined = " ".join(plain)
        if plain:
            tokens = _PIECE.findall(joined.lower())
            self.pieces[" "] = _MARK
            unknown = [p for p in set(tokens) if p not in self.pieces]
            self._learn_pieces(unknown)
            self._kept(self.pieces, unknown)
            self.long.update(p for p in unknown if len(p) > CACHED_UP_TO)
            ids = b"".join(map(self.pieces.__getitem__, tokens)).split(_MARK)
            self.words.update(zip(plain, ids, strict=True))
        if len(plain) < len(new):
            other = [w for w in new if w not in self.words]
            self.words.update(zip(other, self._library(other), strict=True))
        self._kept(self.words, new)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        odd = {i: self._library([t])[0] for i, t in enumerate(texts) if t and any(x in t for x in _ODD)}
        words = [[] if i in odd else (t or "").split() for i, t in enumerate(texts)]
        known = [list(map(self.words.get, ws)) for ws in words]
        gaps = [[k for k, v in enumerate(vs) if v is None] for vs in known]
        fresh = {ws[k] for ws, ks in zip(words, gaps, strict=True) for k in ks}
        self.long: set[str] = {w for w in fresh if len(w) > CACHED_UP_TO}
        self._learn(list(fresh))
        for ws, vs, ks in zip(words, known, gaps, strict=True):
            for k in ks:
                vs[k] = self.words[ws[k]]
        out = [odd.get(i) or b"".join(vs) for i, vs in enumerate(known)]
        self._trim(self.long if self.cached <= self.cache_bytes else self.long.union(*words))
        return out


class Packer:
    """Packs a stream of documents: add() and finish() give finished sequences.

    A sequence is a list of (document, start, length); documents are any values.
    """

    def __init__(self, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), group_windows: int = 16):
        self.tiers = sorted(tiers)
        self.window = self.tiers[-1]
        self.pool: list[tuple[int, int, int]] = []  # (length, number, start), sorted
        self.docs: dict[int, object] = {}
        self.number = 0
        self.group_tokens = group_windows * self.window
        self.open_groups: list[list[int]] = []  # [room, id]
        self.groups = 0

    def add(self, docs: list[tuple[object, int]]) -> list[tuple[list, int]]:
        out = []
        for doc, n in docs:
            full = n // self.window
            out += [[(doc, k * self.window, self.window)] for k in range(full)]
            if rest := n - full * self.window:
                self.docs[self.number] = doc
                bisect.insort(self.pool, (rest, self.number, full * self.window))
                self.number += 1
        return self._grouped(out + self._pack())

    def _tier(self, n: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, n)]

    def _pack(self) -> list[list]:
        out = []
        while self.pool:
            first = self.pool.pop()
            taken, room = [first], self._tier(first[0]) - first[0]
            while room and self.pool:
                at = bisect.bisect_right(self.pool, (room + 1,)) - 1
                if at >= 0:
                    piece = self.pool.pop(at)
                    taken.append(piece)
                    room -= piece[0]
                else:  # all are longer: cut the shortest
                    n, number, start = self.pool.pop(0)
                    taken.append((room, number, start))
                    bisect.insort(self.pool, (n - room, number, start + room))
                    room = 0
            if room:  # nothing left to fill with: wait for more
                for piece in taken:
                    bisect.insort(self.pool, piece)
                break
            out.append([(self.docs[number], start, n) for n, number, start in taken])
        live = {number for _, number, _ in self.pool}
        self.docs = {k: v for k, v in self.docs.items() if k in live}
        return out

    def finish(self) -> list[tuple[list, int]]:
        """The rest, in windows of powers of two and one that needs padding."""
        rest = [(self.docs[number], start, n) for n, number, start in reversed(self.pool)]
        self.pool, out = [], []
        while rest:
            total = sum(n for *_, n in rest)
            size = min(self.window, 1 << (total.bit_length() - 1))
            room = size if size >= SMALLEST_TAIL else total
            seq = []
            while room:
                doc, start, n = rest.pop(0)
                take = min(n, room)
                seq.append((doc, start, take))
                room -= take
                if take < n:
                    rest.insert(0, (doc, start + take, n - take))
            out.append(seq)
        return self._grouped(out)

    def _grouped(self, seqs: list[list]) -> list[tuple[list, int]]:
        """Deals sequences to step groups of equal tokens, long ones first, each to the first with room."""
        out = []
        for size, seq in sorted(((sum(n for *_, n in s), s) for s in seqs), key=lambda x: -x[0]):
            group = next((g for g in self.open_groups if g[0] >= size), None)
            if group is None:
                group = [self.group_tokens, self.groups]
                self.groups += 1
                self.open_groups.append(group)
            group[0] -= size
            out.append((seq, group[1]))
            self.open_groups = [g for g in self.open_groups if g[0]]
        return out


OUTPUT = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, step_group long"


def pack_documents(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = (512, 1024, 2048, 4096), cache_bytes: int = 256 << 20) -> DataFrame:
    """One row per piece: id, start and length in its document's ids, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, step_group.

    Each document is tokenized whole, with end_id after it; null is an empty
    text, which still has its end_id.  Rows are packed one by one, so null or
    repeated ids are no matter.  sequence_id and step_group are unique over the
    table.  An empty table gives an empty result; other columns are ignored.
    A worker's caches of words and pieces hold cache_bytes between batches.
    """
    df = df.select(df[id_col], df[text_col].alias("__text"))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {OUTPUT}"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = held(("words", path, cache_bytes), lambda: WordTokens(path, cache_bytes)), Packer(tiers)
        base, done = TaskContext.get().partitionId() << 36, 0
        kind: pa.DataType = pa.int64()

        def rows(seqs: list[tuple[list, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal done
            for at in range(0, len(seqs), 512):
                cols: list[list] = [[] for _ in range(8)]
                for seq, group in seqs[at : at + 512]:
                    offset = 0
                    for (key, ids), start, n in seq:
                        for col, x in zip(cols, (key, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + done, offset, base + group), strict=True):
                            col.append(x)
                        offset += n
                    done += 1
                longs = [pa.array(c, pa.int64()) for c in cols[1:3]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *longs, pa.array(cols[3], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[4:]]], names=[id_col, *[x.split()[0] for x in OUTPUT.split(", ")]])

        for batch in bounded(batches, "__text", 2 << 20, holds=True):
            kind = batch.schema.field(0).type
            ids = [x + end for x in words.encode_batch(batch.column(1).to_pylist())]
            yield from rows(packer.add([((k, x), len(x) // 4) for k, x in zip(batch.column(0).to_pylist(), ids, strict=True)]))
        yield from rows(packer.finish())

    return df.mapInArrow(run, schema)
