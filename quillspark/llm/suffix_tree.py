"""Substring dedup over words: prefix-partitioned suffix trees.

Suffixes are split into memory-sized groups by prefixes of variable length: the
first `gram` words, and longer ones where a group is too large (see repeats).
Only suffixes at winnowed anchors enter; each stands for the windows that begin
up to `length - gram` words before it.  Per group one tree is built over the
suffixes and one over what precedes them, read backwards.  A window that begins
j words before an anchor is repeated exactly if another suffix lies with it
under an internal node of depth `length - j` or more and, before the anchor,
under one of depth j or more: together the two nodes are a repeat of `length`
words at least, and the pairs of nodes that cannot be extended are the maximal
repeats.  Words are compared as such.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count as counter

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .store import materialize


class SuffixTree:
    """Generalised suffix tree over rows of word numbers (0: the suffix has ended), one root per group.

    leaves: rows in order.  Internal nodes, children before parents: depth in
    words, first and last leaf, parent (-1: none).
    """

    def __init__(self, rows: np.ndarray, group: np.ndarray):
        n = len(rows)
        keys = np.concatenate((group[:, None], rows), 1).astype(">u4")
        raw = keys.view(f"V{4 * keys.shape[1]}").ravel().tolist()
        self.leaves = np.array(sorted(range(n), key=raw.__getitem__), np.int64)
        keys = keys[self.leaves]
        same = (keys[1:] == keys[:-1]) & (keys[1:] != 0)
        same[:, 0] = keys[1:, 0] == keys[:-1, 0]
        # words shared by leaves i and i + 1; below zero between groups
        part = np.where(same.all(1), keys.shape[1], np.argmin(same, 1)) - 1
        depth, first, last, parent = [], [], [], []
        stack: list[tuple[int, int, list[int]]] = []  # depth, first leaf, finished children
        for i, shared in enumerate([*part.tolist(), -1]):
            start, below = i, []
            while stack and stack[-1][0] > shared:
                d, start, children = stack.pop()
                node = len(depth)
                for c in children:
                    parent[c] = node
                depth.append(d)
                first.append(start)
                last.append(i)
                parent.append(-1)
                if stack and stack[-1][0] > shared:
                    stack[-1][2].append(node)
                else:
                    below.append(node)
            if shared >= 0:
                if stack and stack[-1][0] == shared:
                    stack[-1][2].extend(below)
                else:
                    stack.append((shared, start, below))
        self.depth, self.first, self.last, self.parent = (np.array(x, np.int64) for x in (depth, first, last, parent))
        self.above = np.where(self.parent >= 0, self.depth[self.parent], -1) if len(depth) else self.depth

    def nodes(self, depth: int) -> np.ndarray:
        """The topmost internal nodes at `depth` or deeper."""
        return np.flatnonzero((self.depth >= depth) & (self.above < depth))

    def labels(self, depth: int) -> np.ndarray:
        """Per row a number that rows under one node of `depth` or more have in common."""
        top = self.nodes(depth)
        step = np.zeros(len(self.leaves) + 1, np.int64)
        np.add.at(step, self.first[top] + 1, 1)
        np.add.at(step, self.last[top] + 1, -1)
        out = np.empty(len(self.leaves), np.int64)
        out[self.leaves] = np.cumsum(np.cumsum(step[:-1]) == 0)
        return out


def repeated_windows(words: list[np.ndarray], windows: np.ndarray, offsets: np.ndarray, weights: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """Per class the mask of its windows that repeat; words are numbered from 1."""
    flat, size = np.concatenate(words), np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    places = offsets[:, None] - np.arange(int(windows.max()))[None, :]  # of window j: how far the anchor lies behind its start
    inside = np.arange(places.shape[1])[None, :] < windows[:, None]
    used = np.unique(places[inside])
    back = int(used[-1])

    def rows(step: int, width: int) -> np.ndarray:
        at = offsets[:, None] + (np.arange(width) if step > 0 else -1 - np.arange(width))[None, :]
        ok = (at >= 0) & (at < size[:, None])
        return np.where(ok, flat[np.clip(start[:, None] + at, 0, len(flat) - 1)], 0)

    after = SuffixTree(rows(1, length), group)
    before = SuffixTree(rows(-1, max(back, 1)), group)
    mask = inside & (weights > 1)[:, None]
    for j in used.tolist():
        x, window = np.nonzero((places == j) & inside)
        pair = after.labels(length - j)[x] * (len(words) + 1) + before.labels(j)[x]
        _, at, n = np.unique(pair, return_inverse=True, return_counts=True)
        hit = n[at] > 1
        mask[x[hit], window[hit]] = True
    return [m[:k] for m, k in zip(mask, windows.tolist(), strict=True)]


def decide(length: int) -> repeats.Decide:
    def run(groups: list[repeats.Group]) -> list[list[np.ndarray]]:
        numbers: defaultdict[bytes, int] = defaultdict(counter(1).__next__)
        words = [np.fromiter(map(numbers.__getitem__, b.split()), np.int64) for g in groups for b in g.bodies]
        windows, offsets, weights = (np.array([x for g in groups for x in getattr(g, name)], np.int64) for name in ("windows", "offsets", "weights"))
        sizes = [len(g.bodies) for g in groups]
        masks = repeated_windows(words, windows, offsets, weights, np.repeat(np.arange(len(groups)), sizes), length)
        ends = np.cumsum([0, *sizes]).tolist()
        return [masks[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    return run


def _cut(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int, int]:
    if not data:
        return data, 0, 0, 0
    start = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20) + 1, [len(data) + 1]))
    kept = repeats.without(data + b" ", start[lo], start[hi])[:-1]
    return kept, len(start) - 1, int((hi - lo).sum()), len(lo)


def remove_repeated_words(docs: DataFrame, length: int = 35, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_units, n_removed, n_spans) per row: the text's words, joined by spaces, without those that a `length`-word window covers which also starts elsewhere.

    Words are runs of anything but the six ASCII blanks, unchanged.  Windows
    are judged on the input, in the same or any other row, and never cross
    rows.  Null and empty texts have no words; texts under `length` words lose
    nothing; repeated rows and copies all lose what they share.  Null ids are
    allowed; other columns are ignored; an empty table gives an empty result.
    Texts are taken in slices and words of over 64 bytes compared by digest, so
    a worker holds some 60 bytes per byte of a slice and a few per byte of the
    longest text.
    """
    profiles = materialize(repeats.profile(docs, id_col, text_col, repeats.WordText, length, gram), "profiles")
    spans = repeats.repeated_spans(profiles, repeats.WordText, length, gram, decide(length))
    return repeats.remove_spans(profiles, spans, id_col, _cut)
