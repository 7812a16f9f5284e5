"""Winnowed anchors: a content-defined thinning of all fixed-length windows.

A window of `length` units (bytes or words) holds `length - gram + 1` grams.
The gram with the smallest mixed hash (the rightmost of equals) is the window's
anchor.  Equal windows choose the same gram at the same offset, so any two
equal windows meet under one anchor gram, and a repeated window can only be
found among anchors whose gram occurs more than once.  About
2 / (length - gram + 2) of all positions are anchors, so what has to be
shuffled shrinks by that factor and nothing is lost.

Every window belongs to exactly one anchor; the windows of an anchor start at
consecutive positions.  An anchor's *context* is the text its windows cover.

Gram hashes only route: windows that meet under one are compared further, so a
collision costs time and changes nothing.  What is taken for equal without a
comparison of bytes has equal 128-bit BLAKE2b digests of its bytes (`digests`).
Long sequences are taken in overlapping slices, so memory does not grow with
the longest text; an anchor whose windows fall into two slices has two contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift): a bijection that spreads bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_tables = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of base modulo 2**64; the longest table is kept."""
    table = _tables[base]
    while len(table) < n:
        table = np.concatenate((table, table * (table[-1:] * base)))
        _tables[base] = table
    return table[:n]


class PrefixHash:
    """Routing hashes of any substrings of a sequence of 64-bit values.

    sum(v[i] * B**(i - s)) over [s, e) modulo 2**64, for an odd B: cheap, but
    texts can be made to collide, so equality is never concluded from it.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=self.sums[1:])
        self.n = n

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Of every k consecutive values."""
        n = self.n - k + 1
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


#: Words of more bytes get their value from BLAKE2b, one by one.
_CHUNKED_UP_TO = 64


def word_values(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit values of the words data[start:end]: eight bytes at a time through a bijective mixer, so up to eight bytes no two are alike."""
    size = end - start
    view = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    out = mix(size.astype(np.uint64) * _U(0xA0761D6478BD642F) + _U(1))
    at, left = np.arange(len(start)), np.minimum(size, _CHUNKED_UP_TO)
    for k in range(0, _CHUNKED_UP_TO, 8):
        if k:
            live = left > k
            if not live.any():
                break
            at, left = at[live], left[live]
        chunk = view[start[at] + k]
        short = np.maximum(8 - (left - k), 0).astype(np.uint64) * _U(8)
        chunk = (chunk << short) >> short
        out[at] = mix(out[at] * _U(0xE7037ED1A0B428DB) ^ chunk)
    for i in np.flatnonzero(size > _CHUNKED_UP_TO).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def gram_values(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit values of every n consecutive values, mixed in one after another."""
    k = len(values) - n + 1
    out = np.full(k, mix(np.uint64([n]))[0])
    for i in range(n):
        out = mix(out * _U(0xE7037ED1A0B428DB) ^ values[i : i + k])
    return out


def digests(pieces: list[bytes], salts: list[int] | None = None) -> np.ndarray:
    """128-bit BLAKE2b digests as rows of two signed longs; pieces with different salts differ."""
    if salts is None:
        raw = b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in pieces])
    else:
        raw = b"".join([hashlib.blake2b(p, digest_size=16, salt=s.to_bytes(16, "little")).digest() for p, s in zip(pieces, salts, strict=True)])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each start i the index of the smallest of h[i : i + w], the rightmost of equals.

    Doubling over (hash, index): after step s each cell holds the best of 2**s cells.
    """
    n = len(h) - w + 1
    best = np.arange(len(h))
    val = h
    span = 1
    while span * 2 <= w:
        left, right = val[:-span], val[span:]
        take = right <= left
        best = np.where(take, best[span:], best[:-span])
        val = np.where(take, right, left)
        span *= 2
    if span < w:
        d = w - span
        left, right = val[:n], val[d : d + n]
        best = np.where(right <= left, best[d : d + n], best[:n])
    return best[:n]


#: Windows of one slice of a sequence.
SLICE = 1 << 20


def anchors(n: int, values: Callable[[int, int], np.ndarray], length: int, gram: int, slice_windows: int = SLICE) -> Iterator[tuple[np.ndarray, ...]]:
    """Of one sequence of n units, slice by slice: (first window start, windows, anchor - first start, gram hash).

    values(a, b) are the values of the units [a, b).  Nothing for a sequence
    shorter than one window.
    """
    for at in range(0, n - length + 1, slice_windows):
        part = values(at, min(at + slice_windows + length - 1, n))
        g = PrefixHash(part).grams(gram)
        best = window_argmin(g, length - gram + 1)
        change = np.flatnonzero(best[1:] != best[:-1]) + 1
        first = np.concatenate(([0], change))
        count = np.diff(np.concatenate((first, [len(best)])))
        anchor = best[first]
        yield first + at, count, anchor - first, g[anchor]
