"""Suffix-array dedup: depth-limited radix sort of byte suffixes.

Suffixes are ordered only through their first `length` bytes, by
most-significant-digit passes.  The first digit, distributed, is the prefix of
the anchor suffix that a window holds, with the window's place before it (see
repeats): suffixes alone under it retire at once, and suffixes of equal
contexts stand together with a weight.  The passes after it take eight bytes
each, within memory-sized buckets: counting passes order a bucket by its digit,
it falls apart into smaller ones, and suffixes alone in a bucket retire.  Buckets that
are left after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .store import materialize

_DIGIT = 8


def counting_order(bucket: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Order by bucket (numbered from 0) and then digit, in stable passes over 16 bits at a time, which numpy does by counting."""
    order = np.arange(len(bucket))
    top = int(bucket.max()) if len(bucket) else 0
    for key, bits in ((digit, 8 * _DIGIT), (bucket, top.bit_length())):
        for shift in range(0, bits, 16):
            piece = (key >> key.dtype.type(shift)).astype(np.uint16)
            order = order[np.argsort(piece[order], kind="stable")]
    return order


def radix_repeats(text: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Mask of the suffixes that share their first `length` bytes with another one of their bucket.

    text: bytes; every suffix has at least `length` of them.
    """
    padded = np.concatenate((text, np.zeros(_DIGIT, np.uint8)))
    digit_at = np.zeros(len(text), np.uint64)
    for k in range(_DIGIT):
        digit_at = digit_at << np.uint64(8) | padded[k : k + len(text)]
    alive = np.arange(len(start))
    depth = 0
    while True:
        # suffixes alone in their bucket retire
        order = np.argsort(bucket[alive], kind="stable") if depth == 0 else np.arange(len(alive))
        alive = alive[order]
        b = bucket[alive]
        new = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
        alone = new & np.concatenate((new[1:], [True])) if len(b) else new
        alive = alive[~alone]
        if depth >= length or not len(alive):
            break
        # one pass: order each bucket by the next digit
        at = min(depth, length - _DIGIT) if length >= _DIGIT else 0
        digit = digit_at[start[alive] + at]
        if length < _DIGIT:
            digit = digit >> np.uint64(8 * (_DIGIT - length))
        b = bucket[alive]
        b = np.cumsum(np.concatenate(([0], b[1:] != b[:-1])))
        order = counting_order(b, digit)
        alive, digit, b = alive[order], digit[order], b[order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (digit[1:] != digit[:-1])))
        bucket[alive] = np.cumsum(new)
        depth += _DIGIT
    out = np.zeros(len(start), bool)
    out[alive] = True
    return out


def decide(length: int) -> repeats.Decide:
    def run(groups: list[repeats.Group]) -> list[list[np.ndarray]]:
        bodies = [b for g in groups for b in g.bodies]
        count = np.array([w for g in groups for w in g.windows])
        offset = np.array([o for g in groups for o in g.offsets])
        weight = np.array([n for g in groups for n in g.weights])
        group = np.repeat(np.arange(len(groups)), [len(g.bodies) for g in groups])
        base = np.cumsum([0, *map(len, bodies)])[:-1]
        owner = np.repeat(np.arange(len(bodies)), count)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        # a window's anchor lies `offset - j` bytes behind its start, so only such windows can be equal
        bucket = group[owner] * (length + 1) + offset[owner] - j
        mask = radix_repeats(np.frombuffer(b"".join(bodies), np.uint8), base[owner] + j, bucket, length)
        mask |= weight[owner] > 1
        ends = np.cumsum(count).tolist()
        masks = [mask[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        sizes = np.cumsum([0, *[len(g.bodies) for g in groups]]).tolist()
        return [masks[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    return run


def _cut(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int, int]:
    return repeats.without(data, lo, hi), len(data), int((hi - lo).sum()), len(lo)


def _cut_characters(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int, int]:
    """The same, with every character that loses a byte gone as a whole, so that what is kept is UTF-8."""
    starts, ends = [], []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        while data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        starts.append(a)
        ends.append(b)
    return _cut(data, *repeats.merged(starts, ends))


def remove_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 48, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(id, kept, n_units, n_removed, n_spans) per row, and the columns of carry as a struct of that name: the text's bytes without those that a `length`-byte string covers which also starts elsewhere.

    Strings are judged on the input, in the same or any other row, and never
    cross rows.  Null is the empty text; texts under `length` bytes lose
    nothing; repeated rows and copies all lose what they share.  Null ids are
    allowed; other columns are ignored; an empty table gives an empty result.
    kept may begin or end inside a character, as bytes do, unless
    whole_characters is set.  Texts are taken in slices, so a worker holds some
    80 bytes per byte of a slice and a few per byte of the longest text.
    """
    profiles = materialize(repeats.profile(docs, id_col, text_col, repeats.ByteText, length, gram, carry), "profiles")
    spans = repeats.repeated_spans(profiles, repeats.ByteText, length, gram, decide(length))
    return repeats.remove_spans(profiles, spans, id_col, _cut_characters if whole_characters else _cut, carry)
