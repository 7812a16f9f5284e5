"""Quality rules: tokenizer fertility.

A public vocabulary with byte fallback measures each text: characters per
token, the share of tokens that are single bytes, and the entropy of its token
distribution.  A text outside its language's bands is rejected (its script's
bands, where the language is unknown).  Base rules on words, symbols, lines
and repeated five-word windows come first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import bounded, held
from .repeats import merged
from .winnow import gram_values, word_values

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Accepted ranges; entropy floors (bits) at numbers of tokens, between them on a line over log2, none below the first."""

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: tuple[tuple[int, float], ...]

    def floor(self, tokens: int) -> float:
        if tokens < self.entropy_low[0][0]:
            return 0.0
        at, low = zip(*self.entropy_low, strict=True)
        return float(np.interp(np.log2(tokens), np.log2(at), low))


#: By language, from the good labelled texts of sf0.1 that pass the base rules: 0.1 and 99.9 % quantiles
#: of characters per token (0.25 down, 0.6 up) and byte share (0.05 up), 0.2 % quantiles of the entropy
#: within half an octave of each number of tokens, less 0.12 bits from 256 tokens on and up to 0.5 below.
#: Where a language had under five texts of a length, the lowest of the others stands.
LANGUAGE_BANDS = {
    "en": Band(1.6, 2.98, 0.1, ((16, 3.4), (32, 3.9), (64, 4.4), (128, 5.36), (192, 5.71), (256, 5.91), (384, 6.08), (512, 6.2), (768, 6.41), (1024, 6.49), (1536, 6.59), (2048, 6.64), (3072, 6.75), (4096, 6.78), (8192, 6.9))),
    "de": Band(1.17, 2.98, 0.09, ((16, 3.4), (32, 3.9), (64, 4.5), (128, 5.39), (192, 5.67), (256, 5.82), (384, 5.99), (512, 6.13), (768, 6.25), (1024, 6.33), (1536, 6.41), (2048, 6.49), (3072, 6.54), (4096, 6.59))),
    "fr": Band(1.39, 2.88, 0.11, ((16, 3.4), (32, 4.0), (64, 4.4), (128, 5.17), (192, 5.54), (256, 5.81), (384, 5.99), (512, 6.06), (768, 6.16), (1024, 6.23), (1536, 6.34), (2048, 6.42), (3072, 6.45), (4096, 6.5), (8192, 6.54))),
    "es": Band(1.18, 2.66, 0.09, ((16, 3.4), (32, 3.9), (64, 4.4), (128, 5.46), (192, 5.6), (256, 5.75), (384, 6.01), (512, 6.06), (768, 6.21), (1024, 6.35), (1536, 6.44), (2048, 6.5), (3072, 6.61), (4096, 6.64), (8192, 6.76))),
}
#: By script, for other or unknown languages.  No table has good texts of these: set by hand below what a few
#: paragraphs of ordinary prose showed, so wider than the bands above.
SCRIPT_BANDS = {
    "latin": Band(0.9, 5.0, 0.3, ((32, 3.4), (64, 4.0), (128, 4.9), (384, 5.4), (1024, 5.7))),
    "cyrillic": Band(0.7, 4.5, 0.3, ((32, 3.2), (64, 3.8), (128, 4.4), (512, 4.8))),
    "greek": Band(0.55, 4.0, 0.3, ((32, 2.8), (64, 3.3), (128, 3.6), (512, 3.8))),
    "cjk": Band(0.33, 3.0, 0.8, ((32, 3.2), (64, 3.6), (128, 4.2), (384, 4.8))),
    "other": Band(0.25, 4.0, 0.99, ((32, 2.5), (64, 2.8), (128, 3.1), (512, 3.3))),
}
#: First and last letters of the scripts, by code point; other letters above U+024F are "other".
_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("cjk", 0x2E80, 0x9FFF), ("cjk", 0xAC00, 0xD7A3))


def script_of(text: str) -> str:
    """The script of most letters of a text; latin if it has none."""
    if text.isascii():
        return "latin"
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = code[code >= 0x41]
    counts = {"latin": 0, "greek": 0, "cyrillic": 0, "cjk": 0}
    for name, lo, hi in _SCRIPTS:
        counts[name] += int(((letters >= lo) & (letters <= hi)).sum())
    counts["other"] = len(letters) - sum(counts.values())
    return max(counts, key=counts.__getitem__)


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True


def _repeated_words(data: bytes, start: np.ndarray, end: np.ndarray) -> int:
    """Words in windows that occur twice; hashes find candidates, the words themselves decide."""
    g = gram_values(word_values(data, start, end), REPEAT_WINDOW)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    at = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
    if not len(at):
        return 0
    windows = [tuple(data[a:b] for a, b in zip(start[i : i + REPEAT_WINDOW].tolist(), end[i : i + REPEAT_WINDOW].tolist(), strict=True)) for i in at.tolist()]
    n = Counter(windows)
    at = at[[n[w] > 1 for w in windows]]
    lo, hi = merged(at, at + REPEAT_WINDOW)
    return int((hi - lo).sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows) of a UTF-8 text."""
    x = np.frombuffer(data, np.uint8)
    blank = _IS_BLANK[x]
    step = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    chars = int(((x & 0xC0) != 0x80).sum()) - int(blank.sum())
    lines = [s for s in data.split(b"\n") if s.strip(BLANKS)]
    repeated = _repeated_words(data, start, end) if len(start) > REPEAT_WINDOW else 0
    return len(start), chars, int(_IS_SYMBOL[x].sum()), len(lines) - len(set(lines)), repeated


class Fertility:
    """Measures of a text under a vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def measure(self, texts: list[str], chars: list[int]) -> list[tuple[int, float, float, float]]:
        """(tokens, characters per token, share of byte tokens, entropy in bits) each; zeros without tokens."""
        out = []
        for ids, n in zip(self.model.encode(texts, num_threads=1), chars, strict=True):
            x = np.array(ids, np.int64)
            if not len(x):
                out.append((0, 0.0, 0.0, 0.0))
                continue
            x.sort()
            counts = np.diff(np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))))
            p = counts / len(x)
            out.append((len(x), n / len(x), float(self.is_byte[x].mean()), float(-(p * np.log2(p)).sum())))
        return out


def in_band(band: Band, tokens: int, chars_per_token: float, byte_share: float, entropy: float) -> bool:
    return band.chars_low <= chars_per_token <= band.chars_high and byte_share <= band.bytes_high and entropy >= band.floor(tokens)


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, kept boolean"


def judge_quality(docs: DataFrame, path: str, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs with the measures of OUTPUT; kept is false if a base rule fails or a measure is out of its band.

    Null and empty texts have no words and fail the base rules.  Whole texts
    are measured, each row alone, so repeated rows are judged alike; an unknown
    or null language falls back to the text's script; columns of docs with
    names of OUTPUT are replaced; an empty table gives an empty result.
    """
    added = [x.split()[0] for x in OUTPUT.split(", ")]
    names = [c for c in docs.columns if c not in added]
    has_lang = bool(lang_col) and lang_col in names
    src = docs.select(*[f"`{c}`" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = held(("fertility", path), lambda: Fertility(path))
        for batch in bounded(batches, text_col, holds=True):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            langs = batch.column(lang_col).to_pylist() if has_lang else [None] * len(texts)
            base = [base_counts(t.encode()) for t in texts]
            rows = []
            for text, lang, b, m in zip(texts, langs, base, fertility.measure(texts, [b[1] for b in base]), strict=True):
                failed = b[0] < MIN_WORDS or 100 * b[4] > MAX_REPEAT_PERCENT * b[0]
                band = LANGUAGE_BANDS.get(lang) or SCRIPT_BANDS[script_of(text)]
                rows.append((*b, failed, *m, not failed and in_band(band, *m)))
            cols = list(zip(*rows, strict=True))
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, OUTPUT.split(", "), strict=True)]], names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{fields}, {OUTPUT}")


