"""Token estimates.  The four models are deliberately different and never mixed in one report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: The 18 characters that count as punctuation of code.
PUNCTUATION = "{}[]();:/\\<>=+-*_."
#: Substrings that mark code.
CODE_MARKS = ["::", "=>", "Traceback", "fn ", "const "]
#: Characters per token for (code, prose) by model family.
CHARS_PER_TOKEN = {"claude": (3.3, 4.0), "codex": (3.2, 3.9), "gemini": (3.5, 4.2), "generic": (3.4, 4.0)}


def measures(text: Column) -> Column:
    """struct(chars, punct, words, lines, digits, marks): what an estimate goes by.

    Of pieces that each end in a line break, the sums are those of the joined
    text: words, marks and lines don't reach over a break.
    """
    count = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    return F.struct(
        F.length(text).cast("long").alias("chars"),
        count(PUNCTUATION).alias("punct"),
        T.word_count(text).cast("long").alias("words"),
        F.size(T.lines(text)).cast("long").alias("lines"),
        count("0123456789").alias("digits"),
        T.contains_any(text, CODE_MARKS).cast("long").alias("marks"),
    )


def biased(m: Column) -> Column:
    """Whether measures are of code."""
    return (m["punct"].cast("double") / F.greatest(m["chars"], F.lit(1)) > 0.11) | (m["marks"] > 0)


def estimated_of(m: Column, family: str = "claude") -> Column:
    """Estimated tokens of measures."""
    code, prose = CHARS_PER_TOKEN[family]
    n_lines, coded = F.greatest(m["lines"], F.lit(1)), biased(m)
    by_chars = F.lit(0.58) * (m["chars"].cast("double") / F.when(coded, F.lit(code)).otherwise(F.lit(prose)))
    by_words = F.lit(0.42) * (m["words"].cast("double") * F.when(coded, F.lit(1.45)).otherwise(F.lit(1.28)))
    by_lines = F.when(coded, F.least(n_lines * F.lit(0.15), F.lit(24.0))).otherwise(F.least(n_lines * F.lit(0.05), F.lit(10.0)))
    est = F.greatest(F.lit(1), F.round(by_chars + by_words + m["digits"] * F.lit(0.02) + by_lines).cast("int"))
    return F.when(m["chars"] == 0, F.lit(0)).otherwise(est).cast("int")


def _measured(text: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text's measures, which are taken once however often f reads them."""
    return F.transform(F.array(measures(text)), f)[0]


def estimate(text: Column, family: str = "claude") -> Column:
    """struct(estimated_tokens, lower_bound, upper_bound, bytes, chars, words, lines, heuristic, model_family)."""

    def of(m: Column) -> Column:
        est, coded, empty = estimated_of(m, family), biased(m), m["chars"] == 0
        spread = F.ceil(est * F.when(m["chars"] < 120, F.lit(0.18)).when(coded, F.lit(0.14)).otherwise(F.lit(0.12))).cast("int")
        zero = lambda c, kind: F.when(empty, F.lit(0)).otherwise(c).cast(kind)
        return F.struct(
            est.alias("estimated_tokens"),
            zero(F.greatest(est - spread, F.lit(0)), "int").alias("lower_bound"),
            zero(est + spread, "int").alias("upper_bound"),
            F.octet_length(text).cast("long").alias("bytes"),
            m["chars"].alias("chars"),
            m["words"].alias("words"),
            zero(F.greatest(m["lines"], F.lit(1)), "long").alias("lines"),
            F.when(empty, "empty-input").when(coded, "code-biased").otherwise("prose").alias("heuristic"),
            F.lit(family).alias("model_family"),
        )

    return _measured(text, of)


def estimated(text: Column, family: str = "claude") -> Column:
    return _measured(text, lambda m: estimated_of(m, family))


def approx_tokens(text: Column) -> Column:
    """max(1, characters div 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def word_tokens(text: Column) -> Column:
    """Words times 1.3, cut; none for the empty text."""
    return F.floor(T.word_count(text) * F.lit(1.3)).cast("int")


def line_cost(text: Column) -> Column:
    """Read cost: 8 tokens a line."""
    return F.size(T.lines(text)) * 8


def repo_saving(noise: Column) -> Column:
    """Estimated tokens that a noise filter saves over five sessions, with the fixed savings of the other parts."""
    per_session = F.when(noise > 1000, F.lit(10000)).when(noise > 100, F.floor(noise * 100 / 10)).otherwise(noise * 50)
    return (per_session * 5 + (20000 + 15000 + 10000 + 8000)).cast("long")


#: US dollars per million tokens.
PRICES = {"input": 3.00, "output": 15.00, "cache_read": 0.30, "cache_write_5m": 3.75, "cache_write_1h": 6.00}


def cost(tokens: Column, kind: str) -> Column:
    return tokens * F.lit(PRICES[kind]) / F.lit(1e6)
