"""String primitives with pinned semantics, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines as array: CR LF counts as LF, a final line break opens no line, the empty text has none."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: Unicode's white space, as (?U)\\s of a pattern.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(s, F.lit(BLANKS))


def trim_start(s: Column) -> Column:
    return F.ltrim(s, F.lit(BLANKS))


def trim_end(s: Column) -> Column:
    return F.rtrim(s, F.lit(BLANKS))


def trimmed_lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(lines(text), trim), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def ascii_lower(s: Column) -> Column:
    """A to Z only; a text of ASCII alone by the plain function, which is the same there and faster."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def contains_any(s: Column, needles: list[str]) -> Column:
    out = s.contains(needles[0])
    for n in needles[1:]:
        out = out | s.contains(n)
    return out


def starts_with_any(s: Column, heads: list[str]) -> Column:
    out = s.startswith(heads[0])
    for h in heads[1:]:
        out = out | s.startswith(h)
    return out


def matches(text: Column, pattern: str) -> Column:
    """Distinct matches in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def first(items: Column) -> Column:
    """First element, null if there is none."""
    return F.try_element_at(items, F.lit(1))


def collapse_blank(items: Column) -> Column:
    """Runs of blank lines become one."""
    blank = lambda x: trim(x) == ""
    return F.filter(items, lambda x, i: ~blank(x) | (i == 0) | ~blank(F.get(items, i - 1)))
