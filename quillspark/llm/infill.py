"""Fill-in-middle transformation by run-length class encoding.

A text's units are its maximal runs of ASCII letters and its other single
characters.  Stored are its maximal runs of one class with the units before
each: a run of letters is one unit, a run of others as many as it has
characters.  A cut after so many units is found by binary search for its run
and plain arithmetic within it, so no list of units is made.

One map over the texts without an exchange; a document's form and cuts depend
on its id and text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters whose classes are found at once.
_SLICE = 1 << 20


class Runs:
    """Maximal runs of one character class: where each starts, its class, and the units before it."""

    def __init__(self, text: str):
        starts, classes, last = [], [], None
        for at in range(0, len(text), _SLICE):
            points = np.frombuffer(text[at : at + _SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = ((points | 32) >= 97) & ((points | 32) <= 122)
            edges = np.flatnonzero(np.diff(letter)) + 1
            if last is None or bool(letter[0]) != last:
                edges = np.concatenate(([0], edges))
            starts.append(edges + at)
            classes.append(letter[edges])
            last = bool(letter[-1])
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.letters = np.concatenate(classes) if classes else np.zeros(0, bool)
        lengths = np.diff(np.append(self.starts, len(text)))
        units = np.where(self.letters, 1, lengths)
        self.before = np.cumsum(units) - units
        self.n_units, self.n_chars = int(units.sum()), len(text)

    def offset(self, units: int) -> int:
        """Characters that the first `units` units have."""
        if units >= self.n_units:
            return self.n_chars
        run = int(np.searchsorted(self.before, units, "right")) - 1
        # a cut inside a run of letters is one before it, as the run is a single unit
        return int(self.starts[run]) + (0 if self.letters[run] else units - int(self.before[run]))


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document; a null id draws as the empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    return h1, h2, h3, h4


def transform(text: str, doc_id: object, seed: int = 1, share: int = 90, spm_share: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    runs = Runs(text)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= share:
        return runs.n_units, "plain", None, None, text
    low, high = sorted(runs.offset(h % (runs.n_units + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_share:
        return runs.n_units, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return runs.n_units, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, share: int = 90, spm_share: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    form: plain, psm or spm; of the texts that can be cut, `share` percent are
    and `spm_share` percent of those take the order suffix first.  An empty
    text, one that holds a marker, and a null text (as the empty one) stay
    plain, with null counts.  A null id draws as the empty id; repeated rows
    come out alike.  Other columns are ignored.  A text is held whole, its
    runs take 17 bytes each, its characters are classed a million at a time.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found = [transform(t, i, seed, share, spm_share) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=schema.names)

    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: the markers are found from the left, as the text holds none."""
    first, second = F.when(form == "spm", F.lit(PREFIX)).otherwise(SUFFIX), F.lit(MIDDLE)
    head = F.lit(len(PREFIX) + 1)
    cut1 = F.call_function("locate", first, output, F.lit(1))
    cut2 = F.call_function("locate", second, output, F.lit(1))
    part1 = F.substring(output, head, cut1 - head)
    part2 = F.substring(output, cut1 + len(PREFIX), cut2 - cut1 - len(PREFIX))
    middle = F.substring(output, cut2 + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part2, middle, part1)).otherwise(F.concat(part1, middle, part2))
