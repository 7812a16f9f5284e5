"""Fertility bands from labelled texts, for any corpus.

On sf0.1 the rule gives the ranges of quality.LANGUAGE_BANDS to the digit and
its entropy floors to a tenth of a bit from 384 tokens on; the floors below that
were set with wider margins, by hand.  Every labelled good text is measured by Spark; per language quantiles are exact
aggregates, so nothing but a few numbers per language reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import Band, judge_quality

#: Numbers of tokens at which entropy floors stand; texts that a floor needs; margins of characters per token and byte share, and of entropy at 16 tokens and from 256 on, between them on a line over log2.
AT = (16, 32, 64, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 8192)
LEAST = 5
CHARS_DOWN, CHARS_UP, BYTES_UP, ENTROPY_SHORT, ENTROPY_LONG = 0.25, 0.6, 0.05, 0.5, 0.12


def fit_bands(docs: DataFrame, labels: DataFrame, path: str) -> dict[str, Band]:
    """A band per language of docs(doc_id, text, lang), from texts that labels(doc_id, quality) call good and that pass the base rules.

    Characters per token lie between their 0.1 and 99.9 % quantiles with
    margins, the byte share below its 99.9 % quantile and a margin.  A floor is
    the 0.2 % quantile of the entropy of texts within a quarter octave of its
    number of tokens, less a margin; where a language has fewer than LEAST, the
    lowest floor of the others stands, and beyond the longest texts of all
    there is none.  Null languages and ids take no part.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    seen = judge_quality(docs.where("lang is not null").join(good, "doc_id", "left_semi"), path).where("not base_failed and n_tokens > 0")
    seen = seen.select("lang", "n_tokens", "chars_per_token", "byte_share", "token_entropy")
    edges = seen.groupBy("lang").agg(F.percentile("chars_per_token", [0.001, 0.999]).alias("chars"), F.percentile("byte_share", 0.999).alias("bytes")).collect()
    octave = F.abs(F.log2("n_tokens") - F.log2("at")) <= 0.25
    near = seen.select("*", F.explode(F.array(*map(F.lit, AT))).alias("at")).where(octave)
    lows = near.groupBy("lang", "at").agg(F.count("*").alias("n"), F.percentile("token_entropy", 0.002).alias("low")).where(F.col("n") >= LEAST).collect()
    own = {(r["lang"], r["at"]): r["low"] - float(np.interp(np.log2(r["at"]), (4, 8), (ENTROPY_SHORT, ENTROPY_LONG))) for r in lows}
    out = {}
    for r in edges:
        floors = []
        for at in AT:
            others = [v for (_, a), v in own.items() if a == at]
            if others:
                floors.append((at, round(own.get((r["lang"], at), min(others)), 2)))
        out[r["lang"]] = Band(round(r["chars"][0] - CHARS_DOWN, 2), round(r["chars"][1] + CHARS_UP, 2), round(r["bytes"] + BYTES_UP, 2), tuple(floors))
    return out
