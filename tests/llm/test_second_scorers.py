"""Toxicity and quality verdicts computed a second way, and the bands from labels."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import bands, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def severity(model, text):
    """From the weights alone: words and their beginnings of 4 to 8 letters."""
    words = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
    counts = Counter()
    for w, n in words.items():
        counts[w] += n
        for k in range(4, 9):
            if len(w) > k:
                counts[w[:k] + "*"] += n
    score = math.fsum(model.weights[f] * math.log1p(n) for f, n in counts.items() if f in model.weights)
    return math.fsum(1 / (1 + math.exp(-max(-40, min(40, score - t)))) for t in model.thresholds)


def test_expected_severity_by_a_second_scorer(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert len(model.weights) > 5 and model.thresholds == sorted(model.thresholds)
    got = rows(toxicity.score(docs.select("doc_id", "text"), model))
    assert len(got) == docs.count()
    for r in got:
        want = severity(model, r["text"])
        assert r["expected_severity"] == pytest.approx(want, abs=1e-9) and r["severity"] == round(r["expected_severity"])
    assert {r["severity"] for r in got} >= {0, 1}


def test_a_severity_of_exactly_the_limit_is_rejected(spark):
    model = toxicity.OrdinalModel({}, [0.0, 40.0, 40.0])
    df = spark.createDataFrame([(1, "any"), (2, ""), (3, None)], "doc_id long, text string")
    got = toxicity.score(df, model)
    assert {r["expected_severity"] for r in rows(got)} == {queries.TOXIC_FROM}
    assert got.where(F.col("expected_severity") < queries.TOXIC_FROM).count() == 0


def verdict(model, r):
    text = r["text"] or ""
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return True, False
    pieces = model.encode(text, out_type=str)
    n = len(pieces)
    chars = sum(map(len, words)) / n
    share = sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) for p in pieces) / n
    entropy = math.log2(n) - math.fsum(c * math.log2(c) for c in Counter(pieces).values()) / n
    band = quality.LANGUAGE_BANDS.get(r["lang"]) or quality.SCRIPT_BANDS["latin"]
    at = band.entropy_low
    if n < at[0][0]:
        floor = 0.0
    elif n >= at[-1][0]:
        floor = at[-1][1]
    else:
        (a, low), (b, high) = next((x, y) for x, y in zip(at, at[1:], strict=False) if x[0] <= n < y[0])
        floor = low + (high - low) * math.log2(n / a) / math.log2(b / a)
    return False, band.chars_low <= chars <= band.chars_high and share <= band.bytes_high and entropy >= floor - 1e-12


def test_quality_verdicts_by_a_second_scorer(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10_000 + k, t, "en") for k, t in enumerate(["### $$$ %%% " * 40, " | ".join(["word"] * 60), "ab cd " * 50, "one two three four five six seven eight nine ten"])]
    docs = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    got = rows(quality.judge_quality(docs, queries.tokenizer_path("piece_bpe_32k.model")))
    for r in got:
        assert (r["base_failed"], r["kept"]) == verdict(model, r), r["doc_id"]
    assert {r["kept"] for r in got} == {True, False}


def test_bands_come_from_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fitted = bands.fit_bands(docs, labels, queries.tokenizer_path("piece_bpe_32k.model"))
    assert set(fitted) == set(quality.LANGUAGE_BANDS)
    for lang, band in fitted.items():
        typed = quality.LANGUAGE_BANDS[lang]
        assert (band.chars_low, band.chars_high, band.bytes_high) == (typed.chars_low, typed.chars_high, typed.bytes_high)
        at = dict(band.entropy_low)
        assert all(abs(at[n] - low) <= 0.1 for n, low in typed.entropy_low if 384 <= n <= 4096)
    none = bands.fit_bands(docs.limit(0), labels, queries.tokenizer_path("piece_bpe_32k.model"))
    assert none == {}
