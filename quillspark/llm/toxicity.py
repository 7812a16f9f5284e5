"""Toxicity: cumulative-link ordinal regression over sparse text features.

Severity has ordered grades 0 (clean) to 3.  The model is
P(grade > k | x) = sigmoid(w.x - t_k) with one weight vector and ascending
thresholds t_0 <= t_1 <= t_2; the output is the expected severity, the sum of
these over k.

Features are words and word beginnings (4 to 8 letters, so that inflected and
compound insults share one), each with log(1 + count).  Labels say toxic or
not, so grades above 0 are derived: a toxic training text's grade is the third
in which its number of sure toxic words falls among the toxic texts.

Fitting uses a bounded sample of labelled rows (`max_toxic` and `max_clean`,
chosen by a hash of the id); scoring covers every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded
from .store import discard, materialize

WORD = re.compile(r"[^\W\d_]+")
GRADES = 4
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)


def features_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [30.0] * (GRADES - 1))

    def expected(self, score: np.ndarray) -> np.ndarray:
        z = np.clip(score[:, None] - np.array(self.thresholds)[None, :], -40, 40)
        return (1 / (1 + np.exp(-z))).sum(1)


class Scorer:
    """w.x of texts; a word's features are looked up once while it stays in the memo."""

    def __init__(self, vocabulary, memo_words: int = 200_000):
        self.vocabulary, self.memo, self.memo_words = vocabulary, {}, memo_words

    def found(self, text: str) -> Counter:
        """Counts of the vocabulary's features in a text."""
        memo, out = self.memo, Counter()
        for word, n in Counter(WORD.findall(text.lower())).items():
            hits = memo.get(word)
            if hits is None:
                if len(memo) >= self.memo_words:
                    memo.clear()
                hits = memo[word] = tuple(f for f in features_of(word) if f in self.vocabulary)
            for f in hits:
                out[f] += n
        return out


def fit_ordinal(rows: list[list[int]], values: list[list[float]], grades: np.ndarray, n_features: int, l1: float = 1e-4, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by projected Adam on the mean log-likelihood, toxic and clean texts weighted alike.

    Features were chosen as signs of toxicity, so weights stay at zero or above;
    the l1 penalty leaves chance companions of such signs at zero.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    val = np.array([v for r in values for v in r])
    n = len(grades)
    toxic = grades > 0
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    w, base, gaps = np.zeros(n_features), np.array([2.0]), np.zeros(GRADES - 2)
    m = [np.zeros_like(x) for x in (w, base, gaps)]
    v = [np.zeros_like(x) for x in (w, base, gaps)]
    for step in range(1, steps + 1):
        width = np.exp(gaps)
        t = np.concatenate((base, base + np.cumsum(width)))
        s = np.bincount(owner, val * w[col], n)
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -40, 40)))  # P(grade > k)
        full = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), 1)
        slope = np.concatenate((np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))), 1)
        at = np.arange(n)
        p = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        ds = -weight * (slope[at, grades] - slope[at, grades + 1]) / p
        dt = np.zeros(GRADES + 1)
        np.add.at(dt, grades, weight * slope[at, grades] / p)
        np.add.at(dt, grades + 1, -weight * slope[at, grades + 1] / p)
        dt = dt[1:GRADES]
        grad = [np.bincount(col, val * ds[owner], n_features) + l1, np.array([dt.sum()]), np.array([dt[k + 1 :].sum() for k in range(GRADES - 2)]) * width]
        for k, (x, g) in enumerate(zip((w, base, gaps), grad, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x -= 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        np.maximum(w, 0, out=w)
    return w, np.concatenate((base, base + np.cumsum(np.exp(gaps))))


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(text, toxic) of the sampled labelled ids, one row each, written; the broadcast side has at most max_toxic + max_clean rows."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(5), F.col("doc_id"))
    pick = lambda t, n: known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n)
    chosen = pick(1, max_toxic).unionByName(pick(0, max_clean))
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic"), "sample")


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 12000, min_toxic_docs: int = 5, min_toxic_share: float = 1 / 150) -> OrdinalModel:
    """Fits on at most max_toxic + max_clean labelled documents; without labels, or without a sure feature, nothing is toxic.

    A feature occurs in at least min_toxic_docs and min_toxic_share of the
    toxic texts, so the bounded sample bounds the vocabulary.  Of repeated ids
    the smallest text is taken; null ids and texts take no part.
    """
    sample = _sample(docs, labels, max_toxic, max_clean)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            sides = [Counter(), Counter()]
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                sides[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
                sides[toxic][""] += 1
            for side, counts in enumerate(sides):
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values() if side else [0] * n, pa.int64()), pa.array([0] * n if side else counts.values(), pa.int64())], names=["f", "a", "b"])

    counts = sample.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counts.where("f = ''").first()
    if total is None or not total["a"] or not total["b"]:
        return OrdinalModel()
    na, nb = total["a"], total["b"]
    least = max(min_toxic_docs, int(na * min_toxic_share))
    # log odds against the clean texts, less twice its standard error
    odds = F.log((F.col("a") + 0.5) / (na - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (nb - F.col("b") + 0.5))
    sure = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = counts.where((F.col("f") != "") & (F.col("a") >= least) & (sure > 1)).orderBy(F.desc(sure), "f").select("f").collect()
    names = [r["f"] for r in chosen]
    if not names:
        return OrdinalModel()
    number = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(number)
        for batch in bounded(batches, "text"):
            found = [scorer.found(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[number[f] for f in x] for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64())), batch.column("toxic")],
                names=["col", "n", "toxic"],
            )

    got = sample.mapInArrow(rows, "col array<int>, n array<long>, toxic int").collect()
    discard(sample)
    toxic = np.array([r["toxic"] for r in got])
    hits = np.array([sum(n for c, n in zip(r["col"], r["n"], strict=True) if not names[c].endswith("*")) for r in got])
    cuts = np.quantile(hits[toxic > 0], [1 / 3, 2 / 3])
    grades = np.where(toxic > 0, 1 + np.searchsorted(cuts, hits, "left"), 0)
    w, t = fit_ordinal([r["col"] for r in got], [np.log1p(r["n"]).tolist() for r in got], grades, len(names))
    return OrdinalModel({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, t.tolist())


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with expected_severity (0 to 3) and severity (its nearest grade).

    Null and empty texts have no features and score as such, the model's
    floor.  Every row is scored alone; an empty table gives an empty result;
    columns of docs with these two names are replaced.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("expected_severity", "severity")])
    names, weights = kept.columns, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in bounded(batches, text_col):
            s = np.array([sum(weights[f] * math.log1p(n) for f, n in scorer.found(t).items()) if t else 0.0 for t in batch.column(text_col).to_pylist()])
            e = model.expected(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(e), pa.array(np.rint(e).astype(np.int32))], names=[*names, "expected_severity", "severity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, expected_severity double, severity int")
