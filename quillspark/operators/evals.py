"""Evaluation: retrieval metrics, summary statistics, paired comparisons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import kept


def precision_at(predicted: Column, expected: Column, k: int) -> Column:
    """Hits in the first k, a repeated prediction counted each time, over min(k, predictions); 0 without predictions."""
    hits = F.size(F.filter(F.slice(predicted, 1, k), lambda x: F.array_contains(expected, x)))
    return F.when(F.size(predicted) == 0, F.lit(0.0)).otherwise(hits / F.least(F.lit(k), F.size(predicted)))


def recall_at(predicted: Column, expected: Column, k: int) -> Column:
    top = F.slice(predicted, 1, k)
    hits = F.size(F.filter(expected, lambda x: F.array_contains(top, x)))
    return F.when(F.size(expected) == 0, F.lit(0.0)).otherwise(hits / F.size(expected))


def reciprocal_rank(predicted: Column, expected: Column) -> Column:
    """Of the first hit in the whole list; 0 without one."""
    at = F.array_min(F.filter(F.transform(predicted, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda i: i.isNotNull()))
    return F.when(at.isNull(), F.lit(0.0)).otherwise(1 / at)


def scored(runs: DataFrame, k: int = 3) -> DataFrame:
    """runs(id, method, predicted, expected) with p, r, rr and covered."""
    p, e = F.col("predicted"), F.col("expected")
    return runs.withColumns({"p": precision_at(p, e, k), "r": recall_at(p, e, k), "rr": reciprocal_rank(p, e), "covered": (F.size(F.array_intersect(p, e)) > 0)})


def summary(rows: DataFrame) -> DataFrame:
    """Means per method: precision, recall, mrr, coverage, top1."""
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("rr").alias("mrr"), share(F.col("covered")).alias("coverage"), share(F.col("rr") == 1).alias("top1"))


def lift(table: DataFrame, baseline: str) -> DataFrame:
    """Each method's difference to the baseline's mrr and precision; the baseline is one row."""
    b = table.where(F.col("method") == baseline).select(F.col("mrr").alias("b_mrr"), F.col("precision").alias("b_precision"))
    return table.join(F.broadcast(b)).select("method", (F.col("mrr") - F.col("b_mrr")).alias("mrr_lift"), (F.col("precision") - F.col("b_precision")).alias("precision_lift"))


def replay(reads: DataFrame) -> DataFrame:
    """reads(id, place, cost, hit): tokens read up to the first hit, or all of them without one."""
    w = Window.partitionBy("id")
    to = reads.withColumn("first", F.min(F.when(F.col("hit"), F.col("place"))).over(w)).where("first is null or place <= first")
    return to.groupBy("id").agg(F.sum("cost").alias("tokens"), F.count("*").alias("reads"), F.max(F.col("first").isNotNull()).alias("found"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The element at position n div 2 of the sorted values, as one row.

    Positions come from counts per value, so rows are not ordered in one task.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("c"))
    ranked = counts.withColumns({"upto": F.sum("c").over(Window.orderBy(value)), "n": F.sum("c").over(Window.partitionBy())})
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min(value).alias("upper_median"))


def described(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 under two rows), p50, p95 and p99 with linear interpolation."""
    pct = {f"p{int(q * 100)}": F.percentile(value, F.lit(q)) for q in (0.5, 0.95, 0.99)}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), *[c.alias(k) for k, c in pct.items()])


Z = 1.959963984540054


def wilson(hits: Column, n: Column) -> Column:
    """struct(low, high) of the 95 % score interval; zeros without trials."""
    p = hits / n
    mid, width = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = (mid - width) / (1 + Z * Z / n), (mid + width) / (1 + Z * Z / n)
    none = n == 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), low)).alias("low"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), high)).alias("high"))


def numbered(rows: DataFrame, group: list[str], order: list[str], place: str = "place") -> DataFrame:
    """rows with their place from 1 in the group, in this order.

    Rows are dealt by range of group and order, numbered within each range, and
    the ranges before give the base; so one group of most rows is numbered by
    many tasks.  Equal rows are numbered in any order.
    """
    ranges = kept(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranges.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    out = ranges.withColumn("_within", within).join(bases, same).withColumn(place, F.col("_base") + F.col("_within"))
    return out.select(*rows.columns, place)


def paired(rows: DataFrame, group: list[str], arm: str, value: str, order: list[str], arms: tuple[str, str]) -> DataFrame:
    """Runs of two arms paired by their place in the group, up to the shorter one."""
    placed = numbered(rows, [*group, arm], order)
    a, b = (placed.where(F.col(arm) == x).select(*group, "place", F.col(value).alias(n)) for x, n in zip(arms, ("a", "b"), strict=True))
    return a.join(b, [*group, "place"])


def _beta_continued(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + n * d, 1 + n / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_continued(b, a, 1 - x) / b


def t_test_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def _p_value(t, n):
    return (t.combine(n, lambda x, k: t_test_p(x, k - 1) if k > 1 and math.isfinite(x) else float("nan"))).astype(float)


def paired_test(pairs: DataFrame) -> DataFrame:
    """n, mean difference, t, p, Cohen's d and its label, wins, of pairs(a, b); one row, so the Python p-value sees one row."""
    d = F.col("a") - F.col("b")
    out = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.count_if(d > 0).alias("wins"))
    out = out.withColumn("t", F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).withColumn("cohen_d", F.col("mean_diff") / F.col("sd"))
    size = F.abs("cohen_d")
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return out.withColumn("effect", label).withColumn("p", _p_value("t", "n"))


#: Draws a worker makes at once, and from how many copies on a row's weight is drawn directly.
_DRAWS, _HEAVY = 1 << 20, 16


def _resampled_sums(rows: DataFrame, columns: list[str], resamples: int, seed: int) -> DataFrame:
    """(b, n, s0, s1, ...): the number of rows drawn into each resample b and the columns' sums over them.

    Rows get Poisson(1) weights, which stand for drawing with replacement.  Equal rows are counted first: together c copies weigh
    Poisson(c), so the work grows with the distinct rows and one value may hold most of the table.  Rows of few copies are drawn the
    other way round, a Poisson number of them at random, with the same law.  All columns of a row are drawn together, and only
    resamples leave the map side.  Rows with a null in a column are left out.
    """
    src = rows.select(*[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(columns)]).dropna()
    names = ["n", *src.columns]
    counted = src.groupBy(*src.columns).agg(F.count("*").alias("copies")).sortWithinPartitions(*src.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.SFC64((seed, TaskContext.get().partitionId())))
        out = np.zeros((len(names), resamples))
        for batch in batches:
            if not batch.num_rows:
                continue
            *values, copies = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            heavy = np.flatnonzero(copies >= _HEAVY)
            light = np.repeat(np.arange(len(copies)), np.where(copies < _HEAVY, copies, 0))
            n = len(light)
            step = max(1, _DRAWS // max(n, len(heavy)))
            for lo in range(0, resamples, step):
                size = min(step, resamples - lo)
                weights = rng.poisson(copies[heavy], (size, len(heavy))).astype(float)
                out[0, lo : lo + size] += weights.sum(1)
                for i, v in enumerate(values, 1):
                    out[i, lo : lo + size] += weights @ v[heavy]
                drawn = rng.poisson(n, size)
                some = np.flatnonzero(drawn)
                if not len(some):
                    continue
                at = light[rng.integers(0, n, int(drawn.sum()), dtype=np.int32)]
                starts = (np.cumsum(drawn) - drawn)[some]
                out[0, lo + some] += drawn[some]
                for i, v in enumerate(values, 1):
                    out[i, lo + some] += np.add.reduceat(v[at], starts)
        if out[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, resamples + 1)), *[pa.array(x) for x in out]], names=["b", *names])

    sums = counted.mapInArrow(run, ", ".join(["b long", *[f"{c} double" for c in names]]))
    return sums.groupBy("b").agg(*[F.sum(c).alias(c) for c in names])


def _interval(statistics: DataFrame) -> DataFrame:
    return statistics.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_mean(rows: DataFrame, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile bootstrap interval of the mean."""
    return _interval(_resampled_sums(rows, [value], resamples, seed).select(F.try_divide("s0", "n").alias("m")))


def bootstrap_ratio(pairs: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile bootstrap interval of the saved share of the totals, (sum a - sum b) / sum a, over pairs(a, b) drawn whole; 0 where a sums to 0."""
    sums = _resampled_sums(pairs, ["a", "b"], resamples, seed)
    return _interval(sums.select(F.coalesce(F.try_divide(F.col("s0") - F.col("s1"), F.col("s0")), F.lit(0.0)).alias("m")))


def saved_percent(before: Column, after: Column) -> Column:
    """Whole percent, cut towards zero; negative for growth."""
    share = (before - after) * 100
    return F.when(before == 0, 0).otherwise(F.signum(share) * F.floor(F.abs(share) / before)).cast("int")


def retention(kept: Column, required: Column) -> Column:
    """Share of required values that are in the kept text; 1 if none is required."""
    return F.when(F.size(required) == 0, F.lit(1.0)).otherwise(F.size(F.filter(required, lambda x: kept.contains(x))) / F.size(required))


#: What a compaction must carry on, by list and by single value; and those of them that decide whether it passed.
CARRIED = ("decisions", "failed_approaches", "modified_files", "next_actions", "pinned_facts")
SINGLE = ("current_subtask", "latest_decision")
DECISIVE = ("pinned_facts", "current_subtask", "latest_decision", "modified_files")


def compaction_scores(cases: DataFrame) -> DataFrame:
    """cases (columns of CARRIED as arrays, of SINGLE as strings, output, packet_tokens, max_tokens) with <name>_retention each, and passed.

    Null lists and values, and empty values, require nothing; a null output holds nothing.
    """
    out = F.coalesce("output", F.lit(""))
    none = F.array().cast("array<string>")
    kept = {c: retention(out, F.coalesce(c, none)) for c in CARRIED}
    kept |= {c: F.when((F.coalesce(c, F.lit("")) == "") | out.contains(F.col(c)), 1.0).otherwise(0.0) for c in SINGLE}
    scored = cases.withColumns({f"{c}_retention": x for c, x in kept.items()})
    passed = F.col("packet_tokens") <= F.col("max_tokens")
    for c in DECISIVE:
        passed = passed & (F.col(f"{c}_retention") == 1.0)
    return scored.withColumn("passed", passed)


#: Endings of source files, and subjects that say nothing.
SOURCE_ENDINGS = [".py", ".rs", ".js", ".ts", ".tsx", ".jsx", ".go", ".mjs", ".cjs"]
SKIPPED_SUBJECTS = [r"^\s*v?\d+\.\d+(\.\d+)?(\s|$)", r"(?i)^\s*release\b", r"(?i)^\s*bump\b", r"(?i)^\s*merge\b", r"(?i)^\s*revert\b", r"(?i)^\s*wip\b", r"(?i)^\s*fixup!", r"(?i)^\s*squash!"]


def commits_to_replay(commits: DataFrame, files: DataFrame, least: int = 15, most_files: int = 5) -> DataFrame:
    """(sha, subject, expected) of commits(sha, message, paths) that can be asked back: a telling subject, and 1 to most_files source files that exist.

    The subject is the message's first line, trimmed; expected are the existing
    source files, sorted.  files(path) are those that exist.
    """
    subject = F.trim(F.element_at(F.split("message", "\n", 2), 1))
    told = commits.select("sha", subject.alias("subject"), "paths").where(F.length("subject") >= least)
    for p in SKIPPED_SUBJECTS:
        told = told.where(~F.col("subject").rlike(p))
    ends = F.lit(False)
    for e in SOURCE_ENDINGS:
        ends = ends | F.col("path").endswith(e)
    touched = told.select("sha", "subject", F.explode(F.array_distinct("paths")).alias("path")).where(ends)
    found = touched.join(files.select("path").distinct(), "path", "left_semi")
    out = found.groupBy("sha", "subject").agg(F.array_sort(F.collect_list("path")).alias("expected"))
    return out.where(F.size("expected") <= most_files)
