"""Reducers that can be added: what a kind of text is told by, how it is reduced, and what that saves.

A reducer is a detector column and a DataFrame operator; the engine's six make
up the default registry, and `pipe` and `intercept` take any other.  One that
must see a text line by line, with state of its own, is written as a small
class and becomes a table function that Spark partitions by text and orders by
line; SQL can call it by the name it is registered under:

    SELECT * FROM reduce_csv(TABLE(SELECT id, n, line FROM lines))
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import detect, tokens
from ..functions import text as X
from . import reduce as R


@dataclass(frozen=True)
class Reducer:
    """kind: its name; detect: a text's score, 0 to 1; reduce: (id, text) to (id, reduced, before_tokens, after_tokens); klass: the class its texts belong to."""

    kind: str
    detect: Callable[[Column], Column]
    reduce: Callable[[DataFrame], DataFrame]
    klass: str

    def estimate_savings(self, df: DataFrame) -> DataFrame:
        """(id, before_tokens, after_tokens, reduction_tokens, reduction_ratio) of texts (id, text), none below 0."""
        saved = F.greatest(F.col("before_tokens") - F.col("after_tokens"), F.lit(0))
        ratio = R.reduction_ratio(F.col("before_tokens"), F.col("after_tokens"))
        return self.reduce(df).select("id", "before_tokens", "after_tokens", saved.alias("reduction_tokens"), ratio.alias("reduction_ratio"))


class Registry:
    """Reducers by kind, in order: of equal scores the later one's kind wins."""

    def __init__(self, reducers: Iterable[Reducer] = ()):
        self._reducers = {r.kind: r for r in reducers}

    def with_reducer(self, reducer: Reducer) -> Registry:
        """A registry with one more, or with another one of that kind in its place."""
        return Registry((self._reducers | {reducer.kind: reducer}).values())

    def without(self, kind: str) -> Registry:
        return Registry(r for r in self._reducers.values() if r.kind != kind)

    @property
    def kinds(self) -> list[str]:
        return list(self._reducers)

    @property
    def classes(self) -> dict[str, str]:
        return {r.kind: r.klass for r in self._reducers.values()}

    @property
    def operators(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return {r.kind: r.reduce for r in self._reducers.values()}

    def __getitem__(self, kind: str) -> Reducer:
        return self._reducers[kind]

    def scores(self, text: Column, config: Column | None = None) -> Column:
        """struct of every kind's score; config in place of the configuration detector's, if given."""
        given = {"config": config} if config is not None else {}
        return F.struct(*[given.get(k, r.detect(text)).cast("float").alias(k) for k, r in self._reducers.items()])


_DETECTORS = {"stack_trace": detect.stack_trace, "test_log": detect.test_log, "build_log": detect.build_log, "lint_output": detect.lint_output, "json": detect.json, "config": detect.ini}
#: The engine's own.
DEFAULT = Registry(Reducer(k, _DETECTORS[k], R.REDUCERS[k], detect.CLASS_OF[k]) for k in detect.KINDS)


class Lines(Protocol):
    """The state of one text: line gives what comes out for a line, end what comes out after the last."""

    def line(self, line: str) -> Iterable[str]: ...

    def end(self) -> Iterable[str]: ...


def table_function(make: Callable[[], Lines]):
    """A table function over lines (id, n, line): (id, n, line) of what is kept, in order, whatever the type of id.

    Spark brings the lines of a text together in order of n; the function holds
    one text's state.
    """

    class Reduce:
        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(lines.dataType, T.StructType) or not {"id", "n", "line"} <= set(lines.dataType.names):
                raise ValueError("a table with the columns id, n and line is needed")
            out = T.StructType([T.StructField("id", lines.dataType["id"].dataType), T.StructField("n", T.IntegerType()), T.StructField("line", T.StringType())])
            return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("id")], orderBy=[OrderingColumn("n")])

        def __init__(self):
            self.state, self.id, self.n = make(), None, 0

        def _out(self, kept: Iterable[str]):
            for x in kept:
                yield self.id, self.n, x
                self.n += 1

        def eval(self, row):
            self.id = row["id"]
            yield from self._out(self.state.line(row["line"]))

        def terminate(self):
            yield from self._out(self.state.end())

    return F.udtf(Reduce)


def by_lines(kind: str, detector: Callable[[Column], Column], make: Callable[[], Lines], klass: str = "unknown") -> Reducer:
    """A reducer of texts line by line; what is kept is joined again, and protected values that were lost are put behind it."""
    function = table_function(make)

    def reduce(df: DataFrame) -> DataFrame:
        lines = df.select("id", F.posexplode(X.lines(F.col("text"))).alias("n", "line"))
        kept = function(lines.asTable())
        joined = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("kept"))
        out = df.join(joined, "id", "left").withColumn("reduced", R.append_missing(F.col("text"), F.coalesce("kept", F.lit(""))))
        return out.select("id", "text", "reduced", tokens.estimated(F.col("text")).alias("before_tokens"), tokens.estimated(F.col("reduced")).alias("after_tokens"))

    return Reducer(kind, detector, reduce, klass)


def register(spark: SparkSession, name: str, make: Callable[[], Lines]) -> None:
    """Makes a line reducer a table function of that name in SQL."""
    spark.udtf.register(name, table_function(make))
