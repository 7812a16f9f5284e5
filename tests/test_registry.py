"""Reducers that are added: dispatched by the engine, called from SQL, their savings estimated."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import registry as G
from quillspark.plans import engine


def first_rows():
    """A class that no worker can import, as one from a notebook."""

    class FirstRows:
        """Of a table of values its head and first rows, and how many more there were."""

        def __init__(self):
            self.n = 0

        def line(self, line):
            self.n += 1
            if self.n <= 3:
                yield line

        def end(self):
            if self.n > 3:
                yield f"({self.n - 3} more rows)"

    return FirstRows


FirstRows = first_rows()


def looks_like_csv(text):
    return F.when(text.startswith("id,name,"), 0.97).otherwise(0.0)


@pytest.fixture(scope="module")
def csv():
    return G.by_lines("csv", looks_like_csv, FirstRows, klass="table")


TABLE = "id,name,value\n" + "\n".join(f"{k},name {k},{k * k}" for k in range(200))
TRACE = "TypeError: x is undefined\n" + "\n".join(["    at load (/srv/app/src/user.ts:4:9)"] * 60)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, TABLE), (2, TRACE), (3, "hello there"), (4, "id,name,x\n1,a,b"), (5, ""), (None, TABLE)], "id long, text string")


def test_an_added_reducer_is_dispatched(spark, texts, csv):
    more = G.DEFAULT.with_reducer(csv)
    ids = texts.where("id is not null")
    piped = {r.id: r for r in engine.pipe(ids, more).collect()}
    assert piped[1].kind == "csv" and piped[1].output.split("\n")[:4] == [*TABLE.split("\n")[:3], "(198 more rows)"]
    assert piped[2].kind == "stack_trace" and piped[3].output == "hello there" and piped[4].kind is None and piped[5].output == ""
    found = {r.id: r for r in engine.intercept(ids, more).collect()}
    assert found[1]["class"] == "table" and found[1].output == piped[1].output and found[1].after_tokens < found[1].before_tokens / 10
    plain = {r.id: r.kind for r in engine.pipe(ids).collect()}
    assert "csv" not in plain.values() and plain[2] == "stack_trace"
    assert {r.id: r.kind for r in engine.pipe(ids, G.DEFAULT.without("stack_trace")).collect()}[2] is None
    assert G.DEFAULT.kinds == ["stack_trace", "test_log", "build_log", "lint_output", "json", "config"] and more.kinds[-1] == "csv"


def test_a_reducer_is_called_from_sql(spark, texts):
    """Over lines out of order and in many partitions, with an id of any type."""
    G.register(spark, "first_rows", FirstRows)
    lines = texts.select(F.col("id").cast("string").alias("id"), F.posexplode(F.split("text", "\n")).alias("n", "line")).orderBy(F.desc("n")).repartition(7)
    lines.createOrReplaceTempView("lines_of_texts")
    got = spark.sql("SELECT id, n, line FROM first_rows(TABLE(lines_of_texts)) WHERE id = '1' ORDER BY n").collect()
    assert [(r.id, r.n, r.line) for r in got] == [("1", k, x) for k, x in enumerate([*TABLE.split("\n")[:3], "(198 more rows)"])]
    assert spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM lines_of_texts WHERE false))").count() == 0
    with pytest.raises(Exception, match="id, n and line"):
        spark.sql("SELECT * FROM first_rows(TABLE(SELECT id, line FROM lines_of_texts))").collect()


def test_savings_are_estimated(texts, csv):
    got = {r.id: r for r in csv.estimate_savings(texts.where("id is not null")).collect()}
    assert got[1].reduction_tokens == got[1].before_tokens - got[1].after_tokens > 0 and 0.9 < got[1].reduction_ratio < 1
    assert got[3].reduction_tokens == 0 and got[5].before_tokens == 0 and got[5].reduction_ratio == 0
