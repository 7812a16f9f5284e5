"""The stored index: lookups read buckets, hot keys are split, a failed build leaves the old one."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import codegraph as G
from quillspark.operators import index as I
from quillspark.sources.publish import current

SOURCES = {
    "src/store.py": "import os\nfrom lib.parse import x\n\ndef open_store():\n    pass\n\nclass Store:\n    pass\n",
    "src/parse.py": "import src.store\n\ndef parse_all():\n    pass\n",
    "src/İx.py": "def STORE_İ():\n    pass\n",
    "lib/parse.py": "import os\nimport os\n\ndef parse_one():\n    pass\n",
    "README.md": "no code",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    rows = [*SOURCES.items(), *[(f"many/f{k:04d}.py", "import os\n\ndef main():\n    pass\n") for k in range(3000)]]
    files = spark.createDataFrame(rows, "path string, content string").repartition(4)
    return I.build(files, root, buckets=8), files, root


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_find(built):
    stored, _, _ = built
    assert [r[1:4] for r in rows(stored.find("Store"))] == [("Store", "src/store.py", 7)]
    assert [r[1] for r in rows(stored.find("PARSE"))] == ["parse_all", "parse_one"]
    assert [r[1] for r in rows(stored.find("e"))] == ["STORE_", "Store", "open_store", "parse_all", "parse_one"]
    assert [r[1] for r in rows(stored.find("store"))]== ["STORE_", "Store", "open_store"] and rows(stored.find("zzz")) == rows(stored.find("")) == []
    assert len(rows(stored.find("main"))) == I.EXACT and {r[5] for r in rows(stored.find("main"))} == set(range(1, 11))


def test_deps(built):
    stored, _, _ = built
    found = {}
    for path, relation, place, value in rows(stored.deps("lib/parse.py")):
        found.setdefault(relation, []).append((place, value))
    assert found == {"import": [(1, "os")], "importer": [(1, "src/store.py")]}
    assert [r[3] for r in rows(stored.deps("src/store.py")) if r[1] == "neighbour"] == ["src/parse.py", "src/İx.py"]
    assert len([r for r in rows(stored.deps("many/f0007.py")) if r[1] == "neighbour"]) == I.SHOWN and rows(stored.deps("x/none.py")) == []


def test_many_importers_come_in_pages(built):
    stored, _, _ = built
    first = [r.path for r in stored.importers("os").collect()]
    second = [r.path for r in stored.importers("os", after=first[-1]).collect()]
    assert len(first) == len(second) == 100 and first == sorted(first) and first[-1] < second[0]


def test_lookups_read_their_buckets_alone(spark, built, capsys):
    stored, _, root = built
    for lookup in (stored.at("symbols", ["Store"]), stored.at("imports", ["src/store.py"]), stored.at("grams", ["sto", "tor"])):
        plan = lookup._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo", plan)
        tables = stored.table("symbols").inputFiles()
        assert all(f.startswith(f"file://{root}/") or f.startswith(f"file:{root}/") for f in lookup.inputFiles()) and tables
    # the scan lists only the named buckets' files
    scan = stored.at("symbols", ["Store"])
    scan.collect()
    nodes = scan._jdf.queryExecution().executedPlan().collectLeaves()
    number = [nodes.apply(k).metrics().apply("numPartitions").value() for k in range(nodes.size())]
    assert number == [1]


def test_a_hot_key_lies_in_many_files(spark, built):
    """3,000 importers of one module, in one bucket, are written by several tasks once there are several partitions."""
    stored, files, root = built
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = I.build(files, f"{root}/hot", buckets=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = f"{root}/hot/{again.version}/importers_of_module"
    assert max(sum(n.endswith(".parquet") for n in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith(I.BUCKET)) > 1


def test_a_failed_build_leaves_the_old_one(spark, built):
    _, files, root = built
    at = f"{root}/again"
    before = I.build(files.where("path like 'src/%'"), at, buckets=4)
    broken = files.withColumn("content", F.when(F.col("path") == "src/store.py", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        I.build(broken, at, buckets=4)
    assert current(spark, at) == [before.version, "4"] and len(rows(I.Index(spark, at).find("Store"))) == 1
    after = I.build(files, at, buckets=2)
    assert after.version != before.version and not os.path.exists(f"{at}/{before.version}") and len(rows(I.Index(spark, at).find("main"))) == 10


def test_an_empty_index_finds_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.Index(spark, str(tmp_path))
    stored = I.build(spark.createDataFrame([], "path string, content string"), str(tmp_path / "i"))
    assert rows(stored.find("x")) == rows(stored.deps("a/b.py")) == [] and rows(stored.inspect()) == [(0, 0, 0, 0)]


def test_inspect_counts_the_graph(built):
    stored, files, _ = built
    assert rows(stored.inspect())[0][2:] == (G.symbols(files).count(), G.imports(files).count()) and rows(stored.inspect())[0][0] == files.count()
