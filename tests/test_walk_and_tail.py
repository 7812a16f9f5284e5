"""Trees walked by level, reading survivors alone; growing files read once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import codegraph as G
from quillspark.sources import readers, tail, walk

EXTENSIONS = ["py", "ts", "go"]


@pytest.fixture
def tree(tmp_path):
    kept = ["a.py", "src/b.ts", "src/deep/er/c.go", "src/target.py", "vendored/x.py", "src/a b/ü.py"]
    left_out = ["node_modules/x/y.py", "vendor/v.go", "venv/lib/m.py", "__pycache__/p.py", "bower_components/q.ts", "autocontext_fixture_1/f.py", "src/.hidden/h.py", ".dot.py", "src/.d.ts", "src/readme.md", "noext", "src/deep/target/t.py"]
    for name in kept + left_out:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    for name in ("node_modules/pipe.py", "src/pipe.md", "vendor/pipe.go"):
        os.mkfifo(tmp_path / name)  # whoever opens one of these waits for ever
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    return tmp_path, kept


def test_the_walk_reads_survivors_alone(spark, tree):
    root, kept = tree
    found = {r.path: r for r in walk.code_files(spark, str(root), EXTENSIONS).collect()}
    assert sorted(found) == sorted(kept) and all(r.content == f"# {p}\n" for p, r in found.items())
    assert all(abs(r.mtime.timestamp() - os.stat(root / p).st_mtime) < 1 for p, r in found.items())
    assert sorted(r.path for r in walk.code_files(spark, f"file://{root}", EXTENSIONS).select("path").collect()) == sorted(kept)
    graph = G.symbols(walk.code_files(spark, str(root), EXTENSIONS))
    assert graph.count() == 0


def test_the_walk_lists_an_excluded_folder_never(spark, tmp_path):
    """A large excluded folder costs nothing: what the tasks list is counted in the levels they write."""
    for k in range(300):
        (tmp_path / "node_modules" / f"m{k}").mkdir(parents=True)
        (tmp_path / "node_modules" / f"m{k}" / "i.py").write_text("x")
    for k in range(150):
        (tmp_path / "src" / f"p{k}").mkdir(parents=True)
        (tmp_path / "src" / f"p{k}" / "m.py").write_text("x = 1\n")
    found = walk.walk(spark, str(tmp_path), walk.GRAPH_EXCLUDED, walk.GRAPH_PREFIXES, EXTENSIONS)
    base = found.inputFiles()[0].split("/level=")[0]
    levels = spark.read.parquet(base)
    assert levels.count() == 1 + 150 + 150 and {r.level for r in levels.select("level").distinct().collect()} == {0, 1, 2} and found.count() == 150
    assert walk.contents(found, str(tmp_path), part_bytes=300).rdd.getNumPartitions() == 3


def test_the_walk_of_nothing(spark, tmp_path):
    assert walk.code_files(spark, str(tmp_path / "none"), EXTENSIONS).count() == 0
    (tmp_path / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "empty.py").write_bytes(b"")
    got = {r.path: r.content for r in walk.code_files(spark, str(tmp_path), EXTENSIONS).collect()}
    assert got == {"bad.py": "x = '��'\n", "empty.py": ""}


def test_source_tree_keeps_its_rules(spark, tree):
    root, _ = tree
    paths = sorted(r.path for r in readers.source_tree(spark, str(root), extensions=["py", "md"]).collect())
    assert paths == sorted([".dot.py", "a.py", "src/target.py", "src/readme.md", "vendored/x.py", "src/a b/ü.py", "venv/lib/m.py", "__pycache__/p.py", "autocontext_fixture_1/f.py"])


def tailed(spark, folder, out, checkpoint, part_bytes=64):
    spark.dataSource.register(tail.AppendedLines)
    lines = spark.readStream.format("appended_lines").option("path", folder).option("part_bytes", str(part_bytes)).load()
    query = lines.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()


def test_appended_lines_come_once(spark, tmp_path):
    """Over three runs of one query: appended lines, a half-written last line, a new file, no news."""
    folder, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    (folder / "deep").mkdir(parents=True)
    a, b = folder / "a.jsonl", folder / "deep" / "b.jsonl"
    read = lambda: sorted((r.file, r.at, r.value) for r in spark.read.schema(tail.SCHEMA).json(out).collect())
    a.write_bytes(b'{"n": 1}\n{"n": 2}\r\n{"half": ')
    (folder / "no.txt").write_text("x\n")
    tailed(spark, str(folder), out, cp)
    assert read() == [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 9, '{"n": 2}')]
    with a.open("ab") as f:
        f.write(b'"now"}\n\n{"n": 4}\n' + b'{"long": "' + b"x" * 500 + b'"}\n')
    b.write_bytes(b"\xff not text\nlast")
    tailed(spark, str(folder), out, cp)
    tailed(spark, str(folder), out, cp)
    assert read() == [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 9, '{"n": 2}'), ("a.jsonl", 19, '{"half": "now"}'), ("a.jsonl", 35, ""), ("a.jsonl", 36, '{"n": 4}'), ("a.jsonl", 45, '{"long": "' + "x" * 500 + '"}'), ("deep/b.jsonl", 0, "� not text")]


def test_tailed_transcripts_give_their_usage(spark, tmp_path):
    folder, out = tmp_path / "t", str(tmp_path / "out")
    folder.mkdir()
    line = lambda n: json.dumps({"session_id": "s", "message": {"usage": {"input_tokens": n, "output_tokens": 1}}}) + "\n"
    (folder / "x.jsonl").write_text(line(3) + "{bad\n" + line(4))
    tailed(spark, str(folder), out, str(tmp_path / "cp"))
    rows = spark.read.schema(tail.SCHEMA).json(out).select(F.try_parse_json("value").alias("json")).where("json is not null")
    assert sorted(r.input for r in readers.transcript_usage(rows).collect()) == [3, 4]


def test_parts_cut_anywhere_lose_no_line(tmp_path):
    random.seed(1)
    path = tmp_path / "f"
    for _ in range(200):
        rows = [b"x" * random.randint(0, 9) for _ in range(random.randint(0, 12))]
        data = b"".join(r + b"\n" for r in rows) + b"y" * random.randint(0, 5)
        path.write_bytes(data)
        end = tail.whole_lines(str(path), 0, len(data))
        assert end == data.rfind(b"\n") + 1
        got = [v for p in tail.parts(str(path), "f", 0, end, random.randint(1, 11)) for _, _, v in tail.lines(p)]
        assert got == [r.decode() for r in rows]
