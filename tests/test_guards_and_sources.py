"""Boundaries of the guards, in batch and stream; sources and sinks."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import evals as V
from quillspark.operators import guards as G
from quillspark.operators import rank, reduce
from quillspark.plans import rank_queries
from quillspark.sources import readers, writers
from quillspark.streaming import guards as SG

START = dt.datetime(2024, 1, 1)


def events(spark, offsets):
    return spark.createDataFrame([(1, "k", i, START + dt.timedelta(seconds=s)) for i, s in enumerate(offsets)], "session long, call string, event_id long, ts timestamp")


def test_duplicate_boundary(spark):
    got = G.duplicate_calls(events(spark, [0, 599, 1199, 1799, 2400]), ["session", "call"]).orderBy("event_id").collect()
    assert [r.duplicate for r in got] == [False, True, False, False, False]


def test_loop_boundary(spark):
    got = G.loops(events(spark, [0, 1800, 3601, 5401, 5402, 5403, 5404, 5405, 5406, 5407, 5408]), ["session", "call"]).orderBy("event_id").collect()
    assert [r.edits for r in got] == [1, 2, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.action for r in got][6] == "warn" and [r.action for r in got][9:] == ["block", "block"]


def _streamed(spark, tmp_path, offsets, make, **rename):
    src = str(tmp_path / "in")
    events(spark, offsets).withColumnsRenamed(rename).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = make(stream).writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(q.name).orderBy("event_id").collect()


def test_duplicate_stream_equals_batch(spark, tmp_path):
    offsets = [0, 599, 1199, 1799, 2398, 9000]
    got = [r.duplicate for r in _streamed(spark, tmp_path, offsets, SG.duplicate_stream)]
    assert got == [r.duplicate for r in G.duplicate_calls(events(spark, offsets), ["session", "call"]).orderBy("event_id").collect()]


def test_loop_stream_equals_batch(spark, tmp_path):
    offsets = [0, 1800, 3601, 3602, 3603, 3604, 3605, 3606, 3607, 3608]
    got = [(r.edits, r.action) for r in _streamed(spark, tmp_path, offsets, SG.loop_stream, call="file")]
    assert got == [(r.edits, r.action) for r in G.loops(events(spark, offsets), ["session", "call"]).orderBy("event_id").collect()]


def test_source_tree(spark, tmp_path):
    for name in ("src/a.py", "node_modules/x.js", ".git/config", "b.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert sorted(r.path for r in readers.source_tree(spark, str(tmp_path)).collect()) == ["b.md", "src/a.py"]
    assert [r.path for r in readers.source_tree(spark, str(tmp_path), extensions=["py"]).collect()] == ["src/a.py"]


def test_transcripts_skip_bad_lines(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text(json.dumps({"session_id": "s", "message": {"usage": {"input_tokens": 3, "output_tokens": 4}}}) + "\n{bad\n" + json.dumps({"message": {"content": "x"}}) + "\n")
    got = readers.transcript_usage(readers.json_lines(spark, str(f))).collect()
    assert [(r.session, r.input, r.output, r.cache_read) for r in got] == [("s", 3, 4, 0)]


def test_missing_graph_is_empty(spark, tmp_path):
    assert readers.json_or_empty(spark, str(tmp_path / "no.json"), "a long").count() == 0


def test_commit_log_and_manifests(spark):
    log = spark.createDataFrame([("\x02abc\x00Fix it\x00body\x03\nsrc/a.py\nb.py\n\x02def\x00Two\x00\x03\nc.py\n",)], "text string")
    assert [(r.sha, r.subject, r.path) for r in readers.commit_log(log).collect()] == [("abc", "Fix it", "src/a.py"), ("abc", "Fix it", "b.py"), ("def", "Two", "c.py")]
    pkg = spark.createDataFrame([("package.json", '{"dependencies": {"react": "18"}, "devDependencies": {"jest": "29"}}')], "path string, content string")
    assert {(r.name, r.kind) for r in readers.package_dependencies(pkg).collect()} == {("react", "dependencies"), ("jest", "devDependencies")}
    toml = spark.createDataFrame([("Cargo.toml", '[dependencies]\nserde = { version = "1.0" }\nlog = "0.4"\n'), ("bad.toml", "= =")], "path string, content string")
    assert {(r.name, r.version) for r in readers.toml_dependencies(toml).collect()} == {("serde", "1.0"), ("log", "0.4")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "2024-01-01T00:00:00", "json", 5, 3, 0), (2, "s", "1704067201", "json", 5, 3, 0)], "id long, session_id string, created_at string, kind string, before_tokens int, after_tokens int, latency_ms long")
    writers.append(rows.withColumn("created_at", writers.timestamp_of("created_at")), str(tmp_path), "transform_events")
    back = spark.read.parquet(f"{tmp_path}/transform_events")
    assert [r.id for r in G.recent(back, 1, ["id"]).collect()] == [2]
    writers.artifacts({"routes": spark.createDataFrame([("/", "a.tsx")], "route string, path string")}, str(tmp_path / "art"))
    assert spark.read.text(str(tmp_path / "art/routes/markdown")).first()[0] == "- / | a.tsx"


def test_statistics(spark):
    assert abs(V.t_test_p(2.228, 10) - 0.05) < 1e-3 and abs(V.t_test_p(0, 5) - 1) < 1e-12
    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("v"))
    b = V.bootstrap_mean(rows, "v", 300).first()
    assert b.low < 4.5 < b.high and b.high - b.low < 1.2


def test_bootstrap_draws_10000_resamples_of_values_and_pairs(spark, monkeypatch):
    taken, interval = [], V._interval
    monkeypatch.setattr(V, "_interval", lambda s: (taken.append(s.count()), interval(s))[1])
    r = rank_queries.QUERIES["bootstrap_intervals"](spark, "/root/testdata/sf0.01").first()
    assert taken == [10_000, 10_000] and r.low < r.high and r.ratio_low < r.ratio_high


def test_bootstrap_intervals(spark):
    v = np.random.default_rng(1).exponential(10, 400)
    df = spark.createDataFrame([*[(float(x), float(x) * (0.5 + 0.2 * (i % 3))) for i, x in enumerate(v)], (None, 1.0)], "a double, b double").repartition(3)
    rng, b = np.random.default_rng(2), v * (0.5 + 0.2 * (np.arange(400) % 3))
    at = rng.integers(0, 400, (10_000, 400))
    for got, m in ((V.bootstrap_mean(df, "a").first(), v[at].mean(1)), (V.bootstrap_ratio(df).first(), 1 - b[at].sum(1) / v[at].sum(1))):
        low, high = np.quantile(m, (0.025, 0.975))
        assert abs(got.low - low) < 0.06 * (high - low) and abs(got.high - high) < 0.06 * (high - low)
    # values of one copy, of a few and of thousands
    w = np.repeat([1.0, 2.0, 5.0, 40.0, 90.0], [3000, 200, 30, 5, 1])
    m = w[rng.integers(0, len(w), (10_000, len(w)))].mean(1)
    got, (low, high) = V.bootstrap_mean(spark.createDataFrame([(float(x),) for x in w], "a double").repartition(3), "a").first(), np.quantile(m, (0.025, 0.975))
    assert abs(got.low - low) < 0.06 * (high - low) and abs(got.high - high) < 0.06 * (high - low)
    same = V.bootstrap_ratio(df.select("a", (F.col("a") / 2).alias("b"))).first()
    assert abs(same.low - 0.5) < 1e-9 and abs(same.high - 0.5) < 1e-9
    assert V.bootstrap_ratio(df.limit(0)).first().low is None
    zero = V.bootstrap_ratio(spark.createDataFrame([(0.0, 1.0)], "a double, b double")).first()
    assert zero.low == zero.high == 0.0


def test_tool_states_on_a_stream_equal_the_batch(spark, tmp_path):
    from quillspark.operators import session as S
    from quillspark.plans import session_queries as SQ
    from quillspark.streaming import session as SS

    rows = SQ.tool_events(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    src = str(tmp_path / "in")
    for part in range(2):  # two micro-batches, each session cut in the middle
        half = rows.withColumn("at", F.ntile(2).over(Window.partitionBy("session").orderBy("seq"))).where(F.col("at") == part + 1).drop("at")
        half.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    q = SS.tool_state_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({r.session: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {k: v for batch in seen for k, v in batch.items()}
    assert len(seen) >= 2 and last == {r.session: r for r in S.tool_states(rows).collect()}


def test_states_are_saved_and_loaded(spark, tmp_path):
    schema = "session long, pinned_facts array<string>, current_subtask string"
    path = str(tmp_path / "state")
    assert readers.states(spark, path, schema).count() == 0
    for rows in ([(1, ["a"], "x")], [(1, ["b"], None), (2, None, "y")]):
        writers.save_states(spark.createDataFrame(rows, schema), path)
    none = F.array().cast("array<string>")
    got = sorted((r.session, r.pinned_facts, r.current_subtask) for r in readers.states(spark, path, schema, {"pinned_facts": none}).collect())
    assert got == [(1, ["b"], None), (2, [], "y")]


def test_store_is_made_once(spark, tmp_path):
    writers.init_store(spark, str(tmp_path))
    row = spark.createDataFrame([("s", "2024-01-01 00:00:00", "m", "/r")], "id string, started_at string, model_family string, repo_path string")
    writers.append(row, str(tmp_path), "sessions")
    writers.init_store(spark, str(tmp_path))
    assert {t: spark.read.parquet(f"{tmp_path}/{t}").count() for t in writers.TABLES} == {t: int(t == "sessions") for t in writers.TABLES}


def test_git_states(spark):
    text = "# branch.oid 1\n# branch.head dev\n# branch.upstream origin/dev\n# branch.ab +2 -1\n1 .M N... a\n? new.py\nu UU x"
    got = [tuple(r) for r in readers.git_states(spark.createDataFrame([(1, text), (2, "")], "id long, text string")).collect()]
    assert got == [(1, "dev", "origin/dev", 2, 1, 3), (2, None, None, 0, 0, 0)]


def test_git_details(spark):
    schema = "id int, branch string, status string, diff string, log string, counts string"
    rows = [(1, "dev\n", " M src/a b.py\n?? new.py\nD  gone.py\n", " a | 2 +-\n 1 file changed\n", "\n".join(f"{k}abc commit {k}" for k in range(7)) + "\n", "2\t3\n"), (2, "", None, "  \n", "", "x"), (3, None, "??\n", None, "1 one", None)]
    got = {r.id: r for r in readers.git_details(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].uncommitted_files == ["src/a b.py", "new.py", "gone.py"] and (got[1].branch, got[1].ahead, got[1].behind) == ("dev", 3, 2)
    assert got[1].recent_commits == [f"{k}abc commit {k}" for k in range(5)] and got[1].last_commit == "0abc commit 0" and got[1].diff_stat == " a | 2 +-\n 1 file changed"
    assert tuple(got[2])[1:] == (None, [], None, None, [], 0, 0) and got[3].uncommitted_files == [] and got[3].last_commit == "1 one"


def test_growth_is_cut_towards_zero(spark):
    rows = spark.createDataFrame([(3, 4), (3, 2), (0, 5), (7, 7)], "b long, a long").select(V.saved_percent(F.col("b"), F.col("a")).alias("p"))
    assert [r.p for r in rows.collect()] == [-33, 33, 0, 0]


def test_repeated_predictions_count_each_time(spark):
    row = spark.createDataFrame([([1, 1, 2, 9], [1, 3])], "p array<int>, e array<int>").select(V.precision_at(F.col("p"), F.col("e"), 3).alias("precision"), V.recall_at(F.col("p"), F.col("e"), 3).alias("recall")).first()
    assert (row.precision, row.recall) == (2 / 3, 0.5)


def test_bm25_weighs_repeats(spark):
    import math

    docs = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["x"]), ("c", ["z", "z"])], "doc string, terms array<string>")
    got = {r.doc: r.score for r in rank.bm25(spark.createDataFrame([(1, ["x", "x", "q"])], "query_id long, terms array<string>"), docs).collect()}
    weight = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    want = {d: weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2)) for d, tf, dl in (("a", 2, 3), ("b", 1, 1))}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-12 for d in want)


def test_bm25_moves_no_row_per_term_or_pair(spark):
    """F2: scores are added up where a document's row is; of 300 documents and 7 queries at most k a query and task leave it."""
    import math
    import random

    from pyspark.sql import functions as F

    random.seed(5)
    texts = [(f"d{i % 290:03d}", [random.choice("abcdefgh") for _ in range(random.randint(0, 12))]) for i in range(300)]  # ten names twice
    asked = [(q, random.sample("abcdefghz", 3)) for q in range(7)]
    docs, queries = spark.createDataFrame(texts, "doc string, terms array<string>").repartition(5), spark.createDataFrame(asked, "query_id int, terms array<string>")
    tf: dict = {}
    for d, terms in texts:
        for t in terms:
            tf[d, len(terms), t] = tf.get((d, len(terms), t), 0) + 1
    df = {t: sum(x == t for _, _, x in tf) for t in "abcdefghz"}
    avgdl = sum(len(t) for _, t in texts) / len(texts)
    want: dict = {}
    for q, terms in asked:
        for (d, dl, t), n in tf.items():
            if t in terms:
                want[q, d] = want.get((q, d), 0) + math.log((300 - df[t] + 0.5) / (df[t] + 0.5) + 1) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl))
    every, best = rank.bm25(queries, docs), rank.bm25(queries, docs, 4)
    got = {(r.query_id, r.doc): r.score for r in every.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    first = {(q, i + 1, d) for q, _ in asked for i, d in enumerate(sorted((d for p, d in want if p == q), key=lambda d: (-round(want[q, d], 9), d))[:4])}
    assert {(r.query_id, r.place, r.doc) for r in best.collect()} == first
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    assert rank.bm25(queries.where("query_id < 0"), docs, 4).count() == 0 and rank.bm25(queries, docs.limit(0), 4).count() == 0
    assert rank.bm25(queries, docs.where(F.size("terms") == 0), 4).count() == 0


def test_json_outline():
    got = reduce._compacted({"b": [{"k": 1}] * 2 + [2, "é" * 90, None, None], "a": {}, "c": {"d": [[]]}})
    long = '"' + "é" * 80 + '" of 180 bytes'
    assert got == f'"a": {{}}\n"b": 6 entries, 4 distinct\n  2 of\n    "k": 1\n  1 of 2\n  1 of {long}\n  1 further distinct in 2 entries\n"c":\n  "d": 1 entries\n    1 of []'
