"""Parts that must not grow with one prompt, one folder, one module or one group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import codegraph as G
from quillspark.operators import evals as V
from quillspark.operators import rank


def test_grams_are_all_substrings(spark):
    random.seed(2)
    texts = ["", "a", "ab", "abc", *["".join(random.choice("ab_é☃") for _ in range(random.randint(0, 30))) for _ in range(50)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", rank._grams(F.col("t"), (1, 2, 3)).alias("g")).collect():
        want = {r.t[i : i + n] for n in (1, 2, 3) for i in range(len(r.t) - n + 1)} | {r.t for n in (1, 2, 3) if len(r.t) < n}
        assert set(r.g) == want and len(r.g) == len(want)


def test_a_prompt_of_a_megabyte_ranks(spark):
    """Its text is neither copied per term nor broadcast: the joins carry its number."""
    files = spark.createDataFrame([(f"src/part{k}/store_{k}.py", "") for k in range(400)] + [("src/session_store.py", "")], "path string, content string")
    symbols = spark.createDataFrame([("open_store", "src/session_store.py", 3, "def")], "name string, path string, line int, kind string")
    imports = spark.createDataFrame([], "path string, module string, line int")
    hot = spark.createDataFrame([], "path string, touches long")
    filler = " ".join(f"word{k} filler{k % 997}" for k in range(60_000))
    prompts = spark.createDataFrame([(1, f"Look at open_store in session_store.py please {filler}"), (2, "what does session_store.py do with open_store")], "prompt_id int, prompt string")
    assert prompts.agg(F.max(F.length("prompt"))).first()[0] > 1_000_000
    ranked = rank.rank(prompts, files, symbols, imports, G.path_frequencies(files), hot, k=1)
    plan = ranked._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in plan
    assert {(r.prompt_id, r.path) for r in ranked.collect()} == {(1, "src/session_store.py"), (2, "src/session_store.py")}


def test_promoted_words_of_many_files(spark):
    files = spark.range(5000).select(F.concat(F.lit("src/"), F.when(F.col("id") == 77, "run_check").otherwise("plain"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    assert rank.promoted(files) == ["run"] and rank.promoted(files.limit(0)) == []


def test_a_folder_and_a_module_of_many_files(spark):
    """20,000 files in one folder that import one module: relations stay a few per file, importers a row each."""
    files = spark.range(20_000).select(F.format_string("src/f%05d.py", "id").alias("path"), F.lit("import os\n").alias("content"))
    imports = G.imports(files)
    related = G.relations(files, imports)
    row = related.agg(F.max(F.size("neighbours")), F.max(F.size("importers")), F.count("*")).first()
    assert tuple(row) == (15, 0, 20_000)
    first = related.where("path = 'src/f00003.py'").first()
    assert first.neighbours == [f"src/f{k:05d}.py" for k in range(16) if k != 3] and first.modules == ["os"]
    users = G.dependents(imports)
    assert users.count() == 20_000 and {r.n for r in users.select("n").distinct().collect()} == {20_000}


def test_all_files_of_a_folder_are_neighbours(spark):
    """e8_dependencies names every file beside a file, not the first 15."""
    files = spark.range(40).select(F.format_string("src/f%02d.py", "id").alias("path"), F.lit("import os\n").alias("content"))
    related = G.relations(files, G.imports(files), beside=None).collect()
    assert {r.path: r.neighbours for r in related} == {f"src/f{k:02d}.py": [f"src/f{j:02d}.py" for j in range(40) if j != k] for k in range(40)}


def test_the_query_of_relations_has_no_cut(spark):
    from quillspark.plans import graph_queries as Q

    rows = Q.e8_dependencies(spark, "/root/testdata/sf0.01")
    folder = F.regexp_extract("path", "^(.*/)", 1)
    sizes = Q.files(spark, "/root/testdata/sf0.01").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))
    wrong = rows.join(sizes, folder == F.col("folder")).where(F.size(F.split("neighbours", r"\|")) != F.col("n") - 1)
    assert sizes.agg(F.max("n")).first()[0] > 16 and wrong.count() == 0


def test_texts_of_relations_are_the_joined_lists(spark):
    """e8_dependencies copies the bytes around a path; first, last, lone, top and non-ASCII ones as by the lists."""
    paths = ["alone/é.py", "top.py", "z", "a|b/|", "a|b/x|y.rs", "ü/ä.py", "ü/☃.py", "ü/ö/ä.py", "ü/\U0001f600.ts", *[f"src/f{k}.py" for k in range(120)], "src/f", "src/f1.pyc"]
    files = spark.createDataFrame([(p, "import os\nfrom src.f7 import a\n") for p in paths] + [(None, "import os")], "path string, content string")
    imports = G.imports(files)
    want = G.relations(files, imports, beside=None).select("path", *[F.array_join(c, "|").alias(c) for c in ("modules", "importers", "neighbours")])
    got = G.relation_texts(files, imports)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == len(paths) and got.dtypes == want.dtypes
    assert {r.neighbours for r in got.where("path IN ('alone/é.py')").collect()} == {""}
    wide = {r.path: r.neighbours for r in G.relation_texts(files, imports, mark=", é").collect()}
    assert wide["ü/ä.py"] == ", é".join(sorted(["ü/☃.py", "ü/\U0001f600.ts"])) and wide["z"] == "top.py"


def test_the_query_of_relations_does_no_work_per_neighbour(spark):
    from quillspark.plans import graph_queries as Q

    plan = Q.e8_dependencies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(beside" in plan and "filter(beside" not in plan and "array_join(filter" not in plan


def test_numbers_by_range_equal_the_window(spark):
    random.seed(7)
    rows = [(random.choice(["hot", "hot", "hot", "b", None]), random.choice([1, 2, None]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(8)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = V.numbered(df, ["g"], ["v", "id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert V.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_only_the_chosen_packet_is_written_out(spark):
    """candidates are told apart by sums of measures, no row each; a text is measured once."""
    from quillspark.functions import tokens
    from quillspark.operators import session as S

    random.seed(11)
    word = lambda: random.choice(["run::x", "fn go", "a b c", "é☃ 12", " x ", "/tmp/a.rs failed", "=> {}", ""])
    names = ["recent_turns", "tests_run", "failed_approaches", "decisions_made"]
    rows = [(i, "goal\r\n 7" if i % 3 else None, *[[f"{word()} {word()}" for _ in range(random.randint(0, 9))] for _ in names]) for i in range(60)]
    states = spark.createDataFrame(rows, f"session long, session_objective string, {', '.join(f'{n} array<string>' for n in names)}")
    for most in (1, 60, 120):
        got = S.packets(states, most)
        written = spark.createDataFrame(got.select("packet", "tokens").collect(), "packet string, tokens long")
        assert written.count() == 60 and written.where(F.col("tokens") != tokens.estimated(F.col("packet"))).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate [" not in plan
    texts = spark.createDataFrame([("x",)], "t string").select(tokens.estimated(F.col("t")).alias("e"))
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2


def test_a_new_session_reads_no_state():
    """a session's first batch writes its counts without asking the store for each; a later one asks once a key."""
    from quillspark.streaming.profile import SessionProfile

    class Store:
        def __init__(self):
            self.kept, self.asked = {}, 0

        def getValue(self, key):
            self.asked += 1
            return self.kept.get(key)

        def updateValue(self, key, value):
            self.kept[key] = value

    store = Store()
    assert SessionProfile._grown(store, {("a",): 2, ("b",): 1}, False) == [(("a",), 0, 2), (("b",), 0, 1)] and store.asked == 0
    assert SessionProfile._grown(store, {("a",): 3, ("c",): 1}, True) == [(("a",), 2, 5), (("c",), 0, 1)] and store.asked == 2


def test_a_prompt_is_lowered_once(spark):
    """what a text is told by is found once, however many words look at it."""
    from quillspark.functions import detect

    texts = spark.createDataFrame([("a\nFIX it",), ("a\nb",), ("fix",), (None,)], "t string").select(detect.is_prompt_like(F.col("t")).alias("e"))
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [bool(r.e) for r in texts.collect()] == [True, False, False, False]
