"""Queries of the entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lint
from ..operators import codegraph as G
from ..operators import guards, rank, session
from ..sources import readers
from . import engine
from . import event_queries as EQ
from . import graph_queries as GQ
from . import lint_queries as LQ
from . import rank_queries as RQ
from . import session_queries as SQ
from . import text_queries as TQ
from .inputs import sql_estimate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def b6_config_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration scores with TOML and YAML parsers."""
    return TQ._texts(spark, sf_dir).select("id", F.round(engine.config_score(F.col("text")).cast("double"), 4).alias("config"))


def _piped_sql(texts: str, kind: str) -> str:
    """CTEs from texts(id, kind, text) to known(id, text, detected, best) and done(id, detected, reduced, before_tokens, after_tokens); kind: the column of known that says which reducer takes a text."""
    each = []
    for k, name in TQ._REDUCED.items():
        one = TQ.SQL[name].replace(f"FROM logs WHERE kind = '{k}'", f"FROM known WHERE {kind} = '{k}' AND NOT contains(text, '```')")
        each.append(f"SELECT id, '{k}' AS by_kind, reduced, before_tokens, after_tokens FROM ({one})" if k != "json" else f"SELECT j.id + 1000000, 'json', reduced, before_tokens, after_tokens FROM ({one}) j JOIN known ON known.id = j.id + 1000000 AND {kind} = 'json'")
    scores = ", ".join(f"{e} AS s_{k}" for k, e in TQ._SCORES.items())
    return f"""WITH {TQ._TEXTS_SQL}, given AS ({texts}), scores AS (SELECT id, text, {scores} FROM given), best AS (SELECT id, text, {TQ._KIND_SQL} AS detected, {TQ._BEST_SQL} AS best FROM scores),
known AS (SELECT id, text, CASE WHEN best >= {engine.PIPE_CONFIDENCE}::FLOAT THEN detected END AS piped, CASE WHEN best >= 0.55::FLOAT THEN detected END AS detected, best FROM best), done AS ({" UNION ALL ".join(each)})"""


@query(f"""{_piped_sql("SELECT id, text FROM texts", "piped")}
SELECT k.id, CASE WHEN after_tokens < before_tokens THEN reduced ELSE text END AS output, CASE WHEN after_tokens < before_tokens THEN piped END AS kind FROM known k LEFT JOIN done d ON d.id = k.id""")
def b11_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.pipe(TQ._texts(spark, sf_dir).select("id", "text"))


@query(f"""{_piped_sql("SELECT id, text FROM texts WHERE id % 4 <> 1", "piped")}
SELECT k.id, md5(encode(CASE WHEN after_tokens < before_tokens THEN reduced ELSE text END)) AS output_md5, CASE WHEN after_tokens < before_tokens THEN piped END AS kind FROM known k LEFT JOIN done d ON d.id = k.id
UNION ALL SELECT id, md5(encode(text) || '\\xFF'::BLOB), NULL FROM texts WHERE id % 4 = 1""")
def s4_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool text as bytes through the pipe; one in four ends in a byte that no UTF-8 has and passes through."""
    raw = F.col("text").cast("binary")
    payload = F.when(F.col("id") % 4 == 1, F.concat(raw, F.lit(b"\xff"))).otherwise(raw)
    out = engine.pipe_payloads(TQ._texts(spark, sf_dir).select("id", payload.alias("payload")))
    return out.select("id", F.md5("output").alias("output_md5"), "kind")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): every tool text, and prompts with conversation turns under ids below 0."""
    return TQ._texts(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "text").unionByName(LQ._prompts(spark, sf_dir).select((-F.col("id") - 1).alias("id"), "text"))


_TALK = LQ._PROMPTS.removeprefix(LQ.LOGS_SQL).lstrip(", ")


@query(f"""{_piped_sql("SELECT id, text FROM texts UNION ALL SELECT -id - 1, text FROM asked", "detected").replace("given AS", _TALK.replace("prompts AS", "asked AS", 1) + ", given AS", 1)},
classed AS (SELECT *, CASE WHEN detected IS NOT NULL THEN {TQ._CLASS_SQL} WHEN {TQ._PROMPTISH} THEN 'prompt' ELSE 'unknown' END AS class, CASE WHEN detected IS NOT NULL THEN round(best::DOUBLE, 4) WHEN {TQ._PROMPTISH} THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM known),
prompts AS (SELECT id, text FROM classed WHERE class IN ('prompt', 'unknown')), {LQ._PARTS}, linted AS (SELECT id, array_to_string([c FOR c IN [{", ".join(f"CASE WHEN {r[0]} THEN '{r[1]}' END" for r in LQ._RULES)}] IF c IS NOT NULL], '|') AS findings FROM p),
made AS (SELECT c.id, class, confidence, text, coalesce(reduced, text) AS output, findings FROM classed c LEFT JOIN done d ON d.id = c.id LEFT JOIN linted l ON l.id = c.id)
SELECT id, class, confidence, output, {sql_estimate("text")} AS before_tokens, {sql_estimate("output")} AS after_tokens, findings FROM made""")
def intercept_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, reduce and lint every text in one plan; findings are joined by |."""
    return engine.intercept(_requests(spark, sf_dir)).withColumn("findings", F.array_join("findings", "|"))


_S = f"WITH {SQ._UPDATES}, {SQ._MERGED}"
_LINES = """[x FOR x IN ['objective: ' || session_objective, 'current_subtask: ' || current_subtask, CASE WHEN len(hard_constraints) > 0 THEN 'hard_constraints: ' || array_to_string(hard_constraints, ' | ') END,
CASE WHEN len(pinned_facts) > 0 THEN 'pinned_facts: ' || array_to_string(pinned_facts[:6], ' | ') END, CASE WHEN len(modified_files) > 0 THEN 'modified_files: ' || array_to_string(list_reverse(modified_files)[:6], ', ') END,
CASE WHEN len(pending_next_actions) > 0 THEN 'next_actions: ' || array_to_string(pending_next_actions[:5], ' | ') END] IF x IS NOT NULL]"""


@query(f"{_S} SELECT session, CASE WHEN len({_LINES}) = 0 THEN '' ELSE '[session memory]' || chr(10) || array_to_string({_LINES}, chr(10)) || chr(10) || '[/session memory]' END AS attachment FROM state")
def c15_session_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = session.merged(SQ.updates(spark, sf_dir))
    c = F.col
    got = engine.attachment(c("session_objective"), c("current_subtask"), c("hard_constraints"), c("pinned_facts"), c("modified_files"), c("pending_next_actions"))
    return m.select("session", got.alias("attachment"))


@query(f"""WITH {GQ.FILES_SQL}, {GQ._SRC}, {GQ._SYMBOLS}, {GQ._IMPORTS}, {RQ._HOT}, {RQ._PROMPTS_SQL},
q AS (SELECT DISTINCT prompt_id, t FROM (SELECT prompt_id, unnest(regexp_split_to_array(lower(prompt), '[^a-z0-9]+')) AS t FROM prompts) WHERE length(t) >= 3),
b AS (SELECT prompt_id, path, 5 * count(*) AS s FROM q JOIN (SELECT DISTINCT path, name FROM symbols) ON lower(name) = t GROUP BY ALL UNION ALL SELECT prompt_id, path, 3 * count(*) FROM q JOIN imports ON lower(module) = t GROUP BY ALL
  UNION ALL SELECT DISTINCT prompt_id, path, 2 FROM q JOIN files ON contains(lower(path), t)),
r AS (SELECT prompt_id, path, (sum(s) + CASE WHEN path IN (SELECT path FROM hot) THEN 1 ELSE 0 END)::BIGINT AS score FROM b GROUP BY prompt_id, path)
SELECT prompt_id::BIGINT AS prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, path)::INT AS place, path, score FROM r QUALIFY place <= 10""")
def e9_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple ranker: 5 a symbol, 3 an import, 2 for a path that holds a term, 1 if hot (added to files that score); the 10 best."""
    files = GQ.files(spark, sf_dir)
    terms = RQ._prompts(spark).select("prompt_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("prompt"), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))).alias("t"))
    by_symbol = G.symbols(files).select("path", F.lower("name").alias("t"), "name").distinct().join(terms, "t").groupBy("prompt_id", "path").agg((F.count("*") * 5).alias("s"))
    by_import = G.imports(files).select("path", F.lower("module").alias("t")).join(terms, "t").groupBy("prompt_id", "path").agg((F.count("*") * 3).alias("s"))
    # terms have three characters at least, so the first three lead to every path that holds one
    grams = files.select("path", F.explode(rank._grams(F.lower("path"))).alias("lead"))
    by_path = grams.join(terms.withColumn("lead", F.left("t", F.lit(rank.GRAM))), "lead").where(F.lower("path").contains(F.col("t"))).select("prompt_id", "path", F.lit(2).cast("long").alias("s")).distinct()
    hot = G.hot_files(GQ.touched(spark, sf_dir), excluded=["tests"]).select("path", F.lit(1).alias("h"))
    r = by_symbol.unionByName(by_import).unionByName(by_path).groupBy("prompt_id", "path").agg(F.sum("s").alias("s")).join(hot, "path", "left")
    r = r.select("prompt_id", "path", (F.col("s") + F.coalesce("h", F.lit(0))).cast("long").alias("score"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("score"), "path"))).where("place <= 10")


@query(f"WITH {EQ._PROFILE}, n AS (SELECT * FROM p ORDER BY session DESC LIMIT 10) SELECT count(*)::BIGINT AS sessions, sum(calls)::BIGINT AS calls, sum(input + output + cache_write)::BIGINT AS billable, round(sum(cache_read) / greatest(1, sum(input + cache_read)), 6) AS cache_ratio FROM n")
def e11_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the 10 newest sessions: the limit is the feature."""
    p = guards.profile(EQ._calls(spark, sf_dir)).orderBy(F.desc("session")).limit(10)
    return p.agg(F.count("*").alias("sessions"), F.sum("calls").alias("calls"), F.sum("billable").alias("billable"), F.round(F.sum("cache_read") / F.greatest(F.lit(1), F.sum(F.col("input") + F.col("cache_read"))), 6).alias("cache_ratio"))


@query("""SELECT user_id, sum(passed)::BIGINT AS reports FROM (SELECT user_id, ((props::JSON->>'k')::INT % 3 > 0 AND (props::JSON->>'k')::INT % 3 = event_id % 3)::INT AS passed FROM events) GROUP BY user_id""")
def f17_report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports derived from events: total from the property, passed from the event's number."""
    k = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    report = F.concat(F.lit('{"summary": {"total_cases": '), k, F.lit(', "passed_cases": '), (F.col("event_id") % 3).cast("string"), F.lit("}}"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", engine.report_passed(report).alias("ok"))
    return e.groupBy("user_id").agg(F.count_if("ok").alias("reports"))


_WANT = "['overbroad_scope', 'missing_acceptance_criteria']"


@query(f"WITH {LQ._PROMPTS}, {LQ._PARTS}, f AS (" + " UNION ALL ".join(f"SELECT id, '{r[1]}' AS code FROM p WHERE {r[0]}" for r in LQ._RULES) + f") SELECT p.id, round(count(f.code) FILTER (list_contains({_WANT}, f.code)) / 2, 6) AS recall FROM prompts p LEFT JOIN f USING (id) GROUP BY p.id")
def i19_lint_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of two expected findings per prompt."""
    want = F.array(F.lit("overbroad_scope"), F.lit("missing_acceptance_criteria"))
    codes = F.transform(lint.findings(F.col("text")), lambda f: f["code"])
    return lint.with_parts(LQ._prompts(spark, sf_dir)).select("id", F.round(F.size(F.array_intersect(codes, want)) / F.size(want), 6).alias("recall"))


@query("SELECT event_id AS id, user_id::VARCHAR AS session_id, event_type AS kind, floor(value)::INT AS before_tokens, floor(value / 2)::INT AS after_tokens, 0::BIGINT AS latency_ms FROM events")
def h4_s11_transform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows of transforms, in the table's types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("kind"), F.floor("value").cast("int").alias("before_tokens"), F.floor(F.col("value") / 2).cast("int").alias("after_tokens"), F.lit(0).cast("long").alias("latency_ms"))


_GIT = """g AS (SELECT user_id AS id, 'main-' || user_id % 5 AS branch, CASE WHEN user_id % 2 = 0 THEN 'origin/main' END AS upstream, (user_id % 4)::INT AS ahead, (user_id % 3)::INT AS behind, (user_id % 6)::INT AS dirty FROM (SELECT DISTINCT user_id FROM events))"""


def _git(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status texts derived from users, read back."""
    u = F.col("user_id")
    text = F.concat(
        F.lit("# branch.oid abc\n# branch.head main-"), (u % 5).cast("string"), F.when(u % 2 == 0, "\n# branch.upstream origin/main").otherwise(""), F.lit("\n# branch.ab +"), (u % 4).cast("string"), F.lit(" -"), (u % 3).cast("string"),
        F.repeat(F.lit("\n1 .M N... 100644 100644 100644 a b src/x.py"), (u % 6).cast("int")),
    )
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return readers.git_states(users.select(u.alias("id"), text.alias("text")))


@query(f"WITH {_GIT} SELECT * FROM g")
def s14_git_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _git(spark, sf_dir)


@query(f"""WITH {SQ._UPDATES}, {SQ._MERGED}, {_GIT}, l AS (SELECT session, [x FOR x IN ['branch=' || branch, CASE WHEN dirty > 0 THEN 'uncommitted=' || dirty END, 'objective="' || session_objective || '"',
CASE WHEN len(failing_signatures) > 0 THEN 'last_failure="' || failing_signatures[-1] || '"' END] IF x IS NOT NULL] AS parts FROM state JOIN g ON g.id = session)
SELECT session, CASE WHEN len(parts) = 0 THEN '' ELSE '[session] ' || array_to_string(parts, ' | ') END AS line FROM l""")
def f16_status_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = session.merged(SQ.updates(spark, sf_dir)).join(_git(spark, sf_dir).withColumnRenamed("id", "session"), "session")
    return m.select("session", engine.status(F.col("branch"), F.col("dirty"), F.col("session_objective"), F.coalesce("failing_signatures", F.array().cast("array<string>"))).alias("line"))


@query(f"""WITH {GQ.FILES_SQL}, {RQ._HOT}, {_GIT}, h AS (SELECT string_agg('`' || path || '` (' || n || ')', ', ' ORDER BY n DESC, s, path) AS top FROM (SELECT path, count(*) AS n, min(seq) AS s FROM touched WHERE path IN (SELECT path FROM hot) GROUP BY path ORDER BY n DESC, s, path LIMIT 3)),
l AS (SELECT id, [x FOR x IN ['Handoff: continue from `packet-' || (CASE WHEN id % 7 = 0 THEN id END) || '.md`.', 'Git: ' || array_to_string([y FOR y IN ['branch `' || branch || '`', CASE WHEN dirty > 0 THEN dirty || ' uncommitted' END,
CASE WHEN ahead > 0 THEN ahead || ' ahead of `' || upstream || '`' END, CASE WHEN behind > 0 THEN behind || ' behind `' || upstream || '`' END] IF y IS NOT NULL], ', ') || '.', CASE WHEN id % 3 = 0 THEN 'Graph: stale, build it again.' END, 'Hot: ' || top || '.',
CASE WHEN id % 4 = 0 THEN 'Last session: loops; reads.' END] IF x IS NOT NULL] AS lines FROM g, h)
SELECT id, '[session brief]' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || '[/session brief]' AS brief FROM l""")
def d15_session_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Git states, the hot files of the graph and flags by user, as the text a session starts with."""
    hot = G.hot_files(GQ.touched(spark, sf_dir), excluded=["tests"], k=3, ordered=True)
    i, git = F.col("id"), F.struct("branch", "upstream", "ahead", "behind", "dirty")
    none = F.array().cast("array<string>")
    rows = _git(spark, sf_dir).join(F.broadcast(hot.agg(F.sort_array(F.collect_list(F.struct("place", "path", "touches"))).alias("hot"))))
    handoff = F.when(i % 7 == 0, F.concat(F.lit("packet-"), i.cast("string"), F.lit(".md")))
    return rows.select("id", engine.brief(handoff, git, i % 3 == 0, F.col("hot"), F.when(i % 4 == 0, F.array(F.lit("loops"), F.lit("reads"))).otherwise(none)).alias("brief"))


@query("SELECT event_id, ltrim(CASE WHEN starts_with(p, '/srv/app/') THEN p[10:] ELSE p END, '/') AS path FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/srv/app/src/a.rs' WHEN 1 THEN '/srv/apple/b.rs' ELSE 'src//c.rs' END AS p FROM events)")
def f16_relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    path = F.when(e == 0, "/srv/app/src/a.rs").when(e == 1, "/srv/apple/b.rs").otherwise("src//c.rs")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", engine.relative_path(path, F.lit("/srv/app/")).alias("path"))
