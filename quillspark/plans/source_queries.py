"""Queries of the readers over texts derived from the tables, as files would hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("""SELECT user_id::VARCHAR AS session, count(*)::BIGINT AS n, sum(event_id % 100)::BIGINT AS input, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END)::BIGINT AS output, 0::BIGINT AS cache_read
FROM events WHERE event_id % 5 NOT IN (0, 1) GROUP BY user_id""")
def s6_s7_transcript_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of transcript lines; one in five is no JSON, one in five has no usage, and counts may lack."""
    e = F.col("event_id")
    usage = F.struct((e % 100).alias("input_tokens"), F.when(e % 3 != 0, e % 7).alias("output_tokens"))
    message = F.struct(F.when(e % 5 != 1, usage).alias("usage"))
    line = F.when(e % 5 == 0, F.concat(F.lit("{bad "), e.cast("string"))).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), message.alias("message"))))
    lines = _events(spark, sf_dir).select(line.alias("raw")).withColumn("json", F.try_parse_json("raw")).where("json is not null")
    return readers.transcript_usage(lines).groupBy("session").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read")])


@query("SELECT user_id AS session, coalesce(CASE WHEN user_id % 2 = 0 THEN 'topic-' || user_id END, 'none') AS objective, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) END::BIGINT AS turns FROM events GROUP BY user_id")
def s5_state_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from JSON texts in which fields lack."""
    u = F.col("user_id")
    g = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    text = F.to_json(F.struct(u.alias("session"), F.when(u % 2 == 0, F.concat(F.lit("topic-"), u.cast("string"))).alias("objective"), F.when(u % 3 != 0, F.col("n")).alias("turns")))
    schema = "session long, objective string, turns long"
    return g.select(readers.state_or_default(text, schema, {"objective": F.lit("none"), "turns": F.lit(0).cast("long")}).alias("s")).select("s.*")


@query("SELECT event_id::VARCHAR AS sha, event_type || ' of ' || user_id AS subject, CASE WHEN event_id % 2 = 0 THEN 'more' || chr(10) || 'lines' ELSE '' END AS body, unnest(CASE event_id % 3 WHEN 0 THEN [NULL] WHEN 1 THEN ['src/a.py'] ELSE ['src/a.py', 'b.rs'] END) AS path FROM events")
def s13_s15_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and their files from logs of one user's events each."""
    e = F.col("event_id")
    files = F.when(e % 3 == 0, "").when(e % 3 == 1, "\nsrc/a.py").otherwise("\nsrc/a.py\n b.rs \n")
    frame = F.concat(F.lit("\x02"), e.cast("string"), F.lit("\x00"), F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")), F.lit("\x00"), F.when(e % 2 == 0, "more\nlines").otherwise(""), F.lit("\x03"), files, F.lit("\n"))
    logs = _events(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.collect_list(frame), "").alias("text"))
    return readers.commit_log(logs)


@query("""SELECT 'pkg' || user_id || '/package.json' AS path, 'lib-' || event_type AS name, count(*)::VARCHAR AS version, 'dependencies' AS kind FROM events GROUP BY ALL
UNION ALL SELECT DISTINCT 'pkg' || user_id || '/package.json', 'jest', '29', 'devDependencies' FROM events""")
def s16_package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of a package manifest per user."""
    n = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").cast("string").alias("n"))
    deps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("lib-"), "event_type"), "n"))).alias("dependencies"))
    content = F.to_json(F.struct("dependencies", F.create_map(F.lit("jest"), F.lit("29")).alias("devDependencies")))
    return readers.package_dependencies(deps.select(F.concat(F.lit("pkg"), F.col("user_id").cast("string"), F.lit("/package.json")).alias("path"), content.alias("content")))


@query("SELECT 'c' || user_id || '/Cargo.toml' AS path, 'lib-' || event_type AS name, '1.' || count(*) AS version, CASE event_type WHEN 'view' THEN 'dev-dependencies' ELSE 'dependencies' END AS kind FROM events WHERE user_id % 4 > 0 GROUP BY user_id, event_type")
def d6_s16_toml_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of a TOML manifest per user; one in four is broken."""
    n = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").cast("string").alias("n"))
    line = F.concat(F.lit("lib-"), "event_type", F.when(F.col("event_type") == "click", F.concat(F.lit(' = { version = "1.'), "n", F.lit('", optional = true }'))).otherwise(F.concat(F.lit(' = "1.'), "n", F.lit('"'))))
    of = lambda dev: F.array_join(F.collect_list(F.when((F.col("event_type") == "view") == F.lit(dev), line)), "\n")
    text = F.concat(F.lit("[dependencies]\n"), of(False), F.lit("\n[dev-dependencies]\n"), of(True), F.when(F.any_value("user_id") % 4 == 0, "\n= =").otherwise("\n"))
    docs = n.groupBy("user_id").agg(text.alias("content"))
    return readers.toml_dependencies(docs.select(F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("/Cargo.toml")).alias("path"), "content"))


@query("""WITH e AS (SELECT user_id AS id, 'src/' || event_type || event_id || '.rs' AS file, event_id, event_type, CASE event_id % 3 WHEN 0 THEN ' M ' WHEN 1 THEN '?? ' END AS state FROM events),
g AS (SELECT id, coalesce(list(file ORDER BY event_id) FILTER (state IS NOT NULL), []) AS files, list(hex(event_id) || ' add ' || event_type ORDER BY event_id DESC) AS commits FROM e GROUP BY id)
SELECT id, CASE WHEN id % 4 > 0 THEN 'topic-' || id END AS branch, array_to_string(files, '|') AS uncommitted_files, CASE WHEN len(files) > 0 THEN ' ' || len(files) || ' files changed' END AS diff_stat, commits[1] AS last_commit, array_to_string(commits[:5], '|') AS recent_commits,
  CASE WHEN id % 4 > 0 THEN id % 7 ELSE 0 END::INT AS ahead, CASE WHEN id % 4 > 0 THEN id % 5 ELSE 0 END::INT AS behind FROM g""")
def s14_git_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch, changed files, diff stat, commits and divergence from the texts git prints, a repository per user."""
    e, u = F.col("event_id"), F.col("user_id")
    letters = F.when(e % 3 == 0, " M ").when(e % 3 == 1, "?? ")
    events = _events(spark, sf_dir).select(u.alias("id"), e.alias("at"), F.concat(letters, F.lit("src/"), "event_type", e.cast("string"), F.lit(".rs")).alias("line"), F.concat(F.hex(e), F.lit(" add "), "event_type").alias("commit"))
    told = events.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))).alias("s"), F.sort_array(F.collect_list(F.struct("at", "commit")), asc=False).alias("c"))
    topic = F.col("id") % 4 > 0
    outputs = told.select(
        "id",
        F.when(topic, F.concat(F.lit("topic-"), F.col("id").cast("string"), F.lit("\n"))).otherwise("").alias("branch"),
        F.array_join(F.transform("s", lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("status"),
        F.when(F.size("s") > 0, F.concat(F.lit(" "), F.size("s").cast("string"), F.lit(" files changed\n"))).alias("diff"),
        F.array_join(F.transform("c", lambda x: x["commit"]), "\n").alias("log"),
        F.when(topic, F.concat((F.col("id") % 5).cast("string"), F.lit("\t"), (F.col("id") % 7).cast("string"), F.lit("\n"))).alias("counts"),
    )
    out = readers.git_details(outputs)
    joined = {c: F.array_join(c, "|") for c in ("uncommitted_files", "recent_commits")}
    return out.withColumns(joined)
