"""Queries of session memory over conversations and tool events derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import session as S
from .inputs import _quoted, sql_any, sql_estimate, sql_lines, sql_trim

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


FIELDS = [*S.SCALARS, *S.LISTS]


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, field, value): an update of one field per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    field = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("event_id") % len(FIELDS)).cast("int") + 1)
    value = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.concat("event_type", F.lit("-"), (F.get_json_object("props", "$.k").cast("int") % 6).cast("string")))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), field.alias("field"), value.alias("value"))


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


_UPDATES = f"updates AS (SELECT user_id AS session, event_id AS seq, {_list(FIELDS)}[event_id % {len(FIELDS)} + 1] AS field, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type || '-' || ((props::JSON->>'k')::INT % 6) END AS value FROM events)"
_MERGED = f"""once AS (SELECT session, field, value, min(seq) AS first, max(seq) AS last FROM updates WHERE value IS NOT NULL GROUP BY ALL),
state AS (SELECT session, {', '.join(f"arg_max(value, last) FILTER (field = '{f}') AS {f}" for f in S.SCALARS)}, {', '.join(f"coalesce(list(value ORDER BY first) FILTER (field = '{f}'), []) AS {f}" for f in S.LISTS)} FROM once GROUP BY session)"""


def _flat(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("session", *[F.array_join(F.coalesce(n, F.array().cast("array<string>")), "|").alias(n) for n in names])


@query(f"WITH {_UPDATES}, {_MERGED} SELECT session, {', '.join(S.SCALARS)}, {', '.join(f'array_to_string({f}, {_quoted(chr(124))}) AS {f}' for f in S.LISTS)} FROM state")
def f1_f2_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.merged(updates(spark, sf_dir))
    return _flat(m, S.LISTS).join(m.select("session", *S.SCALARS), "session")


_KEPT = ", ".join(f"array_to_string({f}[greatest(len({f}) - {n} + 1, 1):], '|') AS {f}, greatest(len({f}) - {n}, 0)::INT AS removed_{f}" for f, n in (("recent_turns", 6), ("tests_run", 12), ("failed_approaches", 12), ("pending_next_actions", 8)))


@query(f"WITH {_UPDATES}, {_MERGED}, c AS (SELECT session, {_KEPT} FROM state) SELECT *, removed_recent_turns + removed_tests_run + removed_failed_approaches + removed_pending_next_actions > 0 AS compacted FROM c")
def f3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.compacted(S.merged(updates(spark, sf_dir)))
    return c.select("session", *[F.array_join(f, "|").alias(f) for f in S.KEEP], *[f"removed_{f}" for f in S.KEEP], "compacted")


@query("""WITH h AS (SELECT user_id AS session, [x.t FOR x IN list({'e': event_id, 't': event_type || '-' || ((props::JSON->>'k')::INT % 9)} ORDER BY event_id)] AS a FROM events GROUP BY user_id), s AS (SELECT session, a[:len(a) // 2] AS before, a[len(a) // 2 + 1:] AS after FROM h)
SELECT session, array_to_string([x FOR x IN after IF NOT list_contains(before, x)], '|') AS added FROM s""")
def f4_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half of a session's entries adds to the first."""
    t = F.concat("event_type", F.lit("-"), (F.get_json_object("props", "$.k").cast("int") % 9).cast("string"))
    h = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("session")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", t.alias("t")))), lambda x: x["t"]).alias("a"))
    half = F.floor(F.size("a") / 2).cast("int")
    s = h.select("session", F.slice("a", F.lit(1), half).alias("before"), F.slice("a", half + 1, F.size("a")).alias("after"))
    return s.select("session", F.array_join(S.added(F.col("before"), F.col("after")), "|").alias("added"))


@query(f"WITH {_UPDATES}, {_MERGED} SELECT session, json_array_length(to_json(tests_run))::INT AS tests, current_subtask FROM state")
def f5_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State to JSON and back."""
    m = S.merged(updates(spark, sf_dir))
    schema = m.schema.simpleString()
    back = m.select(F.to_json(F.struct(*m.columns)).alias("j")).select(F.from_json("j", schema).alias("s"))
    return back.select("s.session", F.size("s.tests_run").alias("tests"), "s.current_subtask")


#: Our own tool outputs by slot; # stands for a small number.
OUTPUTS = [
    "error[E030#]: mismatched types\ntest core::case_# ... FAILED\ntest result: FAILED. 1 failed",
    "running 3 tests\ntest result: ok. 3 passed; 0 failed",
    "FAIL src/a#.test.ts\n  Tests: # failed, 3 passed",
    "note: do not retry flaky job #\nall fine",
    "✗ src/services/api#.test.ts\nthread 'main' panicked at core::x::y",
    "Tests: 4 passed, 4 total",
    "1 failed",
    "Finished dev in 2s",
    "FAILED tests/test_#.py::test_bar",
]
COMMANDS = ["cd /srv/app && cargo test case_#", "FOO='a b' BAR=1 npm test", "source .env && timeout 30 pytest -q", "ls -la", "env CI=true make build", "git status", "timeout x go test", "pushd a && . b && yarn build --x=1"]


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, tool, command, path, output)."""
    n = (F.floor(F.col("event_id") / 16) % 3).cast("string")
    fill = lambda items: F.replace(F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("event_id") % len(items)).cast("int") + 1), F.lit("#"), n)
    edit = F.col("event_type") == "purchase"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(edit, "Edit").otherwise("Bash").alias("tool"),
        F.when(~edit, fill(COMMANDS)).alias("command"), F.when(edit, F.concat(F.lit("/srv/app/src/f"), (F.col("event_id") % 40).cast("string"), F.lit(".rs"))).alias("path"), F.when(edit, "").otherwise(fill(OUTPUTS)).alias("output"),
    )


def _fill(items: list[str]) -> str:
    rows = ", ".join(_quoted(x).replace("\n", "' || chr(10) || '") for x in items)
    return f"replace([{rows}][event_id % {len(items)} + 1], '#', ((event_id // 16) % 3)::VARCHAR)"


_TOOL = f"tool AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Edit' ELSE 'Bash' END AS tool, CASE WHEN event_type <> 'purchase' THEN {_fill(COMMANDS)} END AS command, CASE event_type WHEN 'purchase' THEN '' ELSE {_fill(OUTPUTS)} END AS output FROM events)"
_LOWLINE = f"lower({sql_trim('x')})"
_NUMBER = r"regexp_extract(rtrim(regexp_replace({low}, 'failed(?s:.)*$', '')), '[^0-9]([0-9]+)$', 1)".replace("{low}", _LOWLINE)
_STARTS = " OR ".join(f"starts_with({sql_trim('x')}, {_quoted(h)})" for h in ("FAIL ", "FAILED ", "✗ ", "✘ ", "× "))
_FAILURE = f"""len([x FOR x IN {sql_lines('output')} IF {sql_any(_LOWLINE, ['test result: failed', 'compilation failed', 'build failed', 'panicked at'])} OR starts_with({_LOWLINE}, 'error:') OR starts_with({_LOWLINE}, 'error[')
 OR (starts_with({sql_trim('x')}, 'test ') AND ends_with({sql_trim('x')}, '... FAILED')) OR {_STARTS} OR (contains({_LOWLINE}, 'failed') AND regexp_matches({_NUMBER}, '[1-9]'))]) > 0"""
_SIGNATURE = f"""[y FOR y IN [CASE WHEN starts_with(x, 'test ') AND ends_with(x, '... FAILED') THEN regexp_replace(regexp_replace(x, '^(?:test )+', ''), '(?: \\.\\.\\. FAILED)+$', '') WHEN starts_with(x, 'FAIL ') THEN trim(x[6:]) WHEN starts_with(x, '✗ ') THEN trim(x[2:])
 WHEN contains(x, 'panicked at') AND contains(x, '::') THEN x WHEN starts_with(x, 'FAILED ') THEN trim(x[8:]) END FOR x IN {sql_lines('output')}] IF y IS NOT NULL AND y <> '']"""


@query(f"""WITH {_TOOL}, f AS (SELECT *, {_FAILURE} AS failure FROM tool), g AS (SELECT *, ({sql_any('lower(output)', ['test result: ok', 'build succeeded', 'finished `', 'finished dev', 'compiled successfully', 'all tests passed'])}
  OR ({sql_any('lower(output)', ['passed', '0 failed'])} AND NOT failure)) AS success FROM f)
SELECT session, seq, CASE WHEN failure THEN 'failed' WHEN success THEN 'passed' ELSE 'observed' END AS outcome, CASE WHEN failure THEN array_to_string({_SIGNATURE}, '|') END AS signatures,
  CASE WHEN failure THEN [x FOR x IN {sql_lines('output')} IF starts_with(x, 'error[') OR starts_with(x, 'error:')][1] END AS approach, [x FOR x IN {sql_lines('output')} IF contains(lower(x), 'do not retry')][1] AS fact FROM g""")
def f8_f12_tool_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_outcome(tool_events(spark, sf_dir)).select("session", "seq", "outcome", F.array_join("signatures", "|").alias("signatures"), "approach", "fact")


_CORE = {0: "cargo test case_#", 1: "npm test", 2: "pytest -q", 3: "ls -la", 4: "make build", 5: "git status", 6: "timeout x go test", 7: "yarn build --x=1"}


@query(f"""WITH {_TOOL} SELECT seq, CASE event_id % 8 {' '.join(f"WHEN {k} THEN replace({_quoted(v)}, '#', ((event_id // 16) % 3)::VARCHAR)" for k, v in _CORE.items())} END AS core, (event_id % 8) IN (0, 1, 2, 4, 7) AS reducible
FROM tool JOIN events ON event_id = seq WHERE tool = 'Bash'""")
def f15_core_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tool_events(spark, sf_dir).where("tool = 'Bash'")
    return t.select("seq", S.core_command(F.col("command")).alias("core"), S.is_reducible(F.col("command")).alias("reducible"))


_STATES = ["tests_run", "failing_signatures", "failed_approaches", "pinned_facts", "decisions_made", "modified_files"]


def _added(items: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL OR list_contains({items}, {value}) THEN {items} ELSE list_append({items}, {value}) END"


# A session's state, event by event: what an event adds, what a success clears, and the bounds of the lists.
_TOOL_STATES = f"""{_TOOL}, said AS (SELECT *, {_FAILURE} AS failure FROM tool), judged AS (SELECT *, ({sql_any('lower(output)', ['test result: ok', 'build succeeded', 'finished `', 'finished dev', 'compiled successfully', 'all tests passed'])}
  OR ({sql_any('lower(output)', ['passed', '0 failed'])} AND NOT failure)) AS success FROM said),
steps AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS k, count(*) OVER (PARTITION BY session) AS steps, CASE WHEN tool = 'Bash' THEN command || ' [' || CASE WHEN failure THEN 'failed' WHEN success THEN 'passed' ELSE 'observed' END || ']' END AS test,
  CASE WHEN tool = 'Bash' AND failure THEN {_SIGNATURE} ELSE [] END AS signatures, CASE WHEN tool = 'Bash' AND failure THEN [x FOR x IN {sql_lines('output')} IF starts_with(x, 'error[') OR starts_with(x, 'error:')][1] END AS approach,
  CASE WHEN tool = 'Bash' THEN [x FOR x IN {sql_lines('output')} IF contains(lower(x), 'do not retry')][1] END AS fact, tool = 'Bash' AND success AS success, command, CASE WHEN tool = 'Edit' THEN 'srv/app/src/f' || (seq % 40) || '.rs' END AS path FROM judged),
states AS (SELECT DISTINCT session, 0::BIGINT AS k, steps, {', '.join(f"[]::VARCHAR[] AS {n}" for n in _STATES)}, 0::BIGINT AS changes FROM steps
 UNION ALL SELECT session, k, steps, {', '.join(f"{n}[greatest(len({n}) - {S.CAPS[n]} + 1, 1):]" if n in S.CAPS else n for n in _STATES)}, changes + len(tests_run) - n_tests + n_new + len(failed_approaches) - n_approaches + len(pinned_facts) - n_facts + len(decisions_made) - n_decisions + len(modified_files) - n_files FROM (
  SELECT *  REPLACE (CASE WHEN cleared THEN [] ELSE failing_signatures END AS failing_signatures, CASE WHEN cleared THEN {_added('decisions_made', "('Validated current approach with `' || command || '` (after ' || len(failing_signatures) || ' failing)')")} ELSE decisions_made END AS decisions_made) FROM (
   SELECT *, len(failing_signatures) - n_signatures AS n_new, success AND len(failing_signatures) + len(failed_approaches) > 0 AS cleared FROM (
    SELECT s.session, s.k, s.steps, s.success, s.command, changes, len(tests_run) AS n_tests, len(failing_signatures) AS n_signatures, len(failed_approaches) AS n_approaches, len(pinned_facts) AS n_facts, len(decisions_made) AS n_decisions, len(modified_files) AS n_files,
     {_added('tests_run', 's.test')} AS tests_run, list_concat(failing_signatures, [x FOR x, i IN s.signatures IF NOT list_contains(failing_signatures, x) AND list_position(s.signatures, x) = i]) AS failing_signatures, {_added('failed_approaches', 's.approach')} AS failed_approaches,
     {_added('pinned_facts', 's.fact')} AS pinned_facts, decisions_made, {_added('modified_files', 's.path')} AS modified_files FROM states JOIN steps s ON s.session = states.session AND s.k = states.k + 1)))),
ended AS (SELECT * FROM states WHERE k = steps)"""


@query(f"WITH RECURSIVE {_TOOL_STATES} SELECT session, {', '.join(f'array_to_string({n}, {_quoted(chr(124))}) AS {n}' for n in _STATES)}, changes FROM ended")
def f7_tool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's state after all its tool events, lists joined by |."""
    states = S.tool_states(tool_events(spark, sf_dir))
    return states.select("session", *[F.array_join(n, "|").alias(n) for n in _STATES], "changes")


def _packet_sql(most: int) -> str:
    keep = {n: f"{n}[greatest(len({n}) - {k} + 1, 1):]" for n, k in S.PACKET_KEEP.items()}
    lists = [n for n, _ in S.SECTIONS if n in S.LISTS]
    gone = {"recent_turns": "least(i, nt)", "tests_run": "least(greatest(i - nt, 0), ns)", "decisions_made": "greatest(i - nt - ns - na, 0)"}
    value = " + ".join(f"(CASE WHEN {sql_any('lower(x)', marks)} THEN {points} ELSE 0 END)" for points, marks in S.TELLING)
    cut = {n: f"{n}[{g} + 1:]" for n, g in gone.items()} | {"failed_approaches": "[x FOR x, j IN failed_approaches IF NOT list_contains([o['j'] FOR o IN ranked[:least(greatest(i - nt - ns, 0), na)]], j)]"}
    item = "'- ' || " + sql_trim("x") + " || chr(10)"
    section = lambda n, t: f"CASE WHEN len({n}) > 0 THEN {_quoted(t)} || chr(10) || array_to_string([{item} FOR x IN {n}], '') || chr(10) ELSE '' END" if n in S.LISTS else f"coalesce({_quoted(t)} || chr(10) || {sql_trim(n)} || chr(10) || chr(10), '')"
    body = " || ".join(section(n, t) for n, t in S.SECTIONS)
    return f"""k AS (SELECT session, {", ".join(S.SCALARS)}, {", ".join(f"{keep.get(n, n)} AS {n}" for n in lists)} FROM state),
c AS (SELECT *, len(recent_turns) AS nt, len(tests_run) AS ns, len(failed_approaches) AS na, greatest(len(decisions_made) - 1, 0) AS nd, list_sort([{{'v': {value}, 'j': j}} FOR x, j IN failed_approaches]) AS ranked FROM k),
e AS (SELECT *, unnest(range(0, nt + ns + na + nd + 1)) AS i FROM c),
f AS (SELECT session, i, {", ".join(S.SCALARS)}, {", ".join(f"{cut.get(n, n)} AS {n}" for n in lists)} FROM e),
r AS (SELECT session, i, {body} AS b FROM f),
p AS (SELECT session, i, CASE WHEN b = '' THEN '' ELSE '[restart packet]' || chr(10) || b END AS packet FROM r),
n AS (SELECT *, {sql_estimate("packet")}::BIGINT AS tokens FROM p)
SELECT session, coalesce(arg_min(packet, i) FILTER (tokens <= {most}), arg_max(packet, i)) AS packet, coalesce(arg_min(tokens, i) FILTER (tokens <= {most}), arg_max(tokens, i)) AS tokens FROM n GROUP BY session"""


_LACKING = ", ".join([*[f"NULL::VARCHAR AS {n}" for n in S.SCALARS], *[f"[]::VARCHAR[] AS {n}" for n in S.LISTS if n not in _STATES]])


@query(f"WITH RECURSIVE {_TOOL_STATES}, state AS (SELECT session, {', '.join(_STATES)}, {_LACKING} FROM ended), {_packet_sql(200)}")
def f13_f14_restart_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's tool state as a restart packet of at most 200 tokens, where evictions can reach that."""
    return S.packets(S.tool_states(tool_events(spark, sf_dir)), 200)


@query(f"WITH {_UPDATES}, {_MERGED}, {_packet_sql(230)}")
def f13_f14_packets_of_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's merged state as a restart packet of at most 230 tokens, where evictions can reach that."""
    return S.packets(S.merged(updates(spark, sf_dir)), 230)
