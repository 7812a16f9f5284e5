"""Queries of prompt lint and extraction over prompt-like texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, lint
from .inputs import LOGS_SQL, _quoted, logs, sql_any, sql_distinct, sql_estimate, sql_lines, sql_trim, sql_trimmed_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt logs, cut in three by user turns so that texts of few lines occur, and the users' conversation turns."""
    long = logs(spark, sf_dir, "prompt").select(F.col("id").cast("long").alias("id"), "text")
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' and text is not null")
    head = F.element_at(F.array(F.lit("Fix the test in ./src/a.py\nnever retry\n"), F.lit("Review the whole repo\n"), F.lit("What about everything in this project?\nmission\n"), F.lit("")), (F.col("conv_id") % 4).cast("int") + 1)
    return long.unionByName(talk.select((F.col("conv_id") * 100 + F.col("turn") + 1000000).alias("id"), F.concat(head, F.col("text")).alias("text")))


_PROMPTS = f"""{LOGS_SQL}, prompts AS (SELECT id, text FROM logs WHERE kind = 'prompt' UNION ALL
SELECT conv_id * 100 + turn + 1000000, [ 'Fix the test in ./src/a.py' || chr(10) || 'never retry' || chr(10), 'Review the whole repo' || chr(10), 'What about everything in this project?' || chr(10) || 'mission' || chr(10), ''][conv_id % 4 + 1] || text
FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""
_ROWS = sql_trimmed_lines("text")
_REPEATED = f"[x FOR x IN {sql_distinct('rows')} IF len([y FOR y IN rows IF y = x]) > 1]"
_PATHS = sql_distinct(f"[trim(p, ',.') FOR p IN regexp_extract_all(text, {_quoted(lint.PATH)})]")


def _marks(items: list[str]) -> str:
    return "[m FOR m IN [" + ", ".join(map(_quoted, items)) + "] IF contains(lower(text), m)]"


_PARTS = f"p0 AS (SELECT id, text, {_ROWS} AS rows, {_PATHS} AS paths FROM prompts), p AS (SELECT *, {_REPEATED} AS repeated, {_marks(lint.OVERBROAD)} AS broad, {_marks(lint.STATIC)} AS static FROM p0)"
_RULES = [
    ("len(repeated) > 0", "redundant_constraints", "medium", sql_estimate("array_to_string(repeated, chr(10))"), "array_to_string(repeated, '|')"),
    ("len(broad) > 0", "overbroad_scope", "high", "60", "array_to_string(broad, '|')"),
    (f"len(paths) = 0 AND {sql_any('lower(text)', ['repo', 'codebase', 'project'])}", "missing_file_scope", "medium", "35", _quoted(lint.NO_PATHS_FOUND)),
    (f"NOT regexp_matches(lower(text), {_quoted(lint.VERBS)})", "ambiguous_objective", "medium", "25", "coalesce(rows[1], '')"),
    (f"NOT {sql_any('lower(text)', lint.SUCCESS)}", "missing_acceptance_criteria", "medium", "30", _quoted(lint.NO_CRITERIA_FOUND)),
    ("len(static) >= 2 AND len(rows) > 12", "buried_static_context", "low", "45", "array_to_string(static, '|')"),
]


@query(f"WITH {_PROMPTS}, {_PARTS} " + " UNION ALL ".join(f"SELECT id, {i}::INT AS ord, '{code}' AS code, '{sev}' AS severity, ({waste})::INT AS waste, {ev} AS evidence FROM p WHERE {when}" for i, (when, code, sev, waste, ev) in enumerate(_RULES)))
def c1_c6_lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lint.with_parts(_prompts(spark, sf_dir)).select("id", F.explode(lint.findings(F.col("text"))).alias("f"))
    order = F.array_position(F.array(*[F.lit(r[1]) for r in _RULES]), F.col("f.code")) - 1
    return f.select("id", order.cast("int").alias("ord"), "f.code", "f.severity", F.col("f.estimated_waste_tokens").alias("waste"), F.array_join("f.evidence", "|").alias("evidence"))


_CONSTRAINTS = sql_distinct(f"[regexp_replace(x, '^(?:- )+', '') FOR x IN rows IF starts_with(x, '-') OR {sql_any('x', lint.CONSTRAINT)}]") + "[:8]"


@query(f"WITH {_PROMPTS}, {_PARTS} SELECT id, array_to_string(paths, '|') AS paths, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_quoted(lint.PATH)}))), '|') AS sorted_paths, array_to_string({_CONSTRAINTS}, '|') AS constraints FROM p")
def c7_c8_c11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _prompts(spark, sf_dir).select("id", F.array_join(lint.paths(t), "|").alias("paths"), F.array_join(lint.sorted_paths(t), "|").alias("sorted_paths"), F.array_join(lint.constraints(t), "|").alias("constraints"))


_OBJECTIVE = f"coalesce([x FOR x IN rows IF regexp_matches(x, {_quoted('(?i)' + lint.VERBS)})][1], rows[1], {_quoted(lint.NO_OBJECTIVE)})"
_LOW = "lower(text)"
_DELIVERABLE = f"""CASE WHEN contains({_LOW}, 'review') THEN {_quoted(lint.REVIEW)} WHEN {sql_any(_LOW, ['document', 'write docs'])} THEN {_quoted(lint.DOCUMENTATION)}
WHEN {sql_any(_LOW, ['fix', 'implement', 'build', 'scaffold', 'add'])} THEN {_quoted(lint.CHANGES)} ELSE {_quoted(lint.ARTIFACT)} END"""
_ACC0 = f"[x FOR x IN [CASE WHEN contains({_LOW}, 'status.md') THEN {_quoted(lint.STATUS_UPDATED)} END, CASE WHEN {sql_any(_LOW, ['test', 'verify'])} THEN {_quoted(lint.TESTS_RUN)} END, CASE WHEN contains({_LOW}, 'safe mode') THEN {_quoted(lint.SAFE_MODE)} END] IF x IS NOT NULL]"
_ACCEPTANCE = f"(CASE WHEN len({_ACC0}) = 0 THEN [{', '.join(map(_quoted, lint.DEFAULT_CRITERIA))}] ELSE {_ACC0} END)"


@query(f"WITH {_PROMPTS}, {_PARTS} SELECT id, {_OBJECTIVE} AS objective, {_DELIVERABLE} AS deliverable, array_to_string({_ACCEPTANCE}, '|') AS acceptance FROM p")
def c9_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _prompts(spark, sf_dir).select("id", lint.objective(t).alias("objective"), lint.deliverable(t).alias("deliverable"), F.array_join(lint.acceptance(t), "|").alias("acceptance"))


def _listed(items: str, placeholder: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN '{placeholder}' ELSE array_to_string(['- ' || x FOR x IN {items}], chr(10)) END"


_NL2 = "chr(10) || chr(10)"
_REWRITE = f""" 'Objective' || chr(10) || {_OBJECTIVE} || {_NL2} || 'Scope' || chr(10) || CASE WHEN len(paths) = 0 THEN {_quoted(lint.NARROW)} ELSE 'Focus on: ' || array_to_string(paths, ', ') END
 || {_NL2} || 'Constraints' || chr(10) || {_listed('cons', lint.NO_CONSTRAINTS)} || {_NL2} || 'Relevant Files or Modules' || chr(10) || {_listed('paths', lint.NO_PATHS)}
 || {_NL2} || 'Deliverable' || chr(10) || {_DELIVERABLE} || {_NL2} || 'Acceptance Criteria' || chr(10) || {_listed(_ACCEPTANCE, lint.NO_CRITERIA)}"""
_ANY_FINDING = " OR ".join(f"({r[0]})" for r in _RULES)


@query(f"""WITH {_PROMPTS}, {_PARTS}, q AS (SELECT *, {_CONSTRAINTS} AS cons FROM p), r AS (SELECT id, text, {_REWRITE} AS rewrite, ({_ANY_FINDING}) AS hit FROM q)
SELECT id, rewrite, CASE WHEN NOT hit THEN '+ ' || replace(rewrite, chr(10), chr(10) || '+ ') ELSE array_to_string(['- ' || {sql_trim('x')} FOR x IN ({sql_lines('text')})[:8]], chr(10)) || chr(10) || array_to_string(['+ ' || x FOR x IN ({sql_lines('rewrite')})[:12]], chr(10)) END AS diff FROM r""")
def c10_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    parts = lint.with_parts(_prompts(spark, sf_dir)).withColumn("rewrite", lint.rewrite(t))
    return parts.select("id", "rewrite", lint.preview(t, F.col("rewrite")).alias("diff"))


_ACTION = f"[x FOR x IN rows IF {sql_any('lower(x)', detect.ACTION_WORDS)}][1]"
_APPROACH = f"[x FOR x IN rows IF starts_with(x, 'tried ') OR starts_with(x, 'attempted ') OR contains(x, {_quoted('didn' + chr(39) + 't work')}) OR contains(x, 'failed approach')]"


@query(f"""WITH {_PROMPTS}, {_PARTS} SELECT id, array_to_string({_APPROACH}, '|') AS failed, {_ACTION} AS first_action, array_to_string([x FOR x IN rows IF {sql_any('x', ['must', 'do not', 'never', 'safe mode'])}], '|') AS hard,
CASE WHEN length({sql_trim('text')}) > 320 THEN left({sql_trim('text')}, 320) || '...' ELSE {sql_trim('text')} END AS turn FROM p""")
def c12_c14_f6_session_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _prompts(spark, sf_dir).select("id", F.array_join(lint.failed_approaches(t), "|").alias("failed"), lint.first_action(t).alias("first_action"), F.array_join(lint.hard_constraints(t), "|").alias("hard"), lint.turn(t).alias("turn"))
