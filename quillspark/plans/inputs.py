"""Inputs derived from the tables, alike in Spark and in SQL: developer-session texts at any scale.

Each user's events, in order, become the lines of one log; a line is chosen by
the event's number from the lines of the log's kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Our own fixture lines by kind; # stands for a small number.
LOG_LINES = {
    "stack_trace": [
        "TypeError: Cannot read properties of undefined (reading 'id#')",
        "    at loadUser (/srv/app/src/user#.ts:14:9)",
        "    at Module._compile (node:internal/modules/cjs/loader:1105:14)",
        "    at Module._compile (node:internal/modules/cjs/loader:1105:14)",
        "   #: std::rt::lang_start",
        "",
        "  12: core::panicking::panic_fmt",
        "thread 'main' panicked at src/lib.rs:#:5: Error: oops v1.2.#",
    ],
    "test_log": [
        "$ npm test -- --ci",
        "PASS src/tests/a#.test.ts",
        "PASS src/tests/b#.test.ts",
        "....",
        "FAIL src/tests/c#.test.ts",
        "  renders the title",
        "    AssertionError: expected # to be 4",
        "",
        "test core::case_# ... ok",
        "Tests: # failed, 12 passed",
        "  ✓ works for #",
    ],
    "build_log": [
        "$ cargo build --release",
        "   Compiling serde v1.0.#",
        "   Compiling local-crate",
        "  Downloading crates ...",
        "error[E030#]: mismatched types",
        "  --> src/main.rs:#:9",
        "  |",
        "12 |     let x: u32 = \"a\";",
        "",
        "warning: unused variable `x#`",
        "added # packages in 2s",
        "dist/app#.js 12.5 kB",
        "[=====>    ] #0%",
        "Finished dev in #s",
        "plain note line #",
    ],
    "lint_output": [
        "$ cargo clippy",
        "warning[clippy::needless_return]: unneeded `return`",
        "  --> src/a.rs:#:5",
        "warning[clippy::unused]: unused import",
        "  --> src/b.rs:1#:2",
        "error[E0308]: mismatched types",
        "   = note: expected u32",
        "",
        "stray line #",
        "# warnings emitted",
    ],
    "config": [
        "[server#]",
        "# plain comment",
        "; old comment",
        "# TODO tune this",
        "host = \"10.0.0.#\"",
        "port: 80#0",
        "",
        "// see /etc/app/conf",
        "version = \"v1.#.0\"",
    ],
    "prompt": [
        "Fix the login bug in src/auth/session#.py.",
        "You must not change the public API.",
        "- keep the tests green",
        "Look at the entire repo if needed.",
        "mission: ship it",
        "hard requirements apply",
        "",
        "tried a cache, it didn't work",
        "Never retry failed jobs.",
        "Verify with pytest, update STATUS.md",
    ],
}
KINDS = list(LOG_LINES)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, kind, line)."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("user_id") % len(KINDS)).cast("int") + 1)
    line = F
    for i, k in enumerate(KINDS):
        items = F.array(*[F.lit(x) for x in LOG_LINES[k]])
        line = line.when(F.col("user_id") % len(KINDS) == i, F.element_at(items, (F.col("event_id") % len(LOG_LINES[k])).cast("int") + 1))
    digit = (F.floor(F.col("event_id") / 16) % 3).cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", kind.alias("kind"), F.replace(line, F.lit("#"), digit).alias("line"))


def logs(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(id, kind, text)."""
    rows = log_lines(spark, sf_dir)
    if kind:
        rows = rows.where(F.col("user_id") % len(KINDS) == KINDS.index(kind)).where(F.col("kind") == kind)
    return rows.groupBy(F.col("user_id").alias("id"), "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case() -> str:
    n = len(KINDS)
    rows = [f"WHEN {i} THEN [{', '.join(map(_quoted, LOG_LINES[k]))}][event_id % {len(LOG_LINES[k])} + 1]" for i, k in enumerate(KINDS)]
    return f"CASE user_id % {n} {' '.join(rows)} END"


#: CTEs log_lines(user_id, event_id, kind, line) and logs(id, kind, text).
LOGS_SQL = f"""
log_lines AS (SELECT user_id, event_id, [{', '.join(map(_quoted, KINDS))}][user_id % {len(KINDS)} + 1] AS kind,
  replace({_case()}, '#', ((event_id // 16) % 3)::VARCHAR) AS line FROM events),
logs AS (SELECT user_id AS id, kind, string_agg(line, chr(10) ORDER BY event_id) AS text FROM log_lines GROUP BY user_id, kind)
"""


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): each user's properties as one JSON document."""
    k = F.get_json_object("props", "$.k")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", k.cast("int").alias("k")))).alias("r"))
    items = F.array_join(F.transform("r", lambda x: F.concat(F.lit('{"k": '), (x["k"] % 4).cast("string"), F.lit("}"))), ",\n")
    return rows.select("id", F.concat(F.lit('{"version": "1.2.3", "items": ['), items, F.lit('],\n"empty": {},\n"user": '), F.col("id").cast("string"), F.lit("}")).alias("text"))


PROPS_SQL = """
props_json AS (SELECT user_id AS id, '{"version": "1.2.3", "items": [' || string_agg('{"k": ' || ((props::JSON->>'k')::INT % 4) || '}', ',' || chr(10) ORDER BY event_id) || '],' || chr(10) || '"empty": {},' || chr(10) || '"user": ' || user_id || '}' AS text
  FROM events GROUP BY user_id)
"""


def sql_lines(t: str) -> str:
    """The lines of a text, as a DuckDB list."""
    s = f"string_split(replace({t}, chr(13) || chr(10), chr(10)), chr(10))"
    return f"(CASE WHEN {s}[-1] = '' THEN {s}[1:len({s}) - 1] ELSE {s} END)"


_BLANK = r"[\s\x0b\p{Z}\x85]"


def sql_trim(s: str) -> str:
    return rf"regexp_replace({s}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def sql_words(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '[^\s\x0b\p{{Z}}\x85]+'))"


def sql_trimmed_lines(t: str) -> str:
    return f"[y FOR y IN [{sql_trim('x')} FOR x IN {sql_lines(t)}] IF y <> '']"


def sql_any(t: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {_quoted(n)})" for n in needles) + ")"


def sql_distinct(items: str) -> str:
    """Distinct elements in order of first appearance."""
    return f"(SELECT coalesce(list(v ORDER BY p), []) FROM (SELECT v, min(p) AS p FROM (SELECT unnest({items}) AS v, generate_subscripts({items}, 1) AS p) GROUP BY v))"


def sql_estimate(t: str, family: str = "claude") -> str:
    """Estimated tokens of a text expression."""
    from ..functions.tokens import CHARS_PER_TOKEN, CODE_MARKS

    code, prose = CHARS_PER_TOKEN[family]
    biased = rf"(len(regexp_replace({t}, '[^{{}}\[\]();:/\\<>=+\-*_.]', '', 'g')) / greatest(length({t}), 1)::DOUBLE > 0.11::DOUBLE OR {sql_any(t, CODE_MARKS)})"
    n = f"greatest(len({sql_lines(t)}), 1)"
    pick = lambda a, b: f"(CASE WHEN {biased} THEN {a}::DOUBLE ELSE {b}::DOUBLE END)"
    line = f"(CASE WHEN {biased} THEN least({n} * 0.15::DOUBLE, 24.0::DOUBLE) ELSE least({n} * 0.05::DOUBLE, 10.0::DOUBLE) END)"
    total = f"0.58::DOUBLE * (length({t})::DOUBLE / {pick(code, prose)}) + 0.42::DOUBLE * ({sql_words(t)}::DOUBLE * {pick(1.45, 1.28)}) + len(regexp_replace({t}, '[^0-9]', '', 'g')) * 0.02::DOUBLE + {line}"
    return f"(CASE WHEN {t} = '' THEN 0 ELSE greatest(1, round({total}))::INT END)"
