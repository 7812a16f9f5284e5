"""Queries over texts: token estimates, detection, reduction.  SQL is written separately from the DataFrame code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, tokens
from ..functions import text as T
from ..operators import reduce as R
from .inputs import LOGS_SQL, PROPS_SQL, _quoted, logs, props_json, sql_any, sql_distinct, sql_estimate, sql_lines, sql_trim, sql_trimmed_lines, sql_words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- A: token estimates


@query(f"""SELECT lang, count(*)::BIGINT AS n_docs, sum(e)::BIGINT AS estimated_tokens, round(avg(e), 4) AS avg_tokens
FROM (SELECT lang, {sql_estimate('text')} AS e FROM documents WHERE text IS NOT NULL) GROUP BY lang""")
def a1_token_estimate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "documents").where("text is not null").select("lang", tokens.estimated(F.col("text")).alias("e"))
    return e.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("e").alias("estimated_tokens"), F.round(F.avg("e"), 4).alias("avg_tokens"))


_CONV = "conversations WHERE text IS NOT NULL"


@query(f"""SELECT conv_id, turn, estimated_tokens, (CASE WHEN estimated_tokens = 0 THEN 0 ELSE greatest(estimated_tokens - spread, 0) END)::INT AS lower_bound,
  (estimated_tokens + spread)::INT AS upper_bound, bytes, chars, words, lines FROM (
  SELECT conv_id, turn, {sql_estimate('text', 'generic')} AS estimated_tokens,
  ceil({sql_estimate('text', 'generic')} * (CASE WHEN length(text) < 120 THEN 0.18::DOUBLE WHEN len(regexp_replace(text, '[^{{}}\\[\\]();:/\\\\<>=+\\-*_.]', '', 'g')) / greatest(length(text), 1)::DOUBLE > 0.11::DOUBLE
    OR {sql_any('text', tokens.CODE_MARKS)} THEN 0.14::DOUBLE ELSE 0.12::DOUBLE END))::INT AS spread,
  strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, {sql_words('text')}::BIGINT AS words,
  (CASE WHEN text = '' THEN 0 ELSE greatest(len({sql_lines('text')}), 1) END)::BIGINT AS lines FROM {_CONV})""")
def a1_token_estimate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", tokens.estimate(F.col("text"), "generic").alias("e"))
    return out.select("conv_id", "turn", *[f"e.{c}" for c in ("estimated_tokens", "lower_bound", "upper_bound", "bytes", "chars", "words", "lines")])


@query(f"""SELECT item_id, {', '.join(f"{sql_estimate('text', f)} AS {f}" for f in tokens.CHARS_PER_TOKEN)} FROM benchmark""")
def a1_token_estimate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", *[tokens.estimated(F.col("text"), f).alias(f) for f in tokens.CHARS_PER_TOKEN])


@query(f"""SELECT conv_id, turn, greatest(1, length(text) // 4)::INT AS quarter_chars, floor({sql_words('text')} * 1.3::DOUBLE)::INT AS words_13, (len({sql_lines('text')}) * 8)::INT AS line_cost FROM {_CONV}""")
def a2_a4_simple_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", tokens.approx_tokens(t).alias("quarter_chars"), tokens.word_tokens(t).alias("words_13"), tokens.line_cost(t).alias("line_cost"))


@query("""SELECT user_id, noise, ((CASE WHEN noise > 1000 THEN 10000 WHEN noise > 100 THEN noise * 100 // 10 ELSE noise * 50 END) * 5 + 53000)::BIGINT AS saved
FROM (SELECT user_id, count(*) FILTER (event_type <> 'purchase')::BIGINT * 3 AS noise FROM events GROUP BY user_id)""")
def a5_repo_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = _read(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "purchase") * 3).alias("noise"))
    return noise.withColumn("saved", tokens.repo_saving(F.col("noise")))


@query(f"""SELECT role, round(sum(greatest(1, length(text) // 4)) * (CASE role WHEN 'assistant' THEN 15.0::DOUBLE ELSE 3.0::DOUBLE END) / 1e6, 8) AS usd FROM {_CONV} GROUP BY role""")
def a6_cost_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").where("text is not null").groupBy("role").agg(F.sum(tokens.approx_tokens(F.col("text"))).alias("n"))
    usd = F.when(F.col("role") == "assistant", tokens.cost(F.col("n"), "output")).otherwise(tokens.cost(F.col("n"), "input"))
    return rows.select("role", F.round(usd, 8).alias("usd"))


# -- B: detection

_HEAD = r"regexp_replace(x, '^[\s\x0b\p{Z}\x85]+', '')"
_AT = rf"len([x FOR x IN {sql_lines('text')} IF starts_with({_HEAD}, 'at ')])"
_FRAMES = rf"len([x FOR x IN {sql_lines('text')} IF starts_with({_HEAD}, '0:') OR (regexp_matches({_HEAD}, '^[0-9]') AND contains(x, '::'))])"


def _c(x: str) -> str:
    return f"contains(text, {_quoted(x)})"


def _sum(parts: list[tuple[str, float]]) -> str:
    out = "0.0::FLOAT"
    for hit, w in parts:
        out = f"({out} + CASE WHEN {hit} THEN {w}::FLOAT ELSE 0.0::FLOAT END)"
    return f"least({out}, 1.0::FLOAT)"


_RUST = f"({_c('stack backtrace:')} OR {_c('panicked at')})"
_SCORES = {
    "stack_trace": _sum([(_c("Traceback (most recent call last)"), 0.65), (f"{_AT} >= 3", 0.55), (f"{_AT} BETWEEN 1 AND 2", 0.25), (_RUST, 0.5), (f"{_RUST} AND {_FRAMES} >= 3", 0.2), (sql_any("text", ["Error:", "Exception"]), 0.2)]),
    "test_log": _sum([
        (sql_any("text", ["PASS ", "FAIL "]), 0.5), (sql_any("text", ["Test Suites:", "Ran all test suites"]), 0.35), (sql_any("text", ["AssertionError", "expected"]), 0.2),
        (f"({_c('✓ ')} AND {_c('✗ ')}) OR {_c('Test Files')}", 0.5), (f"{_c('test result: ok.')} OR {_c('test result: FAILED')} OR ({_c('running ')} AND {_c(' tests')})", 0.5),
        (f"({_c('passed')} AND {_c('failed')}) OR {_c('PASSED')} OR {_c('FAILED')}", 0.4)]),
    "build_log": _sum([
        (f"{_c('Compiling ')} AND {_c(' v')}", 0.55), (sql_any("text", ["error[E", "warning["]), 0.3), (f"{_c('added ')} AND {_c(' packages')}", 0.45), (sql_any("text", ["npm warn", "npm ERR!"]), 0.3),
        (f"{_c('webpack compiled')} OR ({_c('vite')} AND ({_c('build')} OR {_c('transforming')}))", 0.45), (f"{_c('chunk ')} AND {_c(' kB')}", 0.3), (f"{_c('error TS')} OR ({_c('tsc')} AND {_c('--')})", 0.4),
        (sql_any("text", ["go build", "go: downloading"]), 0.4), (sql_any("text", ["> Task :", "BUILD SUCCESSFUL", "BUILD FAILED"]), 0.45), (sql_any("text", ["[INFO] Building ", "[INFO] BUILD ", "[ERROR]"]), 0.4), (_c("Downloading "), 0.15),
        (sql_any("text", ["$ cargo build", "$ npm run build", "$ pnpm build", "$ yarn build", "$ go build", "$ gradle", "$ mvn", "$ tsc"]), 0.2)]),
    "lint_output": _sum([
        (sql_any("text", ["warning[", "error["]), 0.5), (rf"{_c('eslint')} OR len(regexp_extract_all(text, '(?m)^\s*\d+:\d+\s+(?:error|warning)\s+')) > 0", 0.4),
        (rf"{_c('pylint')} OR {_c('flake8')} OR len(regexp_extract_all(text, '[CWERFI]\d{{4}}[:\s]')) > 0", 0.4), (_c("error TS"), 0.4), ("len(regexp_extract_all(text, '(?:warning|error):')) >= 3", 0.3)]),
    "json": "(CASE WHEN json_valid(text) THEN 0.95 ELSE 0.0 END)::FLOAT",
    "config": f"(CASE WHEN NOT ({_AT} >= 2 AND {sql_any('text', ['Error:', 'Exception', 'Traceback (most recent call last)'])}) AND len([y FOR y IN {sql_trimmed_lines('text')} IF (starts_with(y, '[') AND ends_with(y, ']')) OR contains(y, '=') OR contains(y, ':')]) > 0 THEN 0.7 ELSE 0.0 END)::FLOAT",
}
_TEXTS_SQL = f"{LOGS_SQL}, {PROPS_SQL}, texts AS (SELECT id, kind, text FROM logs UNION ALL SELECT id + 1000000, 'json', text FROM props_json)"
_SCORED_SQL = f"WITH {_TEXTS_SQL}, scored AS (SELECT id, kind, text, {', '.join(f'{e} AS s_{k}' for k, e in _SCORES.items())} FROM texts)"
_BEST_SQL = "greatest(" + ", ".join(f"s_{k}" for k in _SCORES) + ")"
_KIND_SQL = "CASE " + " ".join(f"WHEN s_{k} = {_BEST_SQL} THEN '{k}'" for k in reversed(_SCORES)) + " END"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = props_json(spark, sf_dir).select((F.col("id") + 1000000).alias("id"), F.lit("json").alias("kind"), "text")
    return logs(spark, sf_dir).unionByName(extra)


@query(f"{_SCORED_SQL} SELECT id, {', '.join(f'round(s_{k}::DOUBLE, 4) AS {k}' for k in _SCORES)} FROM scored")
def b1_b6_detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _texts(spark, sf_dir).select("id", detect.scores(F.col("text")).alias("s"))
    return s.select("id", *[F.round(F.col(f"s.{k}").cast("double"), 4).alias(k) for k in detect.KINDS])


@query(f"{_SCORED_SQL} SELECT id, {_KIND_SQL} AS detected, round({_BEST_SQL}::DOUBLE, 4) AS confidence FROM scored WHERE {_BEST_SQL} > 0")
def b7_detect_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _texts(spark, sf_dir).select("id", detect.best(detect.scores(F.col("text"))).alias("b")).where("b is not null")
    return best.select("id", F.col("b.kind").alias("detected"), F.round(F.col("b.score").cast("double"), 4).alias("confidence"))


_PROMPTISH = f"len({sql_lines('text')}) >= 2 AND {sql_any('lower(text)', detect.ACTION_WORDS)}"
_CLASS_SQL = "CASE " + " ".join(f"WHEN detected = '{k}' THEN '{v}'" for k, v in detect.CLASS_OF.items()) + " END"


@query(f"""{_SCORED_SQL}, b AS (SELECT id, kind, text, {_KIND_SQL} AS detected, {_BEST_SQL} AS best FROM scored)
SELECT id, CASE WHEN id % 10 = 0 THEN 'hint' ELSE 'text' END AS source,
  CASE WHEN id % 10 = 0 THEN coalesce(CASE WHEN kind = 'prompt' THEN 'unknown' ELSE {_CLASS_SQL.replace('detected', 'kind')} END, 'unknown') WHEN best >= 0.55::FLOAT THEN {_CLASS_SQL} WHEN {_PROMPTISH} THEN 'prompt' ELSE 'unknown' END AS class,
  CASE WHEN id % 10 = 0 THEN kind WHEN best >= 0.55::FLOAT THEN detected END AS kind,
  CASE WHEN id % 10 = 0 THEN 1.0 WHEN best >= 0.55::FLOAT THEN round(best::DOUBLE, 4) WHEN {_PROMPTISH} THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM b""")
def b8_b10_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text comes with its kind as a hint."""
    hinted = F.col("id") % 10 == 0
    t = _texts(spark, sf_dir).withColumn("best", detect.best(detect.scores(F.col("text"))))
    got = detect.classify(F.col("text"), F.col("best"), F.when(hinted, F.col("kind")))
    return t.select("id", F.when(hinted, "hint").otherwise("text").alias("source"), got.alias("c")).select("id", "source", "c.*")


# -- B: reduction


@query(f"""WITH {LOGS_SQL} SELECT id, array_to_string([x FOR x, i IN L IF NOT ({sql_trim('x')} = '' AND i > 1 AND {sql_trim('L[i - 1]')} = '')], chr(10)) AS collapsed
FROM (SELECT id, {sql_lines('text')} AS L FROM logs)""")
def b19_blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("id", F.array_join(T.collapse_blank(T.lines(F.col("text"))), "\n").alias("collapsed"))


_COMMANDS_SQL = f"{sql_distinct(f'[y FOR y IN {sql_trimmed_lines(chr(116) + chr(101) + chr(120) + chr(116))} IF strlen(y) <= 200 AND regexp_matches(y, {_quoted(R.COMMANDS)})]')}"


def _matches_sql(pattern: str) -> str:
    return sql_distinct(f"regexp_extract_all(text, {_quoted(pattern)})")


_VALUES_SQL = f"SELECT id, text, {_COMMANDS_SQL} AS commands, {_matches_sql(R.PATHS)} AS paths, {_matches_sql(R.VERSIONS)} AS versions, {_matches_sql(R.IDENTIFIERS)} AS identifiers"

_PROTECTED_SQL = f"({_COMMANDS_SQL} || {_matches_sql(R.PATHS)} || {_matches_sql(R.VERSIONS)} || {_matches_sql(R.IDENTIFIERS)})"


@query(f"WITH {LOGS_SQL}, v AS ({_VALUES_SQL} FROM logs) SELECT id, array_to_string(commands, '|') AS commands, array_to_string(paths, '|') AS paths, array_to_string(versions, '|') AS versions, array_to_string(identifiers, '|') AS identifiers FROM v")
def b20_b22_protected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    parts = {"commands": R.command_lines(t), "paths": T.matches(t, R.PATHS), "versions": T.matches(t, R.VERSIONS), "identifiers": T.matches(t, R.IDENTIFIERS)}
    return logs(spark, sf_dir).select("id", *[F.array_join(c, "|").alias(k) for k, c in parts.items()])


@query("""SELECT doc_id, array_to_string(v, '|') AS versions FROM (SELECT doc_id, (SELECT list(x ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(m) AS x, generate_subscripts(m, 1) AS p) GROUP BY x)) AS v
FROM (SELECT doc_id, regexp_extract_all(text, '\\bv?\\d+\\.\\d+(?:\\.\\d+)?(?:[-+][A-Za-z0-9.\\-]+)?\\b') AS m FROM documents) WHERE len(m) > 0)""")
def b21_document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.matches(F.col("text"), R.VERSIONS)
    return _read(spark, sf_dir, "documents").select("doc_id", v.alias("v")).where("size(v) > 0").select("doc_id", F.array_join("v", "|").alias("versions"))


def _finish_sql(full: bool, fail_open: bool = True) -> str:
    """CTE tail: from body(id, text, b) to the reduced text."""
    lost = "[x FOR x IN list_concat(commands, paths, versions, identifiers) IF NOT contains(b, x)]"
    once = "[x FOR x, i IN lost IF i = 1 OR x <> lost[i - 1]]"
    appended = rf"CASE WHEN len(lost) = 0 THEN b ELSE regexp_replace(b, '[\s\x0b\p{{Z}}\x85]+$', '') || chr(10) || chr(10) || '{R.PRESERVED_HEAD}' || chr(10) || array_to_string(['- ' || x || chr(10) FOR x IN {once}], '') END"
    values = f"v AS ({_VALUES_SQL}, b FROM body), w AS (SELECT *, {lost} AS lost FROM v), fin AS (SELECT id, text, {appended} AS r FROM w)" if full else "fin AS (SELECT id, text, b AS r FROM body)"
    keep = "CASE WHEN r <> text AND after_tokens >= before_tokens THEN text ELSE r END" if fail_open else "CASE WHEN r = '' THEN text ELSE r END"
    after = "CASE WHEN r <> text AND after_tokens >= before_tokens THEN before_tokens ELSE after_tokens END" if fail_open else "after_tokens"
    return f", {values}, est AS (SELECT *, {sql_estimate('text')} AS before_tokens, {sql_estimate('r')} AS after_tokens FROM fin) SELECT id, {keep} AS reduced, before_tokens, {after} AS after_tokens FROM est"


def _of(kind: str) -> str:
    return f"WITH {LOGS_SQL}, src AS (SELECT id, text FROM logs WHERE kind = '{kind}'), ex AS (SELECT id, text, generate_subscripts(L, 1) AS n, unnest(L) AS line FROM (SELECT id, text, {sql_lines('text')} AS L FROM src)), ln AS (SELECT *, {sql_trim('line')} AS t FROM ex)"


_COLLAPSE = f"array_to_string([x FOR x, i IN L IF NOT ({sql_trim('x')} = '' AND i > 1 AND {sql_trim('L[i - 1]')} = '')], chr(10))"


def _body(notes: list[tuple[str, str]] = ()) -> str:
    """From kept(id, n, out) and counters(id, ...) to body."""
    tail = "".join(f" || CASE WHEN {c} > 0 THEN chr(10) || printf({_quoted(t)}, {c}) ELSE '' END" for c, t in notes)
    counts = ", counters AS (SELECT id, " + ", ".join(f"count(*) FILTER (kind = '{c}') AS {c}" for c, _ in notes) + " FROM ruled GROUP BY id)" if notes else ""
    using = "JOIN counters USING (id)" if notes else ""
    # lines and summaries are joined by line breaks, without one in front where no line is left
    return f"""{counts}, lists AS (SELECT id, list(out ORDER BY n) AS L FROM kept GROUP BY id), body AS (
  SELECT s.id, s.text, ltrim_break(coalesce({_COLLAPSE}, ''){tail}, l.L) AS b FROM src s LEFT JOIN lists l USING (id) {using})""".replace("ltrim_break(", "(").replace(", l.L)", ")")


_CONFIG_IGNORE = "(starts_with(t, '#') OR starts_with(t, ';') OR starts_with(t, '//')) AND NOT " + sql_any("t", [*R.COMMENT_MARKS, "/", "v1.", "v2."])


@query(f"{_of('config')}, kept AS (SELECT id, n, CASE WHEN t = '' THEN '' ELSE line END AS out FROM ln WHERE NOT ({_CONFIG_IGNORE})){_body()}{_finish_sql(full=True)}")
def b18_config_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.config(logs(spark, sf_dir, "config")).select("id", "reduced", "before_tokens", "after_tokens")


_INTERNAL = sql_any("t", ["/rustc/", "library/std/", "library/core/", "library/alloc/", "rust_begin_unwind", "core::panicking::", "std::rt::", "std::sys::", "__libc_start_main", "(internal/", "(node:"])


@query(f"""{_of('stack_trace')}, f AS (SELECT *, t <> '' AND ({_INTERNAL} OR ends_with(t, ': _start') OR (ends_with(t, ': main') AND NOT contains(t, '::'))) AS internal FROM ln),
g AS (SELECT *, sum(CASE WHEN t <> '' AND line = coalesce(pl, '') AND pl IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS run, sum(CASE WHEN internal AND pi THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS zone
  FROM (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY n) AS pl, coalesce(lag(internal) OVER (PARTITION BY id ORDER BY n), false) AS pi FROM f)),
h AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS rs, min(n) OVER (PARTITION BY id, run) AS r0, max(n) OVER (PARTITION BY id, zone) AS z1 FROM g),
k AS (SELECT *, min(CASE WHEN internal AND rs = 1 THEN n END) OVER (PARTITION BY id, zone) AS t0 FROM h),
m AS (SELECT *, CASE WHEN internal AND n >= t0 AND z1 > t0 THEN z1 - t0 + 1 END AS tail FROM k),
kept AS (SELECT id, n * 2 AS n, CASE WHEN t = '' THEN '' WHEN tail IS NOT NULL THEN printf('{R.MARK} collapsed %d internal runtime frames', tail) ELSE line END AS out FROM m WHERE t = '' OR (tail IS NOT NULL AND n = t0) OR (tail IS NULL AND (rs = 1 OR n = r0))
  UNION ALL SELECT id, n * 2 + 1, printf('{R.MARK} collapsed %d duplicate stack lines', rs - 1) FROM m WHERE t <> '' AND tail IS NULL AND rs > 1 AND n = r0){_body()}{_finish_sql(full=True, fail_open=False)}""")
def b12_stack_trace_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stack_trace(logs(spark, sf_dir, "stack_trace")).select("id", "reduced", "before_tokens", "after_tokens")


def _starts(heads: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(t, {_quoted(h)})" for h in heads) + ")"


_STATE = "coalesce(last_value(effect IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


@query(rf"""{_of('test_log')}, c AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^[.·]+$') THEN 'progress'
  WHEN regexp_matches(t, '^(?:PASS|ok)\s+(.+)$') OR regexp_matches(t, '^\s*[✓✔]\s+(.+)$') OR (starts_with(t, 'test ') AND ends_with(t, ' ... ok')) THEN 'passed'
  WHEN {_starts(['FAIL ', 'ERROR ', 'FAILED', '✗ ', '× ', '✘ '])} OR (starts_with(t, 'test ') AND ends_with(t, ' ... FAILED')) THEN 'fail'
  WHEN {_starts(['$ ', '> ', 'npm ', 'pnpm ', 'cargo ', 'pytest '])} OR regexp_matches(t, '^(?:Test Suites:|Tests:|Snapshots:|Time:|Ran all test suites|test result:|Test Files\s|Duration\s)') THEN 'summary'
  WHEN {sql_any('t', ['Error', 'error[', 'Expected:', 'Received:', 'panicked at'])} OR starts_with(t, 'at ') THEN 'detail' ELSE 'other' END AS kind FROM ln),
e AS (SELECT *, CASE WHEN kind IN ('fail', 'detail') THEN true WHEN kind IN ('passed', 'summary') THEN false END AS effect FROM c), ruled AS (SELECT *, {_STATE} AS inside FROM e),
kept AS (SELECT id, n, CASE kind WHEN 'blank' THEN '' ELSE line END AS out FROM ruled WHERE kind IN ('fail', 'summary', 'detail') OR (inside AND kind IN ('blank', 'other')))
{_body([('passed', f'{R.MARK} %d tests passed (collapsed)'), ('progress', f'{R.MARK} progress_lines_removed=%d')])}{_finish_sql(full=False)}""")
def b14_test_log_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.test_log(logs(spark, sf_dir, "test_log")).select("id", "reduced", "before_tokens", "after_tokens")


def _re(pattern: str) -> str:
    return f"regexp_matches(t, {_quoted(pattern)})"


_BUILD_NOTES = [("compile", f"{R.MARK} %d crates compiled (collapsed)"), ("download", f"{R.MARK} %d packages downloaded (collapsed)"), ("install", f"{R.MARK} %d npm install lines (collapsed)"), ("chunk", f"{R.MARK} %d chunk/asset listings (collapsed)"), ("progress", f"{R.MARK} progress_lines_removed=%d")]


@query(rf"""{_of('build_log')}, c AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN {_re(R.BUILD_COMMAND)} THEN 'command' WHEN {_re(R.BUILD_SUMMARY)} THEN 'diagnostic'
  WHEN {sql_any('t', ['expected', 'found', 'help:', 'note:'])} OR {_starts(['--> ', '| ', '|^'])} THEN 'context' END AS head,
  CASE WHEN {_re('^\\s*Compiling\\s+\\S+\\s+v[\\d.]+')} THEN 'compile' WHEN {_re('^\\s*Downloading\\s+')} THEN 'download' WHEN {_re(R.BUILD_PROGRESS)} OR {_re(R.BUILD_SPINNER)} THEN 'progress'
  WHEN {_re(R.BUILD_INSTALL)} THEN 'install' WHEN {_re(R.BUILD_CHUNK)} THEN 'chunk' WHEN starts_with(t, 'Compiling ') THEN 'compile' ELSE 'other' END AS plain,
  regexp_matches(t, '^[0-9]') OR starts_with(t, '...') AS numbered FROM ln),
e AS (SELECT *, CASE WHEN head IN ('diagnostic', 'context') THEN true WHEN head = 'command' OR (head IS NULL AND NOT numbered) THEN false END AS effect FROM c), s AS (SELECT *, {_STATE} AS inside FROM e),
ruled AS (SELECT *, CASE WHEN head IS NOT NULL THEN head WHEN inside AND numbered THEN 'numbered' ELSE plain END AS kind FROM s),
kept AS (SELECT id, n, CASE kind WHEN 'blank' THEN '' ELSE line END AS out FROM ruled WHERE kind IN ('command', 'diagnostic', 'context', 'numbered', 'other') OR (inside AND kind = 'blank'))
{_body(_BUILD_NOTES)}{_finish_sql(full=False)}""")
def b15_build_log_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_log(logs(spark, sf_dir, "build_log")).select("id", "reduced", "before_tokens", "after_tokens")


_RULE = r"(CASE WHEN regexp_extract(t, 'warning\[([^\]]+)\]', 1) <> '' THEN regexp_extract(t, 'warning\[([^\]]+)\]', 1) ELSE t END)"


@query(rf"""{_of('lint_output')}, c AS (SELECT *, CASE WHEN {_re('^(?:\\$\\s|>\\s)')} THEN 'command' WHEN {_re(R.LINT_SUMMARY)} THEN 'summary' WHEN {_re('(?i)^(?:error\\[|error:|error TS|error!)')} THEN 'error' WHEN {_re('(?i)^(?:warning\\[|warning:)')} THEN 'warning' END AS start,
  {_re(R.LINT_CONTEXT)} OR t = '' OR (regexp_matches(t, '^[0-9]') AND contains(t, '|')) AS ctx FROM ln),
b AS (SELECT *, sum(CASE WHEN start IS NOT NULL OR NOT ctx THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS blk FROM c),
bl AS (SELECT id, min(n) AS n0, arg_min(start, n) AS kind0, first(start ORDER BY n) AS kind, first({_RULE} ORDER BY n) AS rule, list(line ORDER BY n) AS lines, list(line ORDER BY n)[1] AS head,
  first(CASE WHEN regexp_extract(t, '-->\s+(\S+:\d+:\d+)', 1) <> '' AND start IS NULL THEN regexp_extract(t, '-->\s+(\S+:\d+:\d+)', 1) END ORDER BY (CASE WHEN regexp_extract(t, '-->\s+(\S+:\d+:\d+)', 1) <> '' AND start IS NULL THEN n ELSE 1000000000 + n END)) AS place,
  bool_or(start IS NOT NULL) AS opened FROM b GROUP BY id, blk),
ok AS (SELECT id, n0, kind, rule, CASE WHEN kind IN ('command', 'summary') THEN [head] ELSE lines END AS lines, place FROM bl WHERE opened AND kind IS NOT NULL),
grp AS (SELECT id, kind, CASE WHEN kind = 'warning' THEN rule ELSE n0::VARCHAR END AS key, min(n0) AS at0, arg_min(lines, n0) AS lines, list(place ORDER BY n0)[2:] AS others, count(*) AS k FROM ok GROUP BY ALL),
parts AS (SELECT id, CASE kind WHEN 'command' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS r, at0, CASE WHEN k > 1 THEN list_append(lines, '{R.MARK} ' || key || ': ' || CASE WHEN len([p FOR p IN others IF p IS NOT NULL]) = 0 THEN printf('%d more occurrences', k - 1)
  ELSE printf('%d more: ', k - 1) || array_to_string([p FOR p IN others IF p IS NOT NULL], ', ') END || ' (collapsed)') ELSE lines END AS lines FROM grp),
lists AS (SELECT id, flatten(list(lines ORDER BY r, at0)) AS L FROM parts GROUP BY id), body AS (SELECT s.id, s.text, coalesce({_COLLAPSE}, '') AS b FROM src s LEFT JOIN lists l USING (id)){_finish_sql(full=False)}""")
def b16_lint_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lint_output(logs(spark, sf_dir, "lint_output")).select("id", "reduced", "before_tokens", "after_tokens")


@query(f"""WITH {PROPS_SQL}, it AS (SELECT user_id AS id, (props::JSON->>'k')::INT % 4 AS k, min(event_id) AS p, count(*) AS c FROM events GROUP BY ALL),
g AS (SELECT id, sum(c)::BIGINT AS n, list({{'k': k, 'c': c}} ORDER BY p) AS u FROM it GROUP BY id),
shown AS (SELECT id, '"items": ' || n || ' entries' || CASE WHEN len(u) < n THEN ', ' || len(u) || ' distinct' ELSE '' END || array_to_string([chr(10) || '  ' || x.c || ' of' || chr(10) || '    "k": ' || x.k FOR x IN u[1:3]], '')
  || CASE WHEN len(u) > 3 THEN chr(10) || '  ' || (len(u) - 3) || ' further distinct in ' || list_sum([x.c FOR x IN u[4:]])::BIGINT || ' entries' ELSE '' END AS a FROM g),
body AS (SELECT p.id, p.text, CASE WHEN len({sql_lines('p.text')}) < 4 AND strlen(p.text) < 200 THEN p.text ELSE '"empty": {{}}' || chr(10) || a || chr(10) || '"user": ' || p.id || chr(10) || '"version": "1.2.3"' END AS b
  FROM props_json p JOIN shown USING (id)){_finish_sql(full=False)}""")
def b17_json_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.json_text(props_json(spark, sf_dir)).select("id", "reduced", "before_tokens", "after_tokens")


_REDUCED = {"stack_trace": "b12_stack_trace_reduce", "test_log": "b14_test_log_reduce", "build_log": "b15_build_log_reduce", "lint_output": "b16_lint_reduce", "json": "b17_json_reduce", "config": "b18_config_reduce"}


@query("SELECT kind, count(*)::BIGINT AS n, sum(before_tokens)::BIGINT AS before, sum(after_tokens)::BIGINT AS after, round(CASE WHEN sum(before_tokens) = 0 THEN 0.0 ELSE greatest(sum(before_tokens) - sum(after_tokens), 0)::FLOAT / sum(before_tokens)::FLOAT END::DOUBLE, 4) AS ratio FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, before_tokens, after_tokens FROM ({SQL[name]})" for kind, name in _REDUCED.items()) + ") GROUP BY kind")
def b23_b25_reduction_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings by kind over every text; the union of all reducers."""
    texts = _texts(spark, sf_dir)
    got = R.reduce_all(texts).join(texts.select("id", "kind"), "id")
    ratio = R.reduction_ratio(F.col("before"), F.col("after"))
    total = got.groupBy("kind").agg(F.count("*").alias("n"), F.sum("before_tokens").alias("before"), F.sum("after_tokens").alias("after"))
    return total.withColumn("ratio", F.round(ratio.cast("double"), 4))
