"""Queries of the code graph over files derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codegraph as G
from ..operators import index
from ..sources.tables import shared_folder
from .inputs import _quoted, sql_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


FOLDERS = ["src/auth", "src/components", "tests/unit", "app/admin", "pages/api", "cmd/server", "src/routes", "pkg/store/internal"]
NAMES = ["session_store", "UserCard", "page", "index", "login_guard", "test_parse", "mod", "rankTokens"]
ENDINGS = [".py", ".tsx", ".rs", ".ts", ".go", ".js", ".toml"]
#: Our own fixture lines of code, one list for all languages.
CODE = [
    "import os", "from app.core import run", "def handler_#():", "class Store#:", "    return #", "use std::fs::File#;", "pub fn parse_#() {}", "struct Token#;", "export function render#() {", "export const LIMIT# = 1;",
    'import { a } from "./lib/a#"', "func Serve#(w int) {", "type Client# struct {", '  "net/http"', "async def fetch_#():", "// note #",
]
EVENT_TYPES = ["view", "signup", "click", "error", "purchase"]


def _pick(items: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (at % len(items)).cast("int") + 1)


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, seq, ts, code): one touch of a file per event, with a line of code."""
    u, e = F.col("user_id"), F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type"))
    number = F.when(u % 3 == 0, "").otherwise(u.cast("string"))
    path = F.concat(_pick(FOLDERS, u), F.lit("/"), _pick(NAMES, u + e), number, _pick(ENDINGS, u * 3 + e))
    code = F.replace(_pick(CODE, F.col("event_id") + u), F.lit("#"), (F.floor(F.col("event_id") / 16) % 3).cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(path.alias("path"), F.col("event_id").alias("seq"), "ts", code.alias("code"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, mtime)."""
    rows = touched(spark, sf_dir).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("r"), F.max("ts").alias("mtime"))
    return rows.select("path", F.array_join(F.transform("r", lambda x: x["code"]), "\n").alias("content"), "mtime")


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


_E = f"list_position({_list(EVENT_TYPES)}, event_type)"
FILES_SQL = f"""
touched AS (SELECT {_list(FOLDERS)}[user_id % {len(FOLDERS)} + 1] || '/' || {_list(NAMES)}[(user_id + {_E}) % {len(NAMES)} + 1] || CASE WHEN user_id % 3 = 0 THEN '' ELSE user_id::VARCHAR END || {_list(ENDINGS)}[(user_id * 3 + {_E}) % {len(ENDINGS)} + 1] AS path,
  event_id AS seq, ts, replace({_list(CODE)}[(event_id + user_id) % {len(CODE)} + 1], '#', ((event_id // 16) % 3)::VARCHAR) AS code FROM events),
files AS (SELECT path, string_agg(code, chr(10) ORDER BY seq) AS content, max(ts) AS mtime FROM touched GROUP BY path)
"""
_EXT = "string_split(path, '.')[-1]"
_BASE = "string_split(path, '/')[-1]"
_CATEGORY = """CASE WHEN contains(path, '/test') OR contains(path, '.spec.') OR contains(path, '.test.') OR contains(path, '_test.go') OR contains(path, '_test.rs') OR ends_with(path, '_test.py') OR starts_with(path, 'test_') THEN 'test'
WHEN ends_with(path, '/lib.rs') THEN 'lib' WHEN ends_with(path, '/main.rs') THEN 'bin' WHEN ends_with(path, '/mod.rs') THEN 'module' WHEN contains(path, '/components/') THEN 'component'
WHEN contains(path, '/routes/') OR starts_with(path, 'app/') OR starts_with(path, 'pages/') THEN 'route' WHEN starts_with(path, 'cmd/') OR contains(path, '/cmd/') THEN 'bin' WHEN contains(path, '/internal/') OR starts_with(path, 'internal/') THEN 'internal'
WHEN contains(path, '/pkg/') OR starts_with(path, 'pkg/') THEN 'lib' WHEN ends_with(path, '__init__.py') THEN 'package' WHEN ends_with(path, '__main__.py') THEN 'bin' ELSE 'module' END"""
_MODULES = f"mods AS (SELECT path, MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in G.LANGUAGES.items())}}}[{_EXT}] AS language, {_CATEGORY} AS category, strlen(content)::BIGINT AS size_bytes FROM files WHERE {_EXT} IN ({', '.join(map(_quoted, G.LANGUAGES))}))"


@query(f"WITH {FILES_SQL}, {_MODULES} SELECT * FROM mods")
def d3_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.modules(files(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, {_MODULES}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS p FROM mods WHERE category NOT IN ('test', 'package'))
SELECT category, count(*)::BIGINT AS n, string_agg(path, ', ' ORDER BY path) FILTER (p <= 5) || CASE WHEN count(*) > 5 THEN printf(', ...+%d more', count(*) - 5) ELSE '' END AS line FROM r GROUP BY category""")
def d8_module_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.module_summary(G.modules(files(spark, sf_dir)))


@query(f"WITH {FILES_SQL} SELECT path, 'toml' AS format FROM files WHERE ends_with(path, '.toml')")
def d4_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.configs(files(spark, sf_dir))


@query(rf"WITH {FILES_SQL} SELECT path, regexp_replace({_BASE}, '\.[^.]*$', '') AS component FROM files WHERE ends_with(path, '.tsx') AND regexp_matches({_BASE}, '^\p{{Lu}}')")
def d5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(files(spark, sf_dir))


_BARE = r"regexp_replace(path, '\.(?:tsx|ts|jsx|js)$', '')"


@query(rf"""WITH {FILES_SQL}, r AS (SELECT path, CASE WHEN regexp_matches(path, '^app/.*/page\.(?:tsx|ts|jsx|js)$') THEN '/' || regexp_replace(path[5:], '/page\.[a-z]+$', '')
  WHEN regexp_matches(path, '^pages/.*\.(?:tsx|ts|jsx|js)$') THEN '/' || {_BARE}[7:] WHEN regexp_matches(path, '^src/routes/.*\.(?:tsx|ts|js)$') THEN '/' || regexp_replace({_BARE}[12:], '(?:/index)+$', '') END AS route FROM files)
SELECT route, path, CASE WHEN starts_with(path, 'app/') THEN 'next_app' WHEN starts_with(path, 'pages/') THEN 'next_pages' ELSE 'src_routes' END AS kind FROM r WHERE route IS NOT NULL""")
def d2_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.routes(files(spark, sf_dir))


_MANIFEST = """all_files AS (SELECT path, content FROM files UNION ALL SELECT 'package.json', '{"dependencies": {"react": "18"}}')"""


@query(f"""WITH {FILES_SQL}, {_MANIFEST}, n AS (SELECT count(*) FILTER (ends_with(path, '.rs'))::BIGINT AS rs, count(*) FILTER (ends_with(path, '.go'))::BIGINT AS go, count(*) FILTER (ends_with(path, '.py'))::BIGINT AS py,
count(*) FILTER (ends_with(path, '.ts') OR ends_with(path, '.tsx'))::BIGINT AS ts, count(*) FILTER (ends_with(path, '.js') OR ends_with(path, '.jsx'))::BIGINT AS js, count(*) FILTER (ends_with(path, '.java'))::BIGINT AS java FROM all_files)
SELECT 'react' AS framework, * FROM n""")
def d1_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(1).select(F.lit("package.json").alias("path"), F.lit('{"dependencies": {"react": "18"}}').alias("content"))
    return G.framework(files(spark, sf_dir).select("path", "content").unionByName(extra))


@query(f"WITH {FILES_SQL} SELECT DISTINCT string_split(path, '/')[1] AS folder FROM files")
def d7_top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(F.element_at(F.split("path", "/"), 1).alias("folder")).distinct()


_SRC = f"src AS (SELECT path, CASE {' '.join(f'WHEN {_EXT} = {_quoted(k)} THEN {_quoted(v)}' for k, v in G.GRAPH_LANGUAGE.items())} END AS lang, generate_subscripts(L, 1) AS line, unnest(L) AS s FROM (SELECT path, ({sql_lines('content')})[:20000] AS L FROM files))"


def _group(patterns: dict[str, str], n: int) -> str:
    return "CASE lang " + " ".join(f"WHEN {_quoted(k)} THEN regexp_extract(s, {_quoted(v)}, {n})" for k, v in patterns.items() if n == 1 or k in ("python", "javascript") or patterns is G.SYMBOLS) + " ELSE '' END"


_SYMBOLS = f"""ab AS (SELECT *, {_group(G.SYMBOLS, 1)} AS a, {_group(G.SYMBOLS, 2)} AS b FROM src WHERE lang IS NOT NULL),
symbols AS (SELECT CASE WHEN b <> '' THEN b ELSE a END AS name, path, line::INT AS line, CASE WHEN a <> '' AND b <> '' THEN a ELSE 'symbol' END AS kind FROM ab WHERE a <> '' OR b <> '')"""
_IMPORTS = f"im AS (SELECT *, {_group(G.IMPORTS, 1)} AS a, {_group(G.IMPORTS, 2)} AS b FROM src WHERE lang IS NOT NULL), imports AS (SELECT path, CASE WHEN a <> '' THEN a ELSE b END AS module, min(line)::INT AS line FROM im WHERE a <> '' OR b <> '' GROUP BY ALL)"


@query(f"WITH {FILES_SQL}, {_SRC}, {_SYMBOLS} SELECT * FROM symbols")
def d9_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symbols(files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_SRC}, {_IMPORTS} SELECT * FROM imports")
def d10_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.imports(files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_SRC}, {_IMPORTS} SELECT module, path, count(*) OVER (PARTITION BY module)::BIGINT AS n FROM imports")
def d11_imported_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per importer: a module may have any number of them."""
    return G.dependents(G.imports(files(spark, sf_dir)))


PATH_TOKENS_SQL = r"list_distinct([t FOR t IN list_concat({parts}, flatten([regexp_extract_all(p, '[a-z]+|[0-9]+') FOR p IN {parts}])) IF length(t) >= 2])".replace("{parts}", r"flatten([regexp_split_to_array(regexp_replace(s, '^(\.*[^.].*)\.[^.]*$', '\1'), '[_\-.]+') FOR s IN string_split(lower(path), '/')])")


@query(f"WITH {FILES_SQL}, t AS (SELECT path, unnest({PATH_TOKENS_SQL}) AS token FROM files) SELECT token, count(*)::BIGINT AS df FROM t GROUP BY token")
def d12_path_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.path_frequencies(files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT path, count(*)::BIGINT AS touches FROM touched WHERE NOT starts_with(path, 'tests/') GROUP BY path ORDER BY count(*) DESC, min(seq), path LIMIT 20")
def d13_hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 hottest: the limit is the feature."""
    return G.hot_files(touched(spark, sf_dir), excluded=["tests"])


@query(f"WITH {FILES_SQL}, t AS (SELECT count(*) FILTER (mtime > TIMESTAMP '2024-01-25 00:00:00')::BIGINT AS newer, date_diff('day', TIMESTAMP '2024-01-25 00:00:00', max(mtime))::INT AS age_days FROM files) SELECT *, age_days > 7 OR newer > 20 AS stale FROM t")
def d14_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.freshness(files(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


# -- E7 to E10: lookups in the graph

_WANTED = ["Store1", "parse_", "LIMIT"]


@query(f"""WITH {FILES_SQL}, {_SRC}, {_SYMBOLS}, q(wanted) AS (VALUES {', '.join(f'({_quoted(w)})' for w in _WANTED)}),
h AS (SELECT wanted, name, path, line, CASE WHEN name = wanted THEN 0 ELSE 1 END AS tier FROM symbols JOIN q ON name = wanted OR contains(lower(name), lower(wanted))),
r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY tier, name, path, line) AS place, min(tier) OVER (PARTITION BY wanted) AS best FROM h)
SELECT wanted, name, path, line, place::INT AS place FROM r WHERE tier = best AND place <= CASE best WHEN 0 THEN 10 ELSE 5 END""")
def e7_find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches (10), else those that contain the name in any case (5)."""
    from pyspark.sql import Window

    q = spark.createDataFrame([(w,) for w in _WANTED], "wanted string")
    s = G.symbols(files(spark, sf_dir))
    exact = F.col("name") == F.col("wanted")
    h = s.join(F.broadcast(q), exact | F.lower("name").contains(F.lower("wanted"))).withColumn("tier", F.when(exact, 0).otherwise(1))
    w = Window.partitionBy("wanted")
    h = h.withColumns({"place": F.row_number().over(w.orderBy("tier", "name", "path", "line")), "best": F.min("tier").over(w)})
    return h.where((F.col("tier") == F.col("best")) & (F.col("place") <= F.when(F.col("best") == 0, 10).otherwise(5))).select("wanted", "name", "path", "line", "place")


@query(f"""WITH {FILES_SQL}, {_SRC}, {_IMPORTS}, own AS (SELECT path, string_agg(module, '|' ORDER BY line, module) AS modules FROM (SELECT * FROM imports QUALIFY row_number() OVER (PARTITION BY path ORDER BY line, module) <= 15) GROUP BY path),
tails AS (SELECT DISTINCT regexp_replace(module, '^.*[./\\\\:]', '') AS tail, path AS importer FROM imports), by_tail AS (SELECT tail, string_agg(importer, '|' ORDER BY importer) AS importers FROM (SELECT * FROM tails QUALIFY row_number() OVER (PARTITION BY tail ORDER BY importer) <= 15) GROUP BY tail),
f AS (SELECT path, regexp_replace({_BASE}, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS tail, regexp_extract(path, '^(.*/)', 1) AS folder FROM files), beside AS (SELECT folder, list(path ORDER BY path) AS b FROM f GROUP BY folder)
SELECT path, coalesce(modules, '') AS modules, coalesce(importers, '') AS importers, array_to_string([x FOR x IN b IF x <> path], '|') AS neighbours FROM f JOIN beside USING (folder) LEFT JOIN own USING (path) LEFT JOIN by_tail USING (tail)""")
def e8_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file up to 15 modules, up to 15 importers by its name, and all files beside it."""
    f = files(spark, sf_dir)
    return G.relation_texts(f, G.imports(f))


@query(f"""WITH {FILES_SQL}, {_MODULES}, g AS (SELECT *, string_split(path, '/')[1] AS folder FROM mods WHERE category NOT IN ('test', 'package')),
s AS (SELECT folder, count(*) AS n, string_agg(path, ', ' ORDER BY path) FILTER (category IN ('lib', 'bin')) AS entries, string_agg(path, ', ' ORDER BY path) AS paths FROM g GROUP BY folder)
SELECT folder, n::BIGINT AS n, CASE WHEN entries IS NOT NULL THEN n || ' files, entry: ' || entries WHEN n <= 3 THEN paths ELSE n || ' files' END AS line FROM s""")
def d8_module_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by top folder, the form for large projects."""
    return G.module_groups(G.modules(files(spark, sf_dir)))


_ROUTES = rf"""routes AS (SELECT path FROM files WHERE regexp_matches(path, '^app/.*/page\.(?:tsx|ts|jsx|js)$') OR regexp_matches(path, '^pages/.*\.(?:tsx|ts|jsx|js)$') OR regexp_matches(path, '^src/routes/.*\.(?:tsx|ts|js)$'))"""


@query(rf"""WITH {FILES_SQL}, {_ROUTES} SELECT 1::INT AS place, 'Framework: react' AS note
UNION ALL SELECT 2::INT, 'Route entries: ' || count(*) FROM routes UNION ALL SELECT 3::INT, 'Component entries: ' || count(*) FROM files WHERE ends_with(path, '.tsx') AND regexp_matches({_BASE}, '^\p{{Lu}}')""")
def d7_architecture_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framework, routes and components of a project with a manifest."""
    extra = spark.range(1).select(F.lit("package.json").alias("path"), F.lit('{"dependencies": {"react": "18"}}').alias("content"))
    return G.architecture_notes(files(spark, sf_dir).select("path", "content").unionByName(extra))


# -- lookups in a stored index

#: The files asked for, of which one does not exist.
_ASKED = ["app/admin/mod.js", "app/admin/session_store.py", "no/such.py"]


def _stored(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the derived files, built anew and opened for lookups."""
    return index.build(files(spark, sf_dir).select("path", "content"), shared_folder(spark, "index"), buckets=8)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(SQL["e7_find_symbol"])
def e7_find_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookups from the stored index: buckets of names, and of grams for parts of names."""
    stored = _stored(spark, sf_dir)
    return _all([stored.find(w).drop("kind") for w in _WANTED])


@query(f"""WITH {FILES_SQL}, {_SRC}, {_IMPORTS}, q(path) AS (VALUES {', '.join(f'({_quoted(p)})' for p in _ASKED)}),
t AS (SELECT path, regexp_replace({_BASE}, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS tail, regexp_extract(path, '^(.*/)', 1) AS folder FROM q),
r AS (SELECT path, 'import' AS relation, module AS value, row_number() OVER (PARTITION BY path ORDER BY line, module) AS place FROM imports WHERE path IN (SELECT path FROM q)
UNION ALL SELECT t.path, 'importer', i.path, row_number() OVER (PARTITION BY t.path ORDER BY i.path) FROM t JOIN (SELECT DISTINCT regexp_replace(module, '^.*[./\\\\:]', '') AS tail, path FROM imports) i ON i.tail = t.tail
UNION ALL SELECT t.path, 'neighbour', f.path, row_number() OVER (PARTITION BY t.path ORDER BY f.path) FROM t JOIN files f ON regexp_extract(f.path, '^(.*/)', 1) = t.folder AND f.path <> t.path)
SELECT path, relation, place::INT AS place, value FROM r WHERE place <= 15""")
def e8_deps_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files import, who imports them and what lies beside them, up to 15 each, from the stored index."""
    stored = _stored(spark, sf_dir)
    return _all([stored.deps(p) for p in _ASKED])


@query(f"WITH {FILES_SQL}, t AS (SELECT path, unnest({PATH_TOKENS_SQL}) AS token FROM files) SELECT path, count(DISTINCT token)::BIGINT AS hits FROM t WHERE token IN ('session', 'store', 'admin', 'rs') GROUP BY path ORDER BY hits DESC, path LIMIT 15")
def e9_relevant_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 files whose paths hold most of four words, from the stored index: the limit is the feature."""
    return _stored(spark, sf_dir).relevant(["session", "store", "admin", "rs"], 15)


@query(f"WITH {FILES_SQL}, {_SRC}, {_SYMBOLS}, {_IMPORTS} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(len({sql_lines('content')})) FROM files)::BIGINT AS lines, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM imports) AS imports")
def s8_inspect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph, from the stored index."""
    return _stored(spark, sf_dir).inspect()
