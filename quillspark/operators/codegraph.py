"""Inventory and code graph of source trees: files(path, content) to normalized tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_LINES = 20000
#: Language by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript-react", "js": "javascript", "jsx": "javascript-react", "py": "python", "rs": "rust", "go": "go",
    "java": "java", "kt": "kotlin", "swift": "swift", "rb": "ruby", "ex": "elixir", "exs": "elixir",
}
#: Symbol and import patterns by language of the graph; groups are (kind, name) or (name).
SYMBOLS = {
    "rust": r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|type|mod|const|static)\s+([A-Za-z_][A-Za-z0-9_]*)",
    "python": r"^(?:async\s+)?(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    "javascript": r"^export\s+(?:default\s+)?(?:async\s+)?(function|class|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "typescript": r"^export\s+(?:default\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
    "go": r"^func\s+(?:\([^)]*\)\s+)?([A-Z][\w]*)\s*\(|^type\s+([A-Z][\w]*)",
}
IMPORTS = {
    "rust": r"^\s*use\s+([A-Za-z_][\w:]*)",
    "python": r"^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+([A-Za-z_][\w.]*))",
    "javascript": r"^\s*(?:import\b[^\"']*from\s+[\"']([^\"']+)[\"']|const\s+[\w{},\s*]+\s*=\s*require\(\s*[\"']([^\"']+)[\"']\s*\))",
    "typescript": r"^\s*import\b[^\"']*from\s+[\"']([^\"']+)[\"']",
    "go": r"^\s*\"([^\"]+)\"",
}
GRAPH_LANGUAGE = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go"}
#: Lock files that are never hot.
LOCK_FILES = ["package-lock.json", "yarn.lock", "cargo.lock", "poetry.lock", "pnpm-lock.yaml", "composer.lock"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def folder_of(path: Column) -> Column:
    """With its slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def stem(name: Column) -> Column:
    """File name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def category(path: Column) -> Column:
    """First rule that holds; tests first."""
    c, s, e = path.contains, path.startswith, path.endswith
    return (
        F.when(c("/test") | c(".spec.") | c(".test.") | c("_test.go") | c("_test.rs") | e("_test.py") | s("test_"), "test")
        .when(e("/lib.rs"), "lib")
        .when(e("/main.rs"), "bin")
        .when(e("/mod.rs"), "module")
        .when(c("/components/"), "component")
        .when(c("/routes/") | s("app/") | s("pages/"), "route")
        .when(s("cmd/") | c("/cmd/"), "bin")
        .when(c("/internal/") | s("internal/"), "internal")
        .when(c("/pkg/") | s("pkg/"), "lib")
        .when(e("__init__.py"), "package")
        .when(e("__main__.py"), "bin")
        .otherwise("module")
    )


def is_config(path: Column) -> Column:
    return path.isin("next.config.js", "next.config.mjs") | path.rlike(r"\.(?:toml|yaml|yml|ini|json)$")


def config_format(path: Column) -> Column:
    e = path.endswith
    return F.when(e(".toml"), "toml").when(e(".yaml") | e(".yml"), "yaml").when(e(".ini"), "ini").when(e(".json"), "json").when(e(".js") | e(".mjs"), "javascript").otherwise("unknown")


def modules(files: DataFrame) -> DataFrame:
    """Source files with language and category."""
    language = _mapped(LANGUAGES, extension(F.col("path")))
    return files.select("path", language.alias("language"), category(F.col("path")).alias("category"), F.octet_length("content").cast("long").alias("size_bytes")).where(F.col("language").isNotNull() & ~is_config(F.col("path")))


def configs(files: DataFrame) -> DataFrame:
    return files.where(is_config(F.col("path"))).select("path", config_format(F.col("path")).alias("format"))


def components(files: DataFrame) -> DataFrame:
    name = stem(basename(F.col("path")))
    return files.where(F.col("path").rlike(r"\.[tj]sx$") & name.rlike(r"^\p{Lu}")).select("path", name.alias("component"))


def routes(files: DataFrame) -> DataFrame:
    """(route, path, kind) by three conventions of folders; the first that fits."""
    p = F.col("path")
    app = F.when(p.rlike(r"^app/(?:.*/)?page\.(?:tsx|ts|jsx|js)$") & p.rlike(r"/page\."), F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(p, r"^(?:app/)+", ""), r"/?page\.(?:tsx|ts|jsx|js)$", "")))
    bare = F.regexp_replace(p, r"(?:\.(?:tsx|ts|jsx|js))+$", "")
    inner = F.regexp_replace(bare, r"^(?:pages/)+", "")
    api = F.concat(F.lit("/api/"), F.regexp_replace(bare, r"^(?:pages/api/)+", ""))
    pages = F.when(p.rlike(r"^pages/.*\.(?:tsx|ts|jsx|js)$"), F.when(p.contains("/api/"), api).when(inner == "index", "/").otherwise(F.concat(F.lit("/"), inner)))
    src = F.when(p.rlike(r"^src/routes/.*\.(?:ts|tsx|js)$"), F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?:\.(?:tsx|ts|js))+$", ""), r"^(?:src/routes/)+", ""), r"(?:/index)+$", "")))
    kind = F.when(app.isNotNull(), "next_app").when(pages.isNotNull(), "next_pages").when(src.isNotNull(), "src_routes")
    return files.select(F.coalesce(app, pages, src).alias("route"), "path", kind.alias("kind")).where("route is not null")


def framework(files: DataFrame) -> DataFrame:
    """One row: the framework by manifests at the root and by the dominant language."""
    p = F.col("path")
    n = {k: F.count_if(p.rlike(rf"\.(?:{v})$")).alias(k) for k, v in {"rs": "rs", "go": "go", "py": "py", "ts": "tsx?", "js": "jsx?", "java": "java"}.items()}
    at = {k: F.max(F.when(p == f, F.col("content"))).alias(k) for k, f in {"cargo": "Cargo.toml", "gomod": "go.mod", "package": "package.json", "pom": "pom.xml", "gradle": "build.gradle", "pyproject": "pyproject.toml", "setup": "setup.py", "cfg": "setup.cfg"}.items()}
    t = files.agg(*n.values(), *at.values())
    c = F.col
    has, web = lambda k: c(k).isNotNull(), c("ts") + c("js")
    dep = lambda d: F.get_json_object("package", f"$.dependencies.{d}").isNotNull()
    top = F.greatest("rs", "go", "py", web, "java")
    found = (
        F.when(has("cargo") & (c("rs") > 0) & c("cargo").contains("[workspace]"), "rust-workspace")
        .when(has("cargo") & (c("rs") > 0) & (c("rs") >= F.greatest("go", "py", "ts")), "rust")
        .when(has("gomod") & (c("go") > 0), "go")
        .when(has("package") & dep("next"), "nextjs")
        .when(has("package") & dep("react"), "react")
        .when(has("package") & (web > 0), "node")
        .when(has("pom") | has("gradle"), "java")
        .when((has("pyproject") | has("setup") | has("cfg")) & (c("py") >= F.greatest("rs", "go", "ts")), "python")
        .when(top == 0, None)
        .when(c("rs") == top, "rust")
        .when(c("go") == top, "go")
        .when(web == top, "node")
        .when(c("py") == top, "python")
        .when(c("java") == top, "java")
    )
    return t.select(found.alias("framework"), "rs", "go", "py", "ts", "js", "java")


def source_lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, s): the first MAX_LINES lines of files in a language of the graph."""
    lang = _mapped(GRAPH_LANGUAGE, extension(F.col("path")))
    rows = files.select("path", lang.alias("lang"), T.lines(F.col("content")).alias("l")).where("lang is not null")
    return rows.select("path", "lang", F.posexplode(F.slice("l", 1, MAX_LINES)).alias("n", "s")).select("path", "lang", (F.col("n") + 1).alias("line"), "s")


def _by_language(patterns: dict[str, str], group: int) -> Column:
    out = F
    for lang, p in patterns.items():
        if group > 1 and "(" not in p:
            continue
        out = out.when(F.col("lang") == lang, F.regexp_extract("s", p, group))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(name, path, line, kind); a pattern with one group names a plain symbol."""
    one, two = _by_language(SYMBOLS, 1), _by_language(SYMBOLS, 2)
    rows = source_lines(files).withColumns({"a": F.coalesce(one, F.lit("")), "b": F.coalesce(two, F.lit(""))}).where("a <> '' or b <> ''")
    both = (F.col("a") != "") & (F.col("b") != "")
    name = F.when(both, F.col("b")).when(F.col("a") != "", F.col("a")).otherwise(F.col("b"))
    return rows.select(name.alias("name"), "path", "line", F.when(both, F.col("a")).otherwise("symbol").alias("kind"))


def imports(files: DataFrame) -> DataFrame:
    """(path, module, line): each file's distinct modules with the first line that names them."""
    two_groups = {k: v for k, v in IMPORTS.items() if k in ("python", "javascript")}
    one, two = _by_language(IMPORTS, 1), _by_language(two_groups, 2)
    module = F.when(F.coalesce(one, F.lit("")) != "", one).otherwise(F.coalesce(two, F.lit("")))
    return source_lines(files).withColumn("module", module).where("module <> ''").groupBy("path", "module").agg(F.min("line").alias("line"))


def path_tokens(path: Column) -> Column:
    """Distinct tokens of a path: parts of its segments, and their runs of letters and of digits."""
    parts = F.flatten(F.transform(F.split(F.lower(path), r"[/\\]+"), lambda s: F.split(stem(s), r"[_\-.]+")))
    runs = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit("[a-z]+|[0-9]+"), F.lit(0))))
    return F.array_distinct(F.filter(F.concat(parts, runs), lambda t: F.length(t) >= 2))


def path_frequencies(files: DataFrame) -> DataFrame:
    """(token, df): in how many paths a token is."""
    return files.select("path", F.explode(path_tokens(F.col("path"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def hot_files(commits: DataFrame, k: int = 20, excluded: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """(path, touches): the k most touched paths of commits(path, seq), ties by first appearance; locks and excluded folders drop out.  With ordered, also place."""
    p = F.col("path")
    keep = ~F.lower(basename(p)).isin(LOCK_FILES)
    if excluded:
        keep = keep & ~F.element_at(F.split(p, "/"), 1).isin(excluded)
    n = commits.where(keep).groupBy("path").agg(F.count("*").alias("touches"), F.min("seq").alias("first"))
    top = n.orderBy(F.desc("touches"), "first", "path").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("touches"), "first", "path")).alias("place")
    return top.select("path", "touches", *([place] if ordered else []))


def module_summary(mods: DataFrame, shown: int = 5) -> DataFrame:
    """(category, n, line): the first paths of each category other than tests and packages, and how many more."""
    g = mods.where(~F.col("category").isin("test", "package"))
    w = Window.partitionBy("category").orderBy("path")
    g = g.withColumn("place", F.row_number().over(w)).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "path")))), lambda x: x["path"]), ", ").alias("head"))
    more = F.when(F.col("n") > shown, F.format_string(", ...+%d more", F.col("n") - shown)).otherwise("")
    return g.select("category", "n", F.concat("head", more).alias("line"))


def module_groups(mods: DataFrame, listed: int = 3) -> DataFrame:
    """(folder, n, line): modules other than tests and packages by top folder, for large projects.

    The line names entry points (lib and bin), else the paths of up to `listed`, else only the number.
    """
    g = mods.where(~F.col("category").isin("test", "package")).withColumn("folder", F.element_at(F.split("path", "/"), 1))
    entry = F.col("category").isin("lib", "bin")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    g = g.withColumn("place", place).groupBy("folder").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(entry, F.col("path")))).alias("entries"), F.array_sort(F.collect_list(F.when(F.col("place") <= listed, F.col("path")))).alias("head")
    )
    line = F.when(F.size("entries") > 0, F.concat(F.col("n").cast("string"), F.lit(" files, entry: "), F.array_join("entries", ", "))).when(F.col("n") <= listed, F.array_join("head", ", ")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" files")))
    return g.select("folder", "n", line.alias("line"))


def architecture_notes(files: DataFrame) -> DataFrame:
    """(place, note): the framework if one is found, then the numbers of routes and of components."""
    notes = [
        framework(files).where("framework is not null").select(F.lit(1).alias("place"), F.concat(F.lit("Framework: "), "framework").alias("note")),
        routes(files).agg(F.count("*").alias("n")).select(F.lit(2).alias("place"), F.concat(F.lit("Route entries: "), F.col("n").cast("string")).alias("note")),
        components(files).agg(F.count("*").alias("n")).select(F.lit(3).alias("place"), F.concat(F.lit("Component entries: "), F.col("n").cast("string")).alias("note")),
    ]
    return notes[0].unionByName(notes[1]).unionByName(notes[2])


#: Over how many keys a folder's list is dealt, so that no task writes the rows of a whole folder.
SLOTS = 32


def _named(files: DataFrame, imports_of: DataFrame, shown: int) -> DataFrame:
    """(path, folder, modules, importers) of every file, the first `shown` of either."""
    top = lambda *by: F.row_number().over(Window.partitionBy("path").orderBy(*by))
    listed = lambda c: F.array_sort(F.collect_list(F.struct("place", c)))
    own = imports_of.withColumn("place", top("line", "module")).where(F.col("place") <= shown).groupBy("path").agg(listed("module").alias("m"))
    tail = imports_of.select(F.regexp_replace("module", r"^.*[./\\:]", "").alias("tail"), F.col("path").alias("importer")).distinct()
    by_tail = tail.withColumn("place", F.row_number().over(Window.partitionBy("tail").orderBy("importer"))).where(F.col("place") <= shown).groupBy("tail").agg(listed("importer").alias("i"))
    all_files = files.select("path", stem(basename(F.col("path"))).alias("tail"), folder_of(F.col("path")).alias("folder"))
    none = F.array().cast("array<string>")
    return all_files.join(own, "path", "left").join(by_tail, "tail", "left").select(
        "path",
        "folder",
        F.coalesce(F.transform("m", lambda x: x["module"]), none).alias("modules"),
        F.coalesce(F.transform("i", lambda x: x["importer"]), none).alias("importers"),
    )


def _dealt(rows: DataFrame, lists: DataFrame, whole: bool) -> DataFrame:
    """rows with their folders' lists, of which each of SLOTS keys gets one; if whole, by number, as few bytes go in and many come out."""
    lists = lists.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("path"), F.lit(SLOTS)).cast("int"))
    return (rows.repartition(2 * SLOTS, "folder", "slot") if whole else rows).join(lists, ["folder", "slot"])


def relations(files: DataFrame, imports_of: DataFrame, shown: int = 15, beside: int | None = 15) -> DataFrame:
    """(path, modules, importers, neighbours) of every file.

    modules: what it imports, the first `shown` by line; importers: the first
    `shown` files, by path, that import a module whose last part is the file's
    name without ending; neighbours: the first `beside` other files of its
    folder, by path, or with None all of them.  Of a folder, one more than is
    wanted is kept before any gathering.  All neighbours are as many as the
    squares of the folders' sizes: a task holds the lists of its folders and one
    row, and the rows of a folder go to SLOTS keys.
    """
    rows = _named(files, imports_of, shown)
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    paths = files.select("path", folder_of(F.col("path")).alias("folder"))
    first = paths if beside is None else paths.withColumn("place", place).where(F.col("place") <= beside + 1)
    lists = first.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("beside"))
    others = F.filter("beside", lambda x: x != F.col("path"))
    return _dealt(rows, lists, beside is None).select("path", "modules", "importers", (others if beside is None else F.slice(others, 1, beside)).alias("neighbours"))


def relation_texts(files: DataFrame, imports_of: DataFrame, shown: int = 15, mark: str = "|") -> DataFrame:
    """relations with all neighbours, each list as one text; a path is in files once.

    A folder's text is joined once, and a row takes the bytes before and after
    its own path, so a row costs copies of bytes, no work per neighbour.
    """
    paths = files.select("path", folder_of(F.col("path")).alias("folder"))
    step = F.octet_length("path") + len(mark.encode())
    start = F.sum(step).over(Window.partitionBy("folder").orderBy("path")) - step
    starts = paths.select("path", start.cast("int").alias("start"))
    lists = paths.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("path")), mark).cast("binary").alias("beside"))
    rows = _dealt(_named(files, imports_of, shown).join(starts, "path"), lists, True)
    before = F.substring("beside", F.lit(1), F.greatest(F.least("start", F.octet_length("beside") - step), F.lit(0)))  # the last has no mark behind it
    after = F.substring("beside", F.col("start") + step + 1, F.octet_length("beside"))
    return rows.select("path", *[F.array_join(c, mark).alias(c) for c in ("modules", "importers")], F.concat(before, after).cast("string").alias("neighbours"))


def dependents(imports_of: DataFrame) -> DataFrame:
    """(module, path, n): who imports a module, a row per importer, and how many do."""
    n = imports_of.groupBy("module").agg(F.count("*").alias("n"))
    return imports_of.select("module", "path").join(n, "module")


def freshness(files: DataFrame, built: Column, max_age_days: int = 7, max_newer: int = 20) -> DataFrame:
    """One row: files newer than the graph, its age in days to the newest file, and whether it is stale."""
    newest = F.max("mtime")
    t = files.agg(F.count_if(F.col("mtime") > built).alias("newer"), F.datediff(newest, built).alias("age_days"))
    return t.withColumn("stale", (F.col("age_days") > max_age_days) | (F.col("newer") > max_newer))
