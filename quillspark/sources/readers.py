"""Sources: source trees, JSON lines, state and graph files, commit logs, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import publish, walk

#: Folders that an inventory leaves out.
IGNORED = [".git", "node_modules", "target", "dist", "build", ".next", "coverage"]


def source_tree(spark: SparkSession, root: str, ignored: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """(path, content, mtime) of the text files below root, relative paths; ignored folders and dot folders drop out, and so do files that are no UTF-8.

    The tasks list the folders and open what survives.  Of a store that only
    Spark reads, names and contents come in one pass.
    """
    ignored = IGNORED if ignored is None else ignored
    if not walk.reachable(root):
        return _scanned(spark, root, ignored, extensions)
    files = walk.contents(walk.walk(spark, root, ignored, extensions=extensions), root)
    text = F.col("bytes").cast("string")
    return files.where(F.is_valid_utf8(text)).select("path", text.alias("content"), "mtime")


def _scanned(spark: SparkSession, root: str, ignored: list[str], extensions: list[str] | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + _quote(base if base.startswith("/") else "/" + base.split(":", 1)[-1].lstrip("/")), "")
    folders = F.expr("slice(split(rel, '/'), 1, size(split(rel, '/')) - 1)")
    rows = files.select(path.alias("rel"), "content", F.col("modificationTime").alias("mtime"))
    rows = rows.where(~F.exists(folders, lambda s: s.isin(ignored) | s.startswith(".")) & F.is_valid_utf8(F.col("content").cast("string")))
    if extensions:
        rows = rows.where(F.element_at(F.split("rel", r"\."), -1).isin(extensions))
    return rows.select(F.col("rel").alias("path"), F.col("content").cast("string").alias("content"), "mtime")


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(raw, json): lines as VARIANT; lines that are no JSON are skipped."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("json")).where("json is not null")


def transcript_usage(lines: DataFrame) -> DataFrame:
    """Usage of each transcript line that has one: (session, input, output, cache_read, cache_write)."""
    get = lambda p: F.coalesce(F.try_variant_get("json", f"$.message.usage.{p}", "long"), F.lit(0).cast("long"))
    usage = lines.where(F.try_variant_get("json", "$.message.usage", "variant").isNotNull())
    return usage.select(
        F.try_variant_get("json", "$.session_id", "string").alias("session"),
        get("input_tokens").alias("input"),
        get("output_tokens").alias("output"),
        get("cache_read_input_tokens").alias("cache_read"),
        get("cache_creation_input_tokens").alias("cache_write"),
    )


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document; an empty table if it is absent or not readable as such."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def states(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Saved session states, of the current version where there is one; an empty table if there are none, and missing fields with their defaults."""
    version = publish.current(spark, path)
    path = f"{path}/{version[0]}" if version else path
    rows = json_or_empty(spark, path, schema) if not defaults else None
    if rows is not None:
        return rows
    try:
        raw = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return raw.select(state_or_default(F.col("value"), schema, defaults).alias("s")).select("s.*")


def git_states(status: DataFrame) -> DataFrame:
    """(id, branch, upstream, ahead, behind, dirty) of texts (id, text) as `git status --porcelain=v2 --branch` prints them.

    A text without these headers has a null branch and counts of 0.
    """
    lines = F.split("text", "\n")
    value = lambda head: F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^# branch\.{head} (.+)$", 1)), lambda x: x != ""), F.lit(0))
    count = lambda sign: F.coalesce(F.regexp_extract(value("ab"), rf"\{sign}(\d+)", 1).try_cast("int"), F.lit(0))
    dirty = F.size(F.filter(lines, lambda x: x.rlike("^[12u?] ")))
    return status.select("id", value("head").alias("branch"), value("upstream").alias("upstream"), count("+").alias("ahead"), count("-").alias("behind"), dirty.alias("dirty"))


#: Commits that a state lists.
RECENT_COMMITS = 5


def git_details(outputs: DataFrame) -> DataFrame:
    """(id, branch, uncommitted_files, diff_stat, last_commit, recent_commits, ahead, behind) of what git printed, a column of outputs each:

    branch (`branch --show-current`), status (`status --porcelain --no-renames`),
    diff (`diff --stat HEAD`), log (`log --oneline`), counts (`rev-list
    --left-right --count base...HEAD`: behind, then ahead).  Blank or null
    output is null, and no list or 0 where one is asked for; a file's name
    follows the two letters of its state and a blank, on the first line too.
    """
    said = lambda c: F.when(T.trim(F.col(c)) != "", F.col(c))
    lines = lambda c: F.coalesce(F.filter(F.split(said(c), r"\r?\n"), lambda x: T.trim(x) != ""), F.array().cast("array<string>"))
    names = F.transform(F.filter(lines("status"), lambda x: F.length(x) > 3), lambda x: F.substring(x, 4, 1 << 30))
    commits = F.slice(F.transform(lines("log"), T.trim), 1, RECENT_COMMITS)
    count = lambda k: F.coalesce(F.regexp_extract("counts", r"^\s*(\d+)\s+(\d+)\s*$", k).try_cast("int"), F.lit(0))
    return outputs.select("id", T.trim(said("branch")).alias("branch"), names.alias("uncommitted_files"), T.trim_end(said("diff")).alias("diff_stat"), F.get(commits, F.lit(0)).alias("last_commit"), commits.alias("recent_commits"), count(2).alias("ahead"), count(1).alias("behind"))


def state_or_default(raw: Column, schema: str, defaults: dict[str, Column]) -> Column:
    """A state struct from JSON text; missing fields take their defaults."""
    s = F.from_json(raw, schema)
    names = [x.strip().split(" ")[0].split(":")[0] for x in schema.split(",")]
    return F.struct(*[F.coalesce(s[n], defaults[n]).alias(n) if n in defaults else s[n].alias(n) for n in names])


def commit_log(text: DataFrame) -> DataFrame:
    """(sha, subject, body, path) of logs framed by STX, NUL and ETX: STX sha NUL subject NUL body ETX, then a path a line."""
    frames = text.select(F.explode(F.slice(F.split("text", "\x02"), 2, 1 << 30)).alias("frame"))
    parts = F.split("frame", "\x03", 2)
    head = F.split(parts[0], "\x00")
    return frames.select(head[0].alias("sha"), head[1].alias("subject"), F.get(head, F.lit(2)).alias("body"), F.explode_outer(F.filter(F.transform(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("path"))


def package_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name, version, kind) of package.json texts (path, content)."""
    kinds = ["dependencies", "devDependencies"]
    maps = F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds))
    out = None
    for k in kinds:
        part = manifests.select("path", F.explode(maps[k]).alias("name", "version"), F.lit(k).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def toml_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name, version, kind) of TOML manifests; the grammar is recursive, hence Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    doc = tomllib.loads(content)
                except (tomllib.TOMLDecodeError, TypeError):
                    continue
                tables = {"dependencies": doc.get("dependencies"), "workspace": (doc.get("workspace") or {}).get("dependencies"), "dev-dependencies": doc.get("dev-dependencies")}
                for kind, table in tables.items():
                    for name, v in (table or {}).items():
                        rows.append((path, name, v if isinstance(v, str) else str((v or {}).get("version", "")) if isinstance(v, dict) else str(v), kind))
            yield pd.DataFrame(rows, columns=["path", "name", "version", "kind"])

    return manifests.select("path", "content").mapInPandas(run, "path string, name string, version string, kind string")
