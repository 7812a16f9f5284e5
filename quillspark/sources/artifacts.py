"""The eight artifacts of a source tree, each as JSON lines and as Markdown, published together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codegraph as G
from .publish import current, new_version, publish
from .readers import package_dependencies

#: The artifacts in their order.
ORDER = ["routes", "modules", "schema", "components", "configs", "architecture", "dependency-map", "recent-hotspots"]
_TITLES = {n: n.replace("-", " ").title() for n in ORDER}


def tables(files: DataFrame, commits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of each artifact, from files(path, content) and, for the hot files, commits(path, seq).

    No schema is read from a tree, so that artifact is always empty.
    """
    spark = files.sparkSession
    manifests = files.where(G.basename(F.col("path")) == "package.json")
    folder = F.element_at(F.split("path", "/"), 1)
    tops = files.where(F.col("path").contains("/")).select(folder.alias("folder")).distinct()
    summary = G.framework(files).select("framework").join(tops.agg(F.array_sort(F.collect_set("folder")).alias("top_level_dirs")))
    counts = G.modules(files).agg(F.count("*").alias("source_file_count")).join(G.configs(files).agg(F.count("*").alias("config_file_count")))
    return {
        "routes": G.routes(files),
        "modules": G.modules(files),
        "schema": spark.createDataFrame([], "name string"),
        "components": G.components(files),
        "configs": G.configs(files),
        "architecture": summary.join(counts),
        "dependency-map": package_dependencies(manifests),
        "recent-hotspots": G.hot_files(commits) if commits is not None else spark.createDataFrame([], "path string, touches long"),
    }


def _text(rows: DataFrame, column: str) -> Column:
    kind = rows.schema[column].dataType.simpleString()
    value = F.array_join(F.col(column), ", ") if kind.startswith("array") else F.col(column).cast("string")
    return F.coalesce(value, F.lit("none"))


def write(files: DataFrame, root: str, commits: DataFrame | None = None) -> list[tuple[str, str, str]]:
    """Writes the pairs into a new version below root and makes it current; (name, JSON folder, Markdown folder) in order.

    The files are read once, into a table of the version.  An artifact without
    rows says so in its Markdown.
    """
    spark, version = files.sparkSession, new_version("artifacts")
    base = f"{root}/{version}"
    files.select("path", "content").write.parquet(f"{base}/_files")
    seen = spark.read.schema("path string, content string").parquet(f"{base}/_files")
    manifest = []
    for name, rows in tables(seen, commits).items():
        pair = (name, f"{base}/{name}.json", f"{base}/{name}.md")
        rows.write.option("ignoreNullFields", "false").json(pair[1])
        back = spark.read.schema(rows.schema).json(pair[1])
        title = spark.createDataFrame([(0, f"# {_TITLES[name]}"), (1, "")], "part int, value string")
        none = F.when(F.count("*") == 0, F.lit("Nothing was found in this scan."))
        items = back.select(F.lit(2).alias("part"), F.concat(F.lit("- "), F.concat_ws(" | ", *[_text(rows, c) for c in rows.columns])).alias("value"))
        empty = back.agg(none.alias("value")).where("value is not null").select(F.lit(2).alias("part"), "value")
        title.unionByName(items).unionByName(empty).orderBy("part", "value").select("value").write.text(pair[2])
        manifest.append(pair)
    publish(spark, root, version)
    return manifest


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """An artifact of the current version; empty if none was published."""
    found = current(spark, root)
    return spark.read.schema(schema).json(f"{root}/{found[0]}/{name}.json") if found else spark.createDataFrame([], schema)
