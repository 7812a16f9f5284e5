"""The code graph as a stored index: lookups read a few buckets, never contents.

A build writes one folder per table, each partitioned by a bucket of the lookup
key and sorted by the key within; a lookup's literal names its bucket, which is
the only folder that the scan lists, and the sort lets Parquet skip what else
lies there.  Rows are dealt by range of (bucket, key, the rest), so that a key
with many rows, as a folder with most files or a gram that most names hold, is
written by many tasks into many files.

A build goes to a folder of its own, and a pointer is moved to it last: readers
see the old build or the new one, and a build that fails leaves the old.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import publish
from . import codegraph as G

BUCKET = "_bucket"
#: Lengths of the grams by which substrings of names are found.
GRAMS = (1, 2, 3)
#: What a lookup shows: exact names, names that contain the wanted one, relations of a file.
EXACT, SIMILAR, SHOWN = 10, 5, 15


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def grams(name: Column, size: int) -> Column:
    """Distinct runs of `size` characters of the lower-case name."""
    low = F.lower(name)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(low, i, F.lit(size))), lambda g: F.length(g) == size))


def tables(files: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """Name, lookup key and rows of each table, from files(path, content)."""
    symbols, imports = G.symbols(files), G.imports(files)
    names = symbols.select("name").distinct()
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    return {
        "symbols": ("name", symbols.select("name", "path", "line", "kind")),
        "grams": ("gram", names.select(F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("name"), k) for k in GRAMS])))).alias("gram"), "name")),
        "imports": ("path", imports.select("path", "module", "line")),
        "importers": ("tail", imports.select(F.regexp_replace("module", r"^.*[./\\:]", "").alias("tail"), F.col("path").alias("importer")).distinct()),
        "importers_of_module": ("module", imports.select("module", "path")),
        "files": ("folder", files.select(folder.alias("folder"), "path", F.size(T.lines(F.col("content"))).alias("lines"))),
        "tokens": ("token", files.select(F.explode(G.path_tokens(F.col("path"))).alias("token"), "path")),
    }


def build(files: DataFrame, root: str, buckets: int = 32) -> Index:
    """Writes the index of files(path, content) below root and makes it the current one.

    The previous build is removed once the pointer has moved.  An empty table
    gives an index that finds nothing.
    """
    spark = files.sparkSession
    version = publish.new_version()
    for name, (key, rows) in tables(files).items():
        placed = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
        order = [BUCKET, key, *[c for c in rows.columns if c != key]]
        dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.partitionBy(BUCKET).parquet(f"{root}/{version}/{name}")
    publish.publish(spark, root, version, str(buckets))
    return Index(spark, root)


@dataclass
class Index:
    """Lookups in the current build at root."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        found = publish.current(self.spark, self.root)
        if not found:
            raise FileNotFoundError(f"no index at {self.root}")
        self.version, self.buckets = found[0], int(found[1])

    _SCHEMAS = {
        "symbols": "name string, path string, line int, kind string",
        "grams": "gram string, name string",
        "imports": "path string, module string, line int",
        "importers": "tail string, importer string",
        "importers_of_module": "module string, path string",
        "files": "folder string, path string, lines int",
        "tokens": "token string, path string",
    }

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self._SCHEMAS[name]}, {BUCKET} int").parquet(f"{self.root}/{self.version}/{name}")

    def at(self, name: str, keys: list[str]) -> DataFrame:
        """Rows of a table under these keys: only their buckets are listed."""
        key = self._SCHEMAS[name].split(" ")[0]
        # hashes of literals are folded, so the plan names the buckets
        wanted = [(F.col(BUCKET) == bucket_of(F.lit(k), self.buckets)) & (F.col(key) == k) for k in sorted(set(keys))]
        out = F.lit(False)
        for one in wanted:
            out = out | one
        return self.table(name).where(out).drop(BUCKET)

    def find(self, wanted: str) -> DataFrame:
        """(wanted, name, path, line, kind, place): up to EXACT symbols of that name; if there is none, up to SIMILAR whose name contains it in any case.

        Names that contain it hold all its grams; those are intersected in the
        gram table, and the driver sees at most SIMILAR names.
        """
        found = self.at("symbols", [wanted]).orderBy("name", "path", "line").limit(EXACT)
        if not found.take(1) and wanted:
            low = wanted.lower()
            size = min(len(low), max(GRAMS))
            asked = sorted({low[i : i + size] for i in range(len(low) - size + 1)})
            names = self.at("grams", asked).groupBy("name").agg(F.count_distinct("gram").alias("n")).where((F.col("n") == len(asked)) & F.contains(F.lower("name"), F.lit(low)))
            near = [r[0] for r in names.orderBy("name").limit(SIMILAR).select("name").collect()]
            found = self.at("symbols", near).orderBy("name", "path", "line").limit(SIMILAR) if near else found
        place = F.row_number().over(_by("name", "path", "line"))
        return found.select(F.lit(wanted).alias("wanted"), "name", "path", "line", "kind", place.alias("place"))

    def deps(self, path: str) -> DataFrame:
        """(path, relation, place, value): what the file imports, by line; files that import a module named like it; files beside it, each up to SHOWN, by path."""
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        tail = name[:dot] if name[:dot].strip(".") else name
        folder = path[: len(path) - len(name)]
        parts = [
            ("import", self.at("imports", [path]).select(F.col("module").alias("value"), F.col("line").alias("a"))),
            ("importer", self.at("importers", [tail]).select(F.col("importer").alias("value"), F.lit(0).alias("a"))),
            ("neighbour", self.at("files", [folder]).where(F.col("path") != path).select(F.col("path").alias("value"), F.lit(0).alias("a"))),
        ]
        out = None
        for relation, rows in parts:
            top = rows.orderBy("a", "value").limit(SHOWN)
            top = top.select(F.lit(path).alias("path"), F.lit(relation).alias("relation"), F.row_number().over(_by("a", "value")).alias("place"), "value")
            out = top if out is None else out.unionByName(top)
        return out

    def importers(self, module: str, after: str | None = None, page: int = 100) -> DataFrame:
        """(module, path): the next `page` files that import the module, by path; `after` is the last path of the page before."""
        rows = self.at("importers_of_module", [module])
        rows = rows if after is None else rows.where(F.col("path") > after)
        return rows.orderBy("path").limit(page)

    def relevant(self, tokens: list[str], k: int = 15) -> DataFrame:
        """(path, hits): the k files whose paths hold most of the tokens, ties by path."""
        hits = self.at("tokens", tokens).groupBy("path").agg(F.count_distinct("token").alias("hits"))
        return hits.orderBy(F.desc("hits"), "path").limit(k)

    def inspect(self) -> DataFrame:
        """(files, lines, symbols, imports): sizes of the graph, from Parquet footers and the file table."""
        counted = self.table("files").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
        return counted.join(self.table("symbols").agg(F.count("*").alias("symbols"))).join(self.table("imports").agg(F.count("*").alias("imports")))


def _by(*columns: str) -> WindowSpec:
    """Order of the few rows that a lookup shows."""
    return Window.orderBy(*columns)
