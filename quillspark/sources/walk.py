"""Source trees walked by the tasks: folders level by level, contents of the survivors only.

The frontier is a table of folders.  Tasks list it, drop what is excluded and
write what is left; the folders among that are the next frontier.  The driver
sees numbers of rows.  An excluded folder is never entered and a file that is
left out never opened.  Files are read in a second step, a partition per
`part_bytes` of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder

#: Folders, and beginnings of folder names, that the walk of a code graph leaves out.
GRAPH_EXCLUDED = [
    "node_modules", "target", "dist", "build", ".next", ".git", ".venv", "venv", "__pycache__", ".pytest_cache", "coverage", ".turbo", ".cache", ".mypy_cache", ".ruff_cache", ".tox", "bower_components", "vendor", ".idea", ".vscode", ".context-os",
]
GRAPH_PREFIXES = ["autocontext_fixture"]

_ENTRY = "path string, folder boolean, size long, mtime double"
#: Folders that one task lists; bytes that one task reads, and gives on at once.
_PER_TASK, _PART_BYTES, _BATCH_BYTES = 64, 64 << 20, 4 << 20


def local_path(root: str) -> str | None:
    """The path of a root without a scheme or with file:, else None."""
    at = urlparse(root)
    return os.path.abspath(at.path) if at.scheme in ("", "file") else None


def reachable(root: str) -> bool:
    """Whether tasks can list root: a local or shared folder, or a store that Arrow's filesystems know."""
    if local_path(root):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _listed(root: str, folder: str) -> Iterator[tuple[str, str, bool, int, float]]:
    """(name, relative path, folder, size, mtime) of a folder's entries; links to folders are not followed, and pipes and the like are no files, and a folder that is gone or closed has no entries."""
    base = local_path(root)
    try:
        if base:
            for e in os.scandir(os.path.join(base, folder)):
                if e.is_file() or e.is_dir() and not e.is_symlink():
                    s = e.stat()
                    yield e.name, f"{folder}{e.name}", e.is_dir(), s.st_size, s.st_mtime
            return
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        for info in store.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/{folder}".rstrip("/"), allow_not_found=True)):
            yield info.base_name, f"{folder}{info.base_name}", info.type == fs.FileType.Directory, info.size or 0, info.mtime.timestamp() if info.mtime else 0.0
    except (FileNotFoundError, PermissionError, NotADirectoryError):
        return


def _content(root: str, path: str) -> bytes | None:
    base = local_path(root)
    try:
        if base:
            with open(os.path.join(base, path), "rb") as f:
                return f.read()
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{at.rstrip('/')}/{path}") as f:
            return f.read()
    except (FileNotFoundError, PermissionError):
        return None


def walk(spark: SparkSession, root: str, excluded: Sequence[str] = (), prefixes: Sequence[str] = (), extensions: Sequence[str] | None = None, dot_files: bool = True) -> DataFrame:
    """(path, size, mtime) of the regular files below root, relative paths.

    Folders named in excluded, beginning with one of prefixes or with a dot are
    not entered.  Files are kept by extension, if given, and such as begin with
    a dot only with dot_files.  A missing root has no files; names that are no
    UTF-8 are left out.
    """
    excluded, prefixes = frozenset(excluded), tuple(prefixes)
    endings = tuple(f".{e.lstrip('.')}" for e in extensions) if extensions is not None else None

    def stays(name: str, folder: bool) -> bool:
        if not name.isprintable() and name.encode("utf-8", "replace") != name.encode("utf-8", "surrogateescape"):
            return False
        if folder:
            return name not in excluded and not name.startswith((".", *prefixes))
        return (dot_files or not name.startswith(".")) and (endings is None or os.path.splitext(name)[1] in endings)

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [e[1:] for e in _listed(root, f"{folder}/" if folder else "") if stays(e[0], e[2])]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.float64()), strict=True)], names=["path", "folder", "size", "mtime"])

    base, level = shared_folder(spark, "walk"), 0
    frontier, n = spark.createDataFrame([("",)], "path string"), 1
    while n:
        found = frontier.repartition(max(1, -(-n // _PER_TASK))).mapInArrow(list_folders, _ENTRY)
        found.write.parquet(f"{base}/level={level}")
        frontier = spark.read.schema(_ENTRY).parquet(f"{base}/level={level}").where("folder").select("path")
        n, level = frontier.count(), level + 1
    return spark.read.schema(f"{_ENTRY}, level int").parquet(base).where("not folder").select("path", "size", F.timestamp_micros((F.col("mtime") * 1e6).cast("long")).alias("mtime"))


def contents(files: DataFrame, root: str, part_bytes: int = _PART_BYTES) -> DataFrame:
    """(path, bytes, mtime) of walked files; one that is gone by now is left out.  A task holds one file or a few MB of small ones."""
    total = files.agg(F.sum("size")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.timestamp("us", "UTC")))], names=["path", "bytes", "mtime"])

        for batch in batches:
            rows, size = [], 0
            for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
                data = _content(root, path)
                if data is not None:
                    rows.append((path, data, mtime))
                    size += len(data)
                if size >= _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    dealt = files.select("path", "mtime").repartition(max(1, -(-total // part_bytes)))
    return dealt.mapInArrow(read, "path string, bytes binary, mtime timestamp")


def code_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path, content, mtime) of the files of a code graph, in the languages of the extensions; bytes that are no UTF-8 become replacement characters."""
    found = contents(walk(spark, root, GRAPH_EXCLUDED, GRAPH_PREFIXES, extensions, dot_files=False), root)
    return found.select("path", F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"), "mtime")
