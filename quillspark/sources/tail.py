"""Files that grow, as a stream: a Python data source with a byte offset a file.

    spark.dataSource.register(AppendedLines)
    spark.readStream.format("appended_lines").option("path", folder).option("ending", ".jsonl").load()

An offset is the bytes read of every file, kept in the query's checkpoint, so a
line comes once over restarts.  Only whole lines are read: what follows a file's
last line feed waits for it.  A file that has shrunk was written anew and is
read from its start.  Long ranges are cut into parts at line feeds, found by the
tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads; bytes looked at a time for a line feed.
_PART_BYTES, _LOOK = 32 << 20, 1 << 16
SCHEMA = "file string, at long, value string"


class Part(InputPartition):
    """Lines that begin in [start, stop) of a file; stop is the end of a line or inside one."""

    def __init__(self, path: str, name: str, start: int, stop: int, first: bool):
        self.path, self.name, self.start, self.stop, self.first = path, name, start, stop, first


def whole_lines(path: str, start: int, size: int) -> int:
    """The end of the last whole line in [start, size); start if there is none."""
    with open(path, "rb") as f:
        end = size
        while end > start:
            begin = max(start, end - _LOOK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def parts(path: str, name: str, start: int, end: int, most: int) -> list[Part]:
    cuts = [*range(start, end, most), end]
    return [Part(path, name, a, b, a == start) for a, b in zip(cuts, cuts[1:], strict=False)]


def lines(part: Part) -> Iterator[tuple[str, int, str]]:
    """(file, byte at which it begins, line) without line ends; bytes that are no UTF-8 become replacement characters."""
    with open(part.path, "rb") as f:
        f.seek(part.start if part.first else part.start - 1)
        at = part.start
        if not part.first:
            # the line that covers the byte before belongs to the part before
            at = part.start - 1 + len(f.readline())
        while at < part.stop:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            yield part.name, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(raw)


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, ending: str, part_bytes: int):
        self.folder, self.ending, self.part_bytes = folder.removeprefix("file://"), ending, part_bytes
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _sizes(self) -> dict[str, int]:
        out = {}
        for at, _, names in os.walk(self.folder):
            for n in names:
                if n.endswith(self.ending):
                    path = os.path.join(at, n)
                    out[os.path.relpath(path, self.folder)] = os.stat(path).st_size
        return out

    def latestOffset(self) -> dict:
        for name, size in sorted(self._sizes().items()):
            start = self.seen.get(name, 0)
            self.seen[name] = whole_lines(os.path.join(self.folder, name), start if start <= size else 0, size)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {**end, **self.seen}
        out: list[InputPartition] = []
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            begin = begin if begin <= stop else 0
            if stop > begin:
                out += parts(os.path.join(self.folder, name), name, begin, stop, self.part_bytes)
        return out

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Options: path, a folder that the tasks share; ending of the files' names (.jsonl); part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("ending", ".jsonl"), int(self.options.get("part_bytes", _PART_BYTES)))
