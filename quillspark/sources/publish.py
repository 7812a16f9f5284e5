"""Versions of a stored result and a pointer that names the current one, moved last.

A reader sees the version before or the one after, and a write that fails
leaves the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def fs_of(spark: SparkSession, path: str):
    """The Hadoop filesystem of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it is not there."""
    fs, p = fs_of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a folder or file in the place of another."""
    fs, old = fs_of(spark, target)
    new = fs_of(spark, source)[1]
    fs.mkdirs(old.getParent())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"cannot move {source} to {target}")


def new_version(name: str = "build") -> str:
    return f"{name}-{uuid.uuid4().hex}"


def current(spark: SparkSession, root: str) -> list[str] | None:
    """What the pointer at root says: the version's folder, then what was noted with it; None if there is none."""
    if not exists(spark, f"{root}/{POINTER}"):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0].split(" ")


def publish(spark: SparkSession, root: str, version: str, *notes: str) -> None:
    """Makes a version current, and removes the one before once the pointer has moved."""
    old = current(spark, root)
    coming = f"{root}/_{POINTER}-{uuid.uuid4().hex}"
    fs, p = fs_of(spark, coming)
    out = fs.create(p, True)
    out.write(bytearray(" ".join((version, *notes)).encode()))
    out.close()
    move(spark, coming, f"{root}/{POINTER}")
    if old and old[0] != version:
        remove(spark, f"{root}/{old[0]}")
