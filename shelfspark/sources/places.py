"""Places of files: file systems for tasks by URI, and the few folder operations that the driver needs."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that Spark knows, and the path in it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        return pafs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of versions, polls or days; none if it is not there."""
    folder, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a job wrote this folder to its end."""
    folder, fs = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(folder)


def rename(spark: SparkSession, path: str, to: str) -> None:
    folder, fs = _folder(spark, path)
    target, _ = _folder(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(folder, target):
        raise OSError(f"{path} could not be renamed to {to}")


def make(spark: SparkSession, path: str) -> None:
    """A folder, if it is not there yet."""
    folder, fs = _folder(spark, path)
    fs.mkdirs(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a snapshot (folders ``version=N``), oldest first."""
    names = [n for n in entries(spark, path) if n.startswith("version=")]
    return sorted(int(n[8:]) for n in names if is_whole(spark, f"{path}/{n}"))
