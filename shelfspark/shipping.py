"""Makes this package importable in Python workers, however the driver found it."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as a zip, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "shelfspark.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def release() -> None:
    """Gives memory that a task has freed back to the machine: Spark keeps a worker for the next task, and the allocators keep what it used."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers. Batches have the session's size in rows and bytes (Spark's own limit is 64 MB)."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)
