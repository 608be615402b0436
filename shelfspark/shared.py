"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset: below a temporary folder of this application if the
    master is local, else an error, for executors of a cluster would write to disks of their own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-shelf-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; whatever was made from them must be stored itself."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
