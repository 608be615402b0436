"""Folder trees as relations: listed level by level by tasks, and watched by comparing listings.

A watcher's home is a folder of its own: ``listing/version=N`` holds the files at poll N, ``events/N`` what changed
since the poll before. Events get their place by one rename of a whole folder, so a stream
over ``events`` sees all of a poll or nothing, and a poll that was cut short is finished by the next one.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import paths
from shelfspark.shared import stored
from shelfspark.shipping import map_arrow
from shelfspark.sources.places import delete, entries, is_whole, make, place, rename, versions

_ROW = "rel_path string, folder boolean, size long, mtime_us long, file_id string"
#: Folders that a task lists below one folder of the frontier before it hands the rest to the next round.
FOLDERS = 64


def _listed(uri: str) -> Iterator[tuple[str, bool, int, int, str | None]]:
    """(name, is a folder, size, mtime in microseconds, identity or None) of what a folder holds; a folder that went meanwhile holds
    nothing. Links to folders are left out, as a link may lead back up; the identity of a file stays when it is moved."""
    fs, path = place(uri)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(path) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.name, True, 0, 0, None
                        elif not e.is_dir():
                            s = e.stat()
                            yield e.name, False, s.st_size, s.st_mtime_ns // 1000, f"{s.st_dev}:{s.st_ino}"
                    except FileNotFoundError:
                        continue
        else:
            for e in fs.get_file_info(pafs.FileSelector(path)):
                at = e.mtime_ns
                yield e.base_name, e.type == pafs.FileType.Directory, e.size or 0, (at or 0) // 1000, None
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size, mtime_us, file_id) of all files below a folder, whatever their names; folders with a leading dot are not entered.

    Round by round tasks list the folders of a frontier, the first round the root; the driver only asks whether folders are left.
    A task goes on below its folders for a while, so there are fewer rounds than levels. A folder that does not exist is empty.
    """
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def made(rows):
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["rel_path", "folder", "size", "mtime_us", "file_id"])

    def entries_below(top: str, limit: int):
        queue = [top]
        for n in range(limit):
            if n >= len(queue):
                return
            below = f"{queue[n]}/" if queue[n] else ""
            for name, folder, *rest in _listed(f"{root}/{queue[n]}" if queue[n] else root):
                if not folder:
                    yield below + name.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), False, *rest
                elif not name.startswith("."):
                    queue.append(below + name)
        for rel in queue[limit:]:
            yield rel, True, 0, 0, None

    def listing(limit: int):
        def run(batches):
            for batch in batches:
                for top in batch.column(0).to_pylist():
                    for rows in batched(entries_below(top, limit), 10_000):
                        yield made(rows)

        return run

    found = stored(map_arrow(spark.createDataFrame([("",)], "rel_path string"), listing(1), _ROW), "tree-level")
    files = found.where("not folder")
    while not (frontier := found.where("folder").select("rel_path")).isEmpty():
        found = stored(map_arrow(frontier.repartition(parts), listing(FOLDERS), _ROW), "tree-level")
        files = files.unionAll(found.where("not folder"))
    return files.drop("folder")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """events(path, kind, from_path, size, mtime_us) between two listings.

    created: only in the new one. deleted: only in the old one. modified: another size or time. moved: gone from from_path and come
    to path with the same identity, size and time; where files have no identity, with the same size and time, if only one
    file went and one came with these. Any other move is a deletion and a creation.
    """
    had = old.select(F.col("rel_path").alias("old_path"), F.col("size").alias("old_size"), F.col("mtime_us").alias("old_mtime"), F.col("file_id").alias("old_id"))
    both = stored(new.join(had, F.col("rel_path") == F.col("old_path"), "full").where("not (old_path is not null and rel_path is not null and size = old_size and mtime_us = old_mtime)"), "tree-changes")
    key = lambda i, s, m: F.struct(F.coalesce(i, F.lit("")).alias("i"), s.alias("s"), m.alias("m"))
    went = both.where("rel_path is null").select(key(F.col("old_id"), F.col("old_size"), F.col("old_mtime")).alias("key"), F.col("old_path").alias("src"))
    came = both.where("old_path is null").select(key(F.col("file_id"), F.col("size"), F.col("mtime_us")).alias("key"), F.col("rel_path").alias("dest"))
    met = went.withColumn("dest", F.lit(None).cast("string")).unionByName(came.withColumn("src", F.lit(None).cast("string")))
    moves = met.groupBy("key").agg(F.count("src").alias("n"), F.count("dest").alias("m"), F.max("src").alias("src"), F.max("dest").alias("dest")).where("n = 1 and m = 1").select("src", "dest")
    rows = both.select(
        F.coalesce("rel_path", "old_path").alias("path"),
        F.when(F.col("old_path").isNull(), "created").when(F.col("rel_path").isNull(), "deleted").otherwise("modified").alias("kind"), "size", "mtime_us",
    )
    rows = rows.join(moves.select(F.col("src").alias("path"), F.lit("deleted").alias("kind")), ["path", "kind"], "left_anti")
    rows = rows.join(moves.select(F.col("dest").alias("path"), F.lit("created").alias("kind"), F.col("src").alias("from_path")), ["path", "kind"], "left")
    return rows.select("path", F.when(F.col("from_path").isNotNull(), "moved").otherwise(F.col("kind")).alias("kind"), "from_path", "size", "mtime_us")


_LISTING = "rel_path string, size long, mtime_us long, file_id string"


def _write_events(spark: SparkSession, home: str, number: int, existing: bool) -> None:
    """The events of a poll from its listing and the one before, unless they have their place already."""
    if not is_whole(spark, f"{home}/events/{number}"):
        new = spark.read.schema(_LISTING).parquet(f"{home}/listing/version={number}")
        old = spark.read.schema(_LISTING).parquet(f"{home}/listing/version={number - 1}") if number else spark.createDataFrame([], _LISTING)
        rows = changes(old, new).withColumn("ts", F.lit(dt.datetime.now(dt.UTC))) if number or existing else changes(old, old).withColumn("ts", F.lit(None).cast("timestamp"))
        rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{home}/staging/{number}")
        rename(spark, f"{home}/staging/{number}", f"{home}/events/{number}")


def poll_tree(spark: SparkSession, root: str, home: str, existing: bool = False) -> int:
    """Compare the tree with what it was at the last poll and add the events to ``home/events``; the number of the poll.

    Hidden files and what lies in hidden folders give no events. The first poll gives none, with existing one creation a file. A poll
    that was cut short before its events had their place is finished first. One watcher at a time polls for a home.
    """
    done = versions(spark, f"{home}/listing")
    if done:
        _write_events(spark, home, done[-1], existing)
    number = done[-1] + 1 if done else 0
    list_tree(spark, root).where(~F.element_at(F.split("rel_path", "/"), -1).startswith(".") & ~paths.is_hidden(F.col("rel_path"))).write.mode("overwrite").parquet(f"{home}/listing/version={number}")
    _write_events(spark, home, number, existing)
    for old in versions(spark, f"{home}/listing")[:-2]:
        delete(spark, f"{home}/listing/version={old}")
    return number


def watch_tree(spark: SparkSession, root: str, home: str, seconds: float = 5, existing: bool = False):
    """A streaming query that polls the tree every so many seconds; ``stream_files(spark, home + "/events")`` reads its events."""
    make(spark, f"{home}/events")  # where a stream may begin to read at once
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    poll = lambda batch, number: poll_tree(batch.sparkSession, root, home, existing)
    return ticks.writeStream.foreachBatch(poll).option("checkpointLocation", f"{home}/ticks").trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def polls(spark: SparkSession, home: str) -> list[int]:
    """The polls whose events have their place."""
    return sorted(int(name) for name in entries(spark, f"{home}/events") if name.isdigit())
