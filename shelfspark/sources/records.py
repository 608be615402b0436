"""Progress records, request logs and the audit trail: parsing and writing."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from shelfspark import schemas
from shelfspark.sources.places import delete, entries, versions


def read_progress(records: DataFrame, column: str = "json") -> DataFrame:
    """The fields of progress records in JSON; text that is no object, and records that are not active, are left out. Percent and done_pages default to 0, status to running."""
    parsed = F.from_json(F.col(column), schemas.PROGRESS, {"mode": "PERMISSIVE"})
    keep = [c for c in records.columns if c != column]
    rows = records.select(*keep, parsed.alias("p")).where("p.active")
    return rows.select(*keep, "p.*").withColumns({"percent": F.coalesce("percent", F.lit(0)), "done_pages": F.coalesce("done_pages", F.lit(0)), "status": F.coalesce("status", F.lit("running"))})


_LINE = r"^\[REQUEST\] \[([^\]]*)\] (\S+) (.*) -> (EXCEPTION|[0-9]{3}|\?\?\?) \(([0-9]+[.][0-9]{3})s\)(?:: ([^:]*): (.*))?\z"


def parse_request_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """thread, method, path, code, elapsed and, for failed requests, exception and message; other lines are left out."""
    part = lambda n: F.regexp_extract(column, _LINE, n)
    rows = lines.where(F.col(column).rlike(_LINE))
    failed = part(4) == "EXCEPTION"
    return rows.select(part(1).alias("thread"), part(2).alias("method"), part(3).alias("path"), F.when(part(4).rlike("^[0-9]+$"), part(4).cast("int")).alias("code"), part(5).cast("double").alias("elapsed"), F.when(failed, part(6)).alias("exception"), F.when(failed, part(7)).alias("message"))


def format_request_log(requests: DataFrame) -> DataFrame:
    """The line of requests(thread, method, path, code, elapsed_ms, exception, message): a failed request has its exception instead of the
    code and the message behind; one without either has an unknown code."""
    seconds = F.concat(F.floor(F.col("elapsed_ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("elapsed_ms") % 1000).cast("string"), 3, "0"))
    outcome = F.when(F.col("exception").isNotNull(), "EXCEPTION").otherwise(F.coalesce(F.col("code").cast("string"), F.lit("???")))
    why = F.when(F.col("exception").isNotNull(), F.concat(F.lit(": "), "exception", F.lit(": "), F.coalesce("message", F.lit("")))).otherwise("")
    return requests.select(F.concat(F.lit("[REQUEST] ["), "thread", F.lit("] "), "method", F.lit(" "), "path", F.lit(" -> "), outcome, F.lit(" ("), seconds, F.lit("s)"), why).alias("value"))


def write_audit(events: DataFrame, path: str) -> None:
    """Append audit rows, partitioned by day; rows of a day meet first, so that a day gets few files, and large days are split."""
    events.withColumn("dt", F.to_date("created_at")).hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)


def stream_audit(events: DataFrame, path: str, checkpoint: str, keep_days: int | None = None, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC), ahead: dt.timedelta = dt.timedelta(days=1)):
    """The same as a stream. With keep_days, every batch also drops the days that lie more than that before the day of the clock.

    No stamp of an event moves the clock. Events stamped more than ``ahead`` after it are wrong, and are filed under the day they
    came, so that they stay as long as others of that day; those without a time stay for good. read_audit is the reader that no
    deletion disturbs.
    """
    if keep_days is None:
        return events.withColumn("dt", F.to_date("created_at")).writeStream.format("parquet").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def add(batch: DataFrame, number: int) -> None:
        now = clock()
        late = F.col("created_at") > F.lit((now + ahead).isoformat()).cast(batch.schema["created_at"].dataType)
        day = F.when(late, F.lit(now.date())).otherwise(F.to_date("created_at"))
        # a batch that comes again overwrites what it wrote before; the day it came may have changed in between
        for old in entries(batch.sparkSession, path):
            if old.startswith("dt="):
                delete(batch.sparkSession, f"{path}/{old}/batch={number}")
        batch.withColumns({"dt": day, "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(path)
        drop_days(batch.sparkSession, path, keep_days, now.date(), number)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LIVE = "_live"  # hidden from readers of the trail


def drop_days(spark: SparkSession, path: str, keep_days: int, today: dt.date, number: int) -> None:
    """Version ``number`` of an audit trail begins keep_days before today. Day folders before the start of the version before it are
    deleted, so who reads by that one still finds what it has. A version never begins earlier than the one before."""
    past = [n for n in versions(spark, f"{path}/{_LIVE}") if n < number]
    begun = _start(spark, path, past[-1]) if past else ""
    first = max(begun, (today - dt.timedelta(days=keep_days)).isoformat())
    spark.createDataFrame([(first,)], "first string").coalesce(1).write.mode("overwrite").json(f"{path}/{_LIVE}/version={number}")
    for day in entries(spark, path):
        if re.fullmatch(r"dt=\d{4}-\d\d-\d\d", day) and day[3:] < begun:
            delete(spark, f"{path}/{day}")
    for old in past[:-1]:
        delete(spark, f"{path}/{_LIVE}/version={old}")


def _start(spark: SparkSession, path: str, version: int) -> str:
    return spark.read.schema("first string").json(f"{path}/{_LIVE}/version={version}").first()["first"]


def read_audit(spark: SparkSession, path: str, schema) -> DataFrame:
    """The trail as its newest version has it; rows without a time are in every version. Days are pruned before any file is opened."""
    found = versions(spark, f"{path}/{_LIVE}")
    rows = spark.read.schema(StructType([*schema.fields, StructField("dt", DateType()), StructField("batch", LongType())])).parquet(path)
    return rows.where(F.col("dt").isNull() | (F.col("dt") >= F.lit(_start(spark, path, found[-1])).cast("date"))).drop("dt", "batch") if found else rows.drop("dt", "batch")


def write_progress(updates: DataFrame, path: str, checkpoint: str, mode: str = "append", keep_finished: float = 86400, clock: Callable[[], float] = time.time):
    """Keeps a snapshot of running jobs in step with a stream of full states(job, active, updated_at, ...): a finished job leaves it.

    A snapshot is a folder ``version=N`` below path, N the batch; it is made of the one before and the batch's states, the
    latest of each job; at one time a finished state comes after an active one. A finished job stays as a tombstone for keep_finished
    seconds of the clock, so a state of it that comes later but is older cannot bring it back; one that is newer is the job begun
    again. read_snapshot reads the newest whole version without tombstones; older ones than the last two are deleted. A batch that
    comes again makes its own version anew.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark, rest, now = batch.sparkSession, [c for c in batch.columns if c != "job"], clock()
        old = _snapshot(spark, path, batch.schema, below=number)
        states = old.unionByName(batch.withColumn(_GONE, F.lit(None).cast("double")))
        order = F.struct("updated_at", F.col("active").isNull(), ~F.col("active"), F.coalesce(-F.col(_GONE), F.lit(float("-inf"))))
        latest = states.groupBy("job").agg(F.max_by(F.struct(*rest, _GONE), order).alias("s")).select("job", "s.*")
        marked = latest.withColumn(_GONE, F.when(~F.coalesce("active", F.lit(False)), F.coalesce(_GONE, F.lit(now))))
        marked.where(F.col(_GONE).isNull() | (F.col(_GONE) > now - keep_finished)).write.mode("overwrite").parquet(f"{path}/version={number}")
        for n in versions(spark, path)[:-2]:
            delete(spark, f"{path}/version={n}")

    return updates.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: When a job was first seen finished, in seconds of the clock; null while it runs.
_GONE = "__finished"


def _snapshot(spark: SparkSession, path: str, schema, below: int | None = None) -> DataFrame:
    found = [n for n in versions(spark, path) if below is None or n < below]
    whole = StructType([*schema.fields, StructField(_GONE, DoubleType())])
    return spark.read.schema(whole).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], whole)


def read_snapshot(spark: SparkSession, path: str, schema, below: int | None = None) -> DataFrame:
    """The running jobs of the newest version of a snapshot (before ``below``), without rows if there is none."""
    return _snapshot(spark, path, schema, below).where(F.col(_GONE).isNull()).drop(_GONE)
