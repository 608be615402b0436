"""Progress of jobs, from their updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.operators.running import running_total


def current_progress(updates: DataFrame) -> DataFrame:
    """The state after every one of updates(job, ts, id, fields map<string,string>).

    Later updates overwrite only the keys that they carry, with null too. ``done`` clears the state, so a job whose last
    update is done has none; started_at is the time of the first update since. One row per running job. Updates are counted over
    range blocks and folded before they meet, so a job may have any number.
    """
    done = F.coalesce(F.try_element_at("fields", F.lit("status")) == "done", F.lit(False))
    counted = running_total(updates.withColumn("done", done), ["job"], ["ts", "id"], F.col("done").cast("int"), "progress-updates", "upto")
    numbered = counted.withColumn("segment", F.col("upto") - F.col("done").cast("int"))
    ended = numbered.groupBy("job", "segment").agg(F.bool_or("done").alias("ended"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"))
    last = ended.groupBy("job").agg(F.max_by(F.struct("segment", "ended", "started_at", "updated_at"), "segment").alias("s")).select("job", "s.*").where("not ended")
    keys = numbered.select("job", "segment", "ts", "id", F.explode("fields").alias("key", "value")).groupBy("job", "segment", "key").agg(F.max_by(F.struct("value"), F.struct("ts", "id")).alias("last"))
    fields = keys.groupBy("job", "segment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("last.value").alias("value"))))).alias("fields"))
    return last.join(fields, ["job", "segment"], "left").select("job", "started_at", "updated_at", "fields")


def stalled_jobs(polls: DataFrame, idle: float = 600, finalizing: float = 900, hard: float = 3600) -> DataFrame:
    """The verdict of each job of polls(job, at, done, total, valid_sidecar), and when: hard, finalized, finalizing, idle or running.

    at counts seconds from the start of the job. At each poll: past the hard limit; all pages done for longer than
    finalizing (fine where a valid sidecar is there); no change of done for longer than idle. The first that holds ends the job.
    """
    by = Window.partitionBy("job").orderBy("at")
    marked = polls.withColumn("moved", F.coalesce(F.col("done") != F.lag("done").over(by), F.lit(True))).withColumn("complete", (F.col("total") > 0) & (F.col("done") >= F.col("total")))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    timed = marked.withColumn("moved_at", F.max(F.when(F.col("moved"), F.col("at"))).over(upto)).withColumn("open_at", F.max(F.when(~F.col("complete"), F.struct("at"))).over(upto))
    since = timed.withColumn("complete_since", F.min(F.when(F.col("complete"), F.col("at"))).over(Window.partitionBy("job", "open_at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    late = F.col("complete") & (F.col("at") - F.col("complete_since") > finalizing)
    verdict = (
        F.when(F.col("at") > hard, "hard")
        .when(late & F.coalesce("valid_sidecar", F.lit(False)), "finalized")
        .when(late, "finalizing")
        .when(F.col("at") - F.col("moved_at") > idle, "idle")
    )
    judged = since.withColumn("verdict", verdict)
    return judged.groupBy("job").agg(F.coalesce(F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("at"))), F.lit("running")).alias("verdict"), F.min(F.when(F.col("verdict").isNotNull(), F.col("at"))).alias("at"))
