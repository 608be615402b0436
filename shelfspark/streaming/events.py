"""Settled files, quiet periods, sign-in limits and job verdicts over streams, with their batch forms.

Streams use event time: ``ts`` is a timestamp with a watermark. Stateful ones need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from shelfspark.operators.running import Blocks
from shelfspark.shipping import ship
from shelfspark.streaming.limiter import answers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- quiet periods -----------------------------------------------------------------


def debounced_refresh(events: DataFrame, seconds: int, key: str = "library") -> DataFrame:
    """Batch: one refresh per quiet period of a key: (key, refreshed_at, events); a gap of ``seconds`` or more ends a period.

    A key may have all events: they are cut into range blocks, and each block begins with the last time of the block before.
    """
    blocks = Blocks(events.select(key, "ts"), [key], ["ts"], "refresh-events")
    timed = blocks.last(F.col("ts"), "before")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    begins = F.when(gap >= seconds * 1_000_000, 1).otherwise(0)
    period = blocks.total(begins, "period", timed)
    return period.groupBy(key, "period").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")).select(key, (F.col("last") + F.expr(f"INTERVAL '{seconds}' SECOND")).alias("refreshed_at"), "events")


def debounced_refresh_stream(events: DataFrame, seconds: int, watermark: str = "10 minutes", key: str = "library") -> DataFrame:
    """Stream form: session windows; a session leaves when the watermark passes its end."""
    sessions = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select(key, F.col("w.end").alias("refreshed_at"), "events")


def first_per_path(events: DataFrame) -> DataFrame:
    """Batch: the first event of each path by (ts, id); without an id by ts."""
    order = F.struct(*[c for c in ("ts", "id") if c in events.columns])
    rest = [c for c in events.columns if c != "path"]
    return events.groupBy("path").agg(F.min_by(F.struct(*rest), order).alias("e")).select("path", "e.*")


def once_per_path(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Stream: the first event of each path within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["path"])


# --- settled files -------------------------------------------------------------------


def settled_files(events: DataFrame, settle: float) -> DataFrame:
    """Batch: (path, settled_at) of events(path, kind, ts): a created file that no create or modify touched for ``settle`` seconds.

    Modifications of a file that is not waiting are ignored; a file deleted meanwhile does not settle; each path settles once.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = events.select("path", "kind", at.alias("at"))
    by = Window.partitionBy("path").orderBy("at")
    touched = rows.where(F.col("kind").isin("created", "modified"))
    island = F.sum(F.when(F.col("at") - F.lag("at").over(by) >= settle, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    fires = touched.withColumn("island", island).groupBy("path", "island").agg(F.max(F.when(F.col("kind") == "created", F.col("at"))).alias("created"), (F.max("at") + settle).alias("settled_at")).where("created is not null")
    deleted = rows.where("kind = 'deleted'").select(F.col("path").alias("p"), F.col("at").alias("gone"))
    alive = fires.join(deleted, (F.col("path") == F.col("p")) & (F.col("gone") >= F.col("created")) & (F.col("gone") < F.col("settled_at")), "left_anti")
    return alive.groupBy("path").agg(F.min("settled_at").alias("settled_at"))


class _Settle(StatefulProcessor):
    """State of a path only while it waits, and for ``forget`` after it settled; a timer ends either. Times are microseconds, as those of
    events are; timers have milliseconds and are set to the first one that is not before the end."""

    def __init__(self, settle: int, forget: int):
        self.settle, self.forget = settle, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "touched_micros long, alive boolean, settled_micros long")

    def _rest(self, at: int, touched: int, alive: bool, settled: int) -> tuple[int, bool, int, int | None]:
        """The state at a time, and when the path settled if it did since: a file that waited long enough, or a settled one forgotten."""
        fired = None
        if touched >= 0 and at - touched >= self.settle:
            if alive:
                fired = settled = touched + self.settle
            touched = -1
        if settled >= 0 and at - settled >= self.forget:
            settled = -1
        return touched, alive, settled, fired

    def _keep(self, touched: int, alive: bool, settled: int, expired: int = -1) -> None:
        """Store what is left, with one timer at the next end; the one that has just expired is gone by itself."""
        ends = [-(-t // 1000) for t in (touched + self.settle if touched >= 0 else -1, settled + self.forget if settled >= 0 else -1) if t >= 0]
        for old in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            if old != expired:
                self.handle.deleteTimer(old)
        if ends:
            self.state.update((touched, alive, settled))
            self.handle.registerTimer(min(ends))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        touched, alive, settled = self.state.get() if self.state.exists() else (-1, False, -1)
        events = sorted((ts.value // 1000, kind) for frame in rows for ts, kind in zip(frame["ts"], frame["kind"], strict=True))
        all_fired = []
        for at, kind in events:
            touched, alive, settled, fired = self._rest(at, touched, alive, settled)
            all_fired += [fired] if fired is not None else []
            if settled >= 0:
                continue
            if kind == "created":
                touched, alive = at, True
            elif kind == "modified" and touched >= 0:
                touched = at
            elif kind == "deleted":
                alive = False
        self._keep(touched, alive, settled)
        yield self._rows(key, all_fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        touched, alive, settled = self.state.get() if self.state.exists() else (-1, False, -1)
        now = expiredTimerInfo.getExpiryTimeInMs()
        touched, alive, settled, fired = self._rest(now * 1000, touched, alive, settled)
        self._keep(touched, alive, settled, now)
        yield self._rows(key, [fired] if fired is not None else [])

    def _rows(self, key, fired):
        return pd.DataFrame({"path": pd.Series([key[0]] * len(fired), dtype=str), "settled_at": pd.Series([(f - self.settle) / 1e6 + self.settle / 1e6 for f in fired], dtype=float)})

    def close(self) -> None:
        pass


def settled_files_stream(events: DataFrame, settle: float, watermark: str = "0 seconds", forget: float = 604800) -> DataFrame:
    """Stream form with an event-time timer per path, moved by every touch.

    A path has state while it waits and for ``forget`` seconds after it settled, so the state is as large as what lies within that
    time, whatever the number of paths ever seen. In this time nothing that happens to the path counts, and it does not settle again; a
    creation after it is a new file. Where no path is created again after ``forget``, the rows are those of the batch form.
    """
    ship(events.sparkSession)
    return events.withWatermark("ts", watermark).groupBy("path").transformWithStateInPandas(statefulProcessor=_Settle(round(settle * 1e6), round(forget * 1e6)), outputStructType="path string, settled_at double", outputMode="Append", timeMode="EventTime")


# --- sign-in limits --------------------------------------------------------------------


class _Limit(StatefulProcessor):
    def __init__(self, max_failures: int, window: float, block: float):
        self.limits = (max_failures, window, block)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures array<double>, blocked_until double")

    def handleInputRows(self, key, rows, timerValues):
        last, end = self.state.get() if self.state.exists() else ([], 0.0)
        events = sorted((ts.timestamp(), int(i), o or "") for frame in rows for ts, i, o in zip(frame["ts"], frame["attempt_id"], frame["outcome"], strict=True))
        made, last, end = answers([(at, o) for at, _, o in events], list(last), end, *self.limits)
        out = [(i, key[0], *answer) for (_, i, _), answer in zip(events, made, strict=True)]
        self.state.update((last, end))
        if events:
            self.handle.registerTimer(int((events[-1][0] + max(self.limits[1:])) * 1000) + 1)
        yield pd.DataFrame(out, columns=["attempt_id", "key", "allowed", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        failures, until = self.state.get() if self.state.exists() else ([], 0.0)
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if until <= now and not any(f >= now - self.limits[1] for f in failures):
            self.state.clear()
        yield pd.DataFrame({"attempt_id": pd.Series(dtype="int64"), "key": pd.Series(dtype=str), "allowed": pd.Series(dtype=bool), "retry_after": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def login_limiter_stream(attempts: DataFrame, max_failures: int = 10, window: float = 300, block: float = 900, watermark: str = "0 seconds") -> DataFrame:
    """Stream form of replay_limiter over attempts(attempt_id, key, ts, outcome); idle keys are forgotten by a timer."""
    ship(attempts.sparkSession)
    return attempts.withWatermark("ts", watermark).groupBy("key").transformWithStateInPandas(statefulProcessor=_Limit(max_failures, window, block), outputStructType="attempt_id long, key string, allowed boolean, retry_after long", outputMode="Append", timeMode="EventTime")


# --- job verdicts and latest progress -----------------------------------------------------


class _Watch(StatefulProcessor):
    """The verdict on a job, by its polls and by event-time timers at the earliest time that a limit can be passed."""

    def __init__(self, idle: float, finalizing: float, hard: float):
        self.idle, self.finalizing, self.hard = idle, finalizing, hard

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "done long, moved double, complete double, valid boolean, ended boolean")

    def verdict(self, at: float, moved: float, complete: float, valid: bool) -> str | None:
        if at > self.hard:
            return "hard"
        if complete >= 0 and at - complete > self.finalizing:
            return "finalized" if valid else "finalizing"
        return "idle" if at - moved > self.idle else None

    def handleInputRows(self, key, rows, timerValues):
        last, moved, complete, valid, ended = self.state.get() if self.state.exists() else (-1, 0.0, -1.0, False, False)
        out = []
        polls = sorted((float(a), int(d), int(t), bool(v)) for f in rows for a, d, t, v in zip(f["at"], f["done"], f["total"], f["valid_sidecar"], strict=True))
        for at, done, total, valid in polls:
            if ended:
                break
            if done != last:
                last, moved = done, at
            complete = (complete if complete >= 0 else at) if total > 0 and done >= total else -1.0
            found = self.verdict(at, moved, complete, valid)
            if found:
                ended = True
                out.append((key[0], found, at))
        self.state.update((last, moved, complete, valid, ended))
        if self.timed and not ended and polls:
            self._next(moved, complete)
        yield pd.DataFrame(out, columns=["job", "verdict", "at"])

    timed = False

    def _next(self, moved: float, complete: float) -> None:
        """One timer, at the earliest limit; a limit is passed a millisecond after it."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        limits = [self.hard, moved + self.idle, *([complete + self.finalizing] if complete >= 0 else [])]
        self.handle.registerTimer(int(min(limits) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, moved, complete, valid, ended = self.state.get() if self.state.exists() else (-1, 0.0, -1.0, False, True)
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        found = None if ended else self.verdict(at, moved, complete, valid)
        if found:
            self.state.update((last, moved, complete, valid, True))
        yield pd.DataFrame([(key[0], found, at)] if found else [], columns=["job", "verdict", "at"]).astype({"job": "int64", "at": "float64"})

    def close(self) -> None:
        pass


class _WatchTimed(_Watch):
    timed = True


def stalled_jobs_stream(polls: DataFrame, idle: float = 600, finalizing: float = 900, hard: float = 3600, watermark: str | None = None) -> DataFrame:
    """Stream form of stalled_jobs: a row when a job ends by a limit.

    With a watermark, polls also have ``ts`` (the time of day at which ``at`` seconds of event time have passed since the epoch), and a
    silent job gets its verdict when the watermark passes the limit, without another poll of its own; ``at`` is then the limit and a millisecond.
    """
    ship(polls.sparkSession)
    if watermark is None:
        return polls.groupBy("job").transformWithStateInPandas(statefulProcessor=_Watch(idle, finalizing, hard), outputStructType="job long, verdict string, at double", outputMode="Append", timeMode="None")
    timed = polls.withWatermark("ts", watermark)
    return timed.groupBy("job").transformWithStateInPandas(statefulProcessor=_WatchTimed(idle, finalizing, hard), outputStructType="job long, verdict string, at double", outputMode="Append", timeMode="EventTime")


def latest_progress_stream(updates: DataFrame) -> DataFrame:
    """Stream in update mode: the latest state of every job of updates(job, ts, ...)."""
    rest = [c for c in updates.columns if c != "job"]
    return updates.groupBy("job").agg(F.max_by(F.struct(*rest), "ts").alias("s")).select("job", "s.*")
