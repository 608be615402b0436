"""Decisions on requests, in bulk: an audit of what a gate would answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import layout
from shelfspark.functions import paths
from shelfspark.operators.ownership import can_delete, spread
from shelfspark.operators.running import Blocks, running_total
from shelfspark.shared import discard, stored
from shelfspark.shipping import map_arrow


def authorize(requests: DataFrame, users: DataFrame, uploads: DataFrame, matrix: DataFrame, browse: bool = True, download: bool = True, root: str = layout.READER_ROOT, sidecar: str = layout.SIDECAR) -> DataFrame:
    """requests(request_id, method, path, username, auth_state) with role, status_code and reason.

    auth_state is ok, anonymous, failed or blocked. The order of the rules decides between 401 and 403: preflight, failed
    sign-in, admin paths, reads, then each way of writing. Unknown methods are allowed.
    """
    rows = can_delete(requests, uploads, root, sidecar)
    known = users.select(F.col("username").alias("__user"), F.col("role").alias("user_role"))
    rows = rows.withColumn("__user", spread(F.col("username"), rows.columns)).join(known, "__user", "left").drop("__user")
    signed = F.col("auth_state") == "ok"
    rows = rows.withColumn("role", F.when(signed, F.col("user_role")).otherwise("anonymous"))
    rows = rows.join(F.broadcast(matrix), "role", "left")  # six rows
    may = lambda p: F.coalesce(F.array_contains("permissions", p), F.lit(False))
    path, method = F.col("path"), F.col("method")
    library, progress = paths.is_library_path(path, root), paths.is_progress_file(path, root)
    answer = lambda code, why: F.struct(F.lit(code).alias("status_code"), F.lit(why).alias("reason"))
    ok, sign_in = answer(200, "allowed"), answer(401, "authentication required")
    refuse = lambda why: F.when(signed, answer(403, why)).otherwise(sign_in)
    needs = lambda p, why: F.when(may(p), ok).otherwise(refuse(why))
    own_progress = F.when(~signed, sign_in).when(~may("write_progress"), answer(403, "cannot save progress")).otherwise(ok)
    admin = (
        F.when(method.isin("GET", "HEAD") & ~path.contains("/api/"), ok)
        .when(paths.is_invite_api_path(path), needs("manage_invites", "invite management required"))
        .otherwise(needs("admin", "admin required"))
    )
    closed = F.when(method == "PROPFIND", F.lit(not browse)).when(library, F.lit(not download)).otherwise(F.lit(not browse) & path.isin("/", f"/{root}"))
    read = F.when(~signed & closed, sign_in).otherwise(ok)
    change = needs("modify_delete", "cannot modify or delete")
    put = F.when(progress, own_progress).when(library, needs("add_files", "cannot add files")).otherwise(answer(403, "unsupported target"))
    mkcol = F.when(library, needs("add_files", "cannot create directories")).otherwise(answer(403, "unsupported target"))
    delete = F.when(progress, own_progress).when((F.col("role") == "uploader") & library & F.col("may_delete"), ok).otherwise(change)
    decided = (
        F.when(method == "OPTIONS", ok)
        .when(F.col("auth_state") == "blocked", answer(429, "too many failed attempts"))
        .when(F.col("auth_state") == "failed", answer(401, "sign-in failed"))
        .when(paths.is_admin_path(path), admin)
        .when(method.isin("GET", "HEAD", "PROPFIND"), read)
        .when(method == "PUT", put)
        .when(method == "MKCOL", mkcol)
        .when(method == "DELETE", delete)
        .when(method.isin("MOVE", "COPY", "LOCK", "UNLOCK"), F.when(progress, own_progress).otherwise(change))
        .when(method == "PROPPATCH", change)
        .otherwise(ok)
    )
    return rows.withColumn("decision", decided).select("request_id", "method", "path", "username", "role", "decision.status_code", "decision.reason")


def match_origin(requests: DataFrame, patterns: DataFrame) -> DataFrame:
    """requests(origin) that a pattern allows: the same text, or ``prefix:*`` with digits as the port.

    Both forms are an equality on the origin or on the origin without its port, so this is a hash join.
    """
    port = F.col("origin").rlike(r"^.*:[0-9]+\z")
    keys = F.array_compact(F.array(F.concat(F.lit("="), "origin"), F.when(port, F.concat(F.lit("*"), F.regexp_replace("origin", r":[0-9]+\z", "")))))
    allowed = patterns.select(F.when(F.col("pattern").endswith(":*"), F.concat(F.lit("*"), F.regexp_replace("pattern", r":\*\z", ""))).when(~F.col("pattern").contains("*"), F.concat(F.lit("="), "pattern")).alias("key")).where("key is not null").distinct()
    origins = requests.select("origin").where("origin is not null").distinct().select("origin", F.explode(keys).alias("key")).join(allowed, "key", "left_semi").select("origin").distinct()
    return requests.join(origins, "origin", "left_semi")


def failures_in_window(attempts: DataFrame, seconds: int) -> DataFrame:
    """attempts with ``failures``: failed ones of the key in the trailing window, its edge included.

    The count is a difference of two running totals of failures, one at the attempt's time and one just before the window, both taken
    over range blocks: a key may have all attempts. Attempts may repeat.
    """
    rows = stored(attempts.withColumn("__row", F.monotonically_increasing_id()), "attempts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    failed = F.col("outcome") == "failure"
    # at one time: the begins of windows, then failures, then the ends
    marks = rows.select("key", "__row", F.explode(F.array_compact(F.array(
        F.struct((at - seconds * 1_000_000).alias("at"), F.lit(0).alias("place"), F.lit(-1).alias("sign")),
        F.when(failed, F.struct(at.alias("at"), F.lit(1).alias("place"), F.lit(0).alias("sign"))),
        F.struct(at.alias("at"), F.lit(2).alias("place"), F.lit(1).alias("sign")),
    ))).alias("m")).select("key", "__row", "m.*")
    totals = running_total(marks, ["key"], ["at", "place"], F.when(F.col("place") == 1, 1).otherwise(0), "attempt-marks", "upto")
    counts = totals.where("place <> 1").groupBy("__row").agg(F.sum(F.col("sign") * F.col("upto")).alias("failures"))
    return rows.join(counts, "__row").drop("__row")


def auth_states(headers: DataFrame, column: str) -> DataFrame:
    """headers with state and username of a Basic header; the password is never returned."""
    return headers.withColumn("__auth", paths.auth_header(F.col(column))).select(*[c for c in headers.columns if c != column], F.col("__auth.state").alias("state"), F.col("__auth.username").alias("username"))


#: Crowded attempts of a key that one task goes through.
KEY_ROWS = 200_000


def replay_limiter(attempts: DataFrame, max_failures: int = 10, window: float = 300, block: float = 900, key_rows: int = KEY_ROWS) -> DataFrame:
    """Limiter outcomes of attempts(attempt_id, key, ts, outcome), in time order for each key: allowed and retry_after.

    An attempt is crowded if the last ``max_failures`` failures before it came after the last success and within the window.
    The first crowded attempt of a key begins a block; each block is followed by the first crowded attempt whose oldest counted
    failure is not older than the block's end (nothing is counted during a block). Everything up to ``block`` seconds after a
    begin is refused. Ties in time go by attempt_id.

    Counts and last times are taken over range blocks, as a key may have all attempts. The crowded attempts of a key are gone through in one
    pass; where a key has more than key_rows of them, each finds the one that would follow it, and which of them are reached from the
    first is found by doubling these steps: a chain of n blocks takes about log2 n rounds of two equi-joins.
    """
    rows = attempts.select("attempt_id", "key", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.coalesce("outcome", F.lit("")).alias("outcome"))
    failed = F.col("outcome") == "failure"
    blocks = Blocks(rows, ["key"], ["at", "attempt_id"], "limiter-attempts")
    counted = blocks.total(failed.cast("int"), "upto", blocks.last(F.when(F.col("outcome") == "success", F.struct("at", "attempt_id")), "cleared"))
    counted = counted.withColumn("failures", F.col("upto") - failed.cast("int"))
    if max_failures > 0:
        numbered = counted.where(failed).select(F.col("key").alias("own_key"), (F.col("failures") + max_failures).alias("number"), F.col("at").alias("oldest"), F.struct("at", "attempt_id").alias("oldest_place"))
        met = counted.join(numbered, F.col("key").eqNullSafe(F.col("own_key")) & (F.col("failures") == F.col("number")))
        crowded = met.where((F.col("oldest") >= F.col("at") - window) & (F.col("cleared").isNull() | (F.col("oldest_place") > F.col("cleared"))))
    else:
        crowded = counted.withColumn("oldest", F.col("at"))
    crowded = stored(crowded.select("attempt_id", "key", "at", "oldest"), "limiter-crowded")
    hot = crowded.groupBy("key").count().where(F.col("count") > key_rows).select(F.col("key").alias("hot"))
    if hot.isEmpty():
        begins = _begins_in_order(crowded, block)
    else:
        hot = stored(hot, "limiter-hot")
        same = F.col("key").eqNullSafe(F.col("hot"))
        begins = _begins_in_order(crowded.join(hot, same, "left_anti"), block).unionAll(_begins(stored(crowded.join(hot, same, "left_semi"), "limiter-far"), block))
    begins = begins.withColumn("begins", F.lit(True))
    marked = Blocks(rows.join(begins, "attempt_id", "left"), ["key"], ["at", "attempt_id"], "limiter-begins")
    started = marked.last(F.when(F.col("begins"), F.col("at")), "start")
    left = F.col("start") + block - F.col("at")
    wait = F.when(F.col("begins"), F.lit(int(block))).when(left > 0, F.floor(left).cast("long") + 1).otherwise(0).cast("long")
    return started.select("attempt_id", "key", (~F.coalesce("begins", F.lit(False)) & ~F.coalesce(left > 0, F.lit(False))).alias("allowed"), wait.alias("retry_after"))


def _begins_in_order(crowded: DataFrame, block: float) -> DataFrame:
    """attempt_id of those of crowded(attempt_id, key, at, oldest) that begin a block: one pass over each key, with one number as state."""

    def run(batches):
        key, end = None, None
        for batch in batches:
            begins = []
            for k, at, oldest in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if k != key or end is None:
                    key, end = k, float("-inf")
                begins.append(oldest >= end)
                end = at + block if begins[-1] else end
            yield batch.select(["attempt_id"]).filter(pa.array(begins, pa.bool_()))

    return map_arrow(crowded.repartition("key").sortWithinPartitions("key", "at", "attempt_id"), run, "attempt_id long")


def _begins(crowded: DataFrame, block: float) -> DataFrame:
    """The same by doubling, for keys of any size; oldest does not fall in the order of (at, attempt_id)."""
    if crowded.isEmpty():
        return crowded.select("attempt_id")
    first = crowded.groupBy("key").agg(F.min(F.struct("at", "attempt_id")).alias("first")).select("first.attempt_id")
    # from late to early: of the attempts not older than the end of a block the one met last is the earliest
    asked = crowded.select("key", "attempt_id", F.explode(F.array(
        F.struct((-F.col("oldest")).alias("back"), F.lit(0).alias("place"), (-F.col("at")).alias("late"), (-F.col("attempt_id")).alias("high")),
        F.struct((-(F.col("at") + block)).alias("back"), F.lit(1).alias("place"), F.lit(0.0).alias("late"), (-F.col("attempt_id")).alias("high")),
    )).alias("m")).select("key", "attempt_id", "m.*")
    ordered = Blocks(asked, ["key"], ["back", "place", "late", "high"], "limiter-steps")
    steps = stored(ordered.last(F.when(F.col("place") == 0, F.col("attempt_id")), "to").where("place = 1 and to is not null").select("attempt_id", "to"), "limiter-steps")
    ordered.discard()
    reached = stored(first, "limiter-reached")
    while True:
        further = stored(reached.join(steps, "attempt_id").select(F.col("to").alias("attempt_id")), "limiter-reached")
        if further.isEmpty():
            discard(steps, further)
            return reached
        wider, longer = stored(reached.unionAll(further), "limiter-reached"), stored(steps.join(steps.select(F.col("attempt_id").alias("to"), F.col("to").alias("beyond")), "to").select("attempt_id", F.col("beyond").alias("to")), "limiter-steps")
        discard(reached, further, steps)
        reached, steps = wider, longer
