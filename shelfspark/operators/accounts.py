"""Users, invites and registration as keyed snapshots: new = operator(old, changes)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark import layout
from shelfspark.functions import scalars
from shelfspark.shared import discard, stored
from shelfspark.shipping import map_arrow


def user_by_name(users: DataFrame, name: str) -> DataFrame:
    return users.where(F.col("username") == name)


def list_users(users: DataFrame, status: str | None = None) -> DataFrame:
    """Users, newest first; ties by descending id."""
    rows = users if status is None else users.where(F.col("status") == status)
    return rows.select("id", "username", F.coalesce(scalars.normalize_role(F.col("role")), F.col("role")).alias("role"), "status", "notes", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def can_log_in(users: DataFrame) -> DataFrame:
    return users.where(F.col("status") == "active")


def user_count(users: DataFrame) -> DataFrame:
    return users.where("status <> 'deleted'").agg(F.count(F.lit(1)).alias("users"))


def has_admin(users: DataFrame) -> DataFrame:
    return users.agg(F.coalesce(F.bool_or(F.col("role") == "admin"), F.lit(False)).alias("has_admin"))


def permission_matrix(spark) -> DataFrame:
    """(role, permissions): a fixed table of six rows."""
    return spark.createDataFrame([(r, list(p)) for r, p in layout.PERMISSIONS.items()], "role string, permissions array<string>")


def permissions(users: DataFrame, matrix: DataFrame) -> DataFrame:
    """username, role, permissions (sorted) and the client flags; an unknown role has none."""
    joined = users.select("username", "role").join(F.broadcast(matrix), "role", "left")
    own = F.coalesce("permissions", F.array().cast("array<string>"))
    return joined.select("username", "role", F.array_sort(own).alias("permissions"), F.array_contains(own, "add_files").alias("can_add"), F.array_contains(own, "modify_delete").alias("can_modify"), F.array_contains(own, "admin").alias("is_admin"))


def invite_status(now: Column) -> Column:
    """used before expired before valid."""
    return F.when(F.coalesce("used_by", F.lit("")) != "", "used").when(now > F.col("expires_at"), "expired").otherwise("valid")


def list_invites(invites: DataFrame, include_used: bool, now: Column, compare: str = "timestamp") -> DataFrame:
    """Newest first, ties by code. Without used ones only those that are open.

    compare "reference_text" compares the two text forms that the old store kept (``T`` against a space between date and
    time), so an invite stays listed for all of its last day.
    """
    rows = invites if include_used else active_invites(invites, now, compare)
    return rows.orderBy(F.desc("created_at"), "code")


def active_invites(invites: DataFrame, now: Column, compare: str = "timestamp") -> DataFrame:
    open_ = F.col("expires_at") > now if compare == "timestamp" else F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss") > F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    return invites.where(F.col("used_by").isNull() & open_)


def validate_invites(invites: DataFrame, codes: DataFrame, now: Column) -> DataFrame:
    """The invites of codes(code) that exist, are unused and not expired."""
    return invites.join(codes.select("code").distinct(), "code", "left_semi").where((F.coalesce("used_by", F.lit("")) == "") & (F.col("expires_at") >= now))


def use_invites(invites: DataFrame, uses: DataFrame, now: Column) -> DataFrame:
    """invites after uses(code, username, use_id): a valid one is marked for the first use by use_id; others stay."""
    first = uses.groupBy("code").agg(F.min_by("username", "use_id").alias("by"))
    joined = invites.join(first, "code", "left")
    hit = F.col("by").isNotNull() & F.col("used_by").isNull() & (F.col("expires_at") >= now)
    out = joined.withColumns({"used_by": F.when(hit, F.col("by")).otherwise(F.col("used_by")), "used_at": F.when(hit, now).otherwise(F.col("used_at"))})
    return out.select(*invites.columns)


def cleanup_invites(invites: DataFrame, now: Column) -> DataFrame:
    """invites without the expired unused ones."""
    return invites.where(~((F.col("expires_at") < now) & F.col("used_by").isNull()))


def delete_invites(invites: DataFrame, codes: DataFrame) -> DataFrame:
    return invites.join(codes.select("code").distinct(), "code", "left_anti")


def create_invites(requests: DataFrame, now: Column) -> DataFrame:
    """Rows for requests(id, code, role, invited_by, duration); a bad role or duration gives no row (see rejected_invites)."""
    seconds, role = scalars.duration_seconds(F.col("duration")), scalars.normalize_role(F.col("role"))
    none = F.lit(None)
    return requests.where(seconds.isNotNull() & role.isNotNull()).select("id", "code", role.alias("role"), "invited_by", now.alias("created_at"), (now + F.make_dt_interval(secs=seconds)).alias("expires_at"), none.cast("string").alias("used_by"), none.cast("timestamp_ntz").alias("used_at"))


def rejected_invites(requests: DataFrame) -> DataFrame:
    bad = F.when(scalars.normalize_role(F.col("role")).isNull(), "role").when(scalars.duration_seconds(F.col("duration")).isNull(), "duration")
    return requests.withColumn("reason", bad).where(F.col("reason").isNotNull())


def update_users(users: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """users after changes(username, change, value), one per user, with ``changed``.

    Changes: role and notes set the value, approve takes pending users only, disable any, delete those not yet deleted.
    An unknown role changes nothing.
    """
    joined = users.join(changes.select("username", "change", "value"), "username", "left")
    role = scalars.normalize_role(F.col("value"))
    fits = F.coalesce(
        F.when(F.col("change") == "role", role.isNotNull())
        .when(F.col("change") == "notes", True)
        .when(F.col("change") == "approve", F.col("status") == "pending")
        .when(F.col("change") == "disable", True)
        .when(F.col("change") == "delete", F.col("status") != "deleted"),
        F.lit(False),
    )
    status = F.when(F.col("change") == "approve", "active").when(F.col("change") == "disable", "disabled").when(F.col("change") == "delete", "deleted")
    return joined.withColumn("changed", fits).select(
        "id", "username",
        F.when(F.col("changed") & (F.col("change") == "role"), role).otherwise(F.col("role")).alias("role"),
        F.when(F.col("changed"), F.coalesce(status, F.col("status"))).otherwise(F.col("status")).alias("status"),
        F.when(F.col("changed") & (F.col("change") == "notes"), F.col("value")).otherwise(F.col("notes")).alias("notes"),
        "created_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at")).alias("updated_at"), "changed",
    )


def create_users(users: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rejects with a reason) for new(id, username, role, status): valid, unknown names, the first id per name."""
    ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("username").orderBy("id")))
    known = users.select("username", F.lit(True).alias("known")).distinct()
    role = scalars.normalize_role(F.col("role"))
    reason = F.coalesce(scalars.username_error(F.col("username")), F.when(role.isNull(), "Invalid role"), F.when(F.col("known") | (F.col("rank") > 1), "Username already exists"))
    judged = ranked.join(known, "username", "left").withColumn("reason", reason)
    added = judged.where("reason is null").select("id", "username", role.alias("role"), "status", F.lit(None).cast("string").alias("notes"), now.alias("created_at"), now.alias("updated_at"))
    return added, judged.where("reason is not null").select("id", "username", "reason")


def register(requests: DataFrame, users: DataFrame, invites: DataFrame, mode: str, now: Column, default_role: str = "registered") -> DataFrame:
    """Outcome of requests(request_id, username, password_length, invite_code): status_code, error, role, status.

    Requests are taken in the order of request_id. Checks go in this order: mode, name, password, invite, known name. Only a
    request that is accepted takes its name and its invite; one that fails leaves both to later ones.
    """
    name = F.trim(F.coalesce("username", F.lit("")))
    length = F.coalesce("password_length", F.lit(0))
    password = F.when(length == 0, scalars.PASSWORD_MISSING).when(length < 8, scalars.PASSWORD_SHORT).when(length > 128, scalars.PASSWORD_LONG)
    known = users.select(F.col("username").alias("known_name")).distinct()
    open_ = invites.where((F.coalesce("used_by", F.lit("")) == "") & (F.col("expires_at") >= now)).select(F.col("code").alias("open_code"), F.col("role").alias("invite_role")).dropDuplicates(["open_code"])
    rows = requests.select("request_id", name.alias("username"), password.alias("password_error"), F.coalesce("invite_code", F.lit("")).alias("invite_code"))
    rows = rows.join(open_, rows["invite_code"] == open_["open_code"], "left").join(known, rows["username"] == known["known_name"], "left")
    invite_error = F.when(F.lit(mode == "invite"), F.when(F.col("invite_code") == "", "Invite code is required").when(F.col("open_code").isNull(), "Invalid or expired invite code"))
    early = F.coalesce(scalars.username_error(F.col("username")), F.col("password_error"), invite_error, F.when(F.col("known_name").isNotNull(), "Username already exists"))
    rows = rows.withColumn("early", early)
    if mode == "invite":
        taken = _accepted(rows.where("early is null").select("request_id", "username", "invite_code"))
        by_name = taken.select("username", F.col("request_id").alias("name_taken"))
        by_code = taken.select("invite_code", F.col("request_id").alias("code_taken"))
        rows = rows.join(by_name, "username", "left").join(by_code, "invite_code", "left")
        late = F.when(F.col("code_taken") < F.col("request_id"), "Invalid or expired invite code").when(F.col("name_taken") < F.col("request_id"), "Username already exists")
        # an early error of the name only: a used invite is found before it
        early = F.when((F.col("early") == "Username already exists") & (F.col("code_taken") < F.col("request_id")), "Invalid or expired invite code").otherwise(F.col("early"))
    else:
        first = F.min(F.when(F.col("early").isNull(), F.col("request_id"))).over(Window.partitionBy("username"))
        rows = rows.withColumn("name_taken", first)
        late, early = F.when(F.col("name_taken") < F.col("request_id"), "Username already exists"), F.col("early")
    error = F.when(F.lit(mode == "disabled"), "Registration is disabled").otherwise(F.coalesce(early, late))
    code = F.when(F.lit(mode == "disabled"), 403).when(error.isNull(), 201).when(error == "Username already exists", 409).otherwise(400)
    role = F.col("invite_role") if mode == "invite" else F.lit(default_role)
    return rows.select("request_id", "username", code.alias("status_code"), error.alias("error"), F.when(error.isNull(), role).alias("role"), F.when(error.isNull(), "pending" if mode == "approval" else "active").alias("status"))


#: Open requests that one task decides in order.
QUEUE_ROWS = 200_000


def _accepted(open_requests: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """Of requests(request_id, username, invite_code) those that are accepted, taken in order.

    A round has two halves. Where more than queue_rows are left, every request that is the first left both for its name and for its
    invite is accepted, by two aggregations and equi-joins, which decides most requests of any list that is not made to
    resist. Then the first queue_rows left are decided one by one in a single task. What shares a name or an invite with
    those accepted goes. A round thus decides queue_rows requests at least, whatever chains they form: who is next in
    a chain is only known when those before are decided, so the queue is as short as such lists allow.
    """
    accepted: list[DataFrame] = []

    def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
        return rows.join(taken.select("username"), "username", "left_anti").join(taken.select("invite_code"), "invite_code", "left_anti").select("request_id", "username", "invite_code")

    left = stored(open_requests.select("request_id", "username", "invite_code"), "register-left")
    while n := left.count():
        if n > queue_rows:
            names = left.groupBy("username").agg(F.min("request_id").alias("first_name"))
            codes = left.groupBy("invite_code").agg(F.min("request_id").alias("first_code"))
            ready = stored(left.join(names, "username").join(codes, "invite_code").where((F.col("request_id") == F.col("first_name")) & (F.col("request_id") == F.col("first_code"))).select("request_id", "username", "invite_code"), "register-accepted")
            accepted.append(ready)
            rest = stored(without(left, ready), "register-left")
            discard(left)
            left = rest
        queue = left.orderBy("request_id").limit(queue_rows)
        decided = stored(map_arrow(queue.coalesce(1).sortWithinPartitions("request_id"), _in_order, left.schema), "register-accepted")
        accepted.append(decided)
        if n <= queue_rows:
            break
        rest = stored(without(left, decided), "register-left")
        discard(left)
        left = rest
    return reduce(DataFrame.unionByName, accepted) if accepted else left


def _in_order(batches):
    """The requests of sorted batches that share neither name nor invite with one taken before."""
    names, codes = set(), set()
    for batch in batches:
        keep = []
        for name, code in zip(batch.column("username").to_pylist(), batch.column("invite_code").to_pylist(), strict=True):
            keep.append(name not in names and code not in codes)
            if keep[-1]:
                names.add(name)
                codes.add(code)
        yield batch.filter(pa.array(keep, pa.bool_()))


def conform(rows: DataFrame, schema, aliases: bool = True) -> DataFrame:
    """rows with the columns of schema, nulls where missing, and roles under their present names."""
    out = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    if aliases and "role" in out.columns:
        out = out.withColumn("role", F.coalesce(scalars.normalize_role(F.col("role")), F.col("role")))
    return out


def drop_user_files(user_files: DataFrame, deleted: DataFrame) -> DataFrame:
    return user_files.join(deleted.select("username").distinct(), "username", "left_anti")


def reading_stats(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Volumes, pages, characters and time of events(volume, pages, characters, seconds), over all or per key. An extension: only the fields are given."""
    seconds = F.coalesce(F.sum("seconds"), F.lit(0))
    made = events.groupBy(*(by or [])).agg(F.count_distinct("volume").alias("volumes"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_read"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters_read"), seconds.alias("reading_time_seconds"))
    return made.withColumn("reading_time_formatted", scalars.format_reading_time(F.col("reading_time_seconds")))
