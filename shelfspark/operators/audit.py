"""The audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import layout
from shelfspark.functions import scalars


def recent_audit(audit: DataFrame, limit: int = 200) -> DataFrame:
    """Newest events first; the limit lies between 1 and 1000."""
    return audit.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 1000)))


def prune_audit(audit: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Events of the last days."""
    return audit.where(F.col("created_at") >= now - F.expr(f"INTERVAL '{days}' DAY"))


def audit_target(relative: Column, path: Column, folder: bool = False, root: str = layout.READER_ROOT) -> Column:
    """struct(target_type, target_path) of an event on a path; relative is the path below the library, if it is there."""
    inside = F.coalesce(relative, F.lit("")) != "" if folder else relative.isNotNull()
    name = F.element_at(F.split(path, "/"), -1)
    outside = F.lit("webdav_folder") if folder else F.when(name.isin(*layout.PER_USER_FILES), "progress").otherwise("webdav")
    return F.struct(F.when(inside, "library_folder" if folder else "library").otherwise(outside).alias("target_type"), F.when(inside, F.concat(F.lit(f"/{root}/"), relative)).otherwise(path).alias("target_path"))


def audit_display(audit: DataFrame) -> DataFrame:
    """id, actor, action, target and shortened details as a list shows them."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    target = F.coalesce(F.nullif("target_path", F.lit("")), F.nullif("target_username", F.lit("")), F.lit("-"))
    details = F.coalesce(F.nullif(scalars.truncate_text(F.col("details"), 120), F.lit("")), F.lit("-"))
    return audit.select("id", shown("actor_username").alias("actor"), "action", target.alias("target"), details.alias("details"))


def audit_from_changes(changes: DataFrame) -> DataFrame:
    """Audit rows of changes(id, actor, change, path, username, existed, ts); details are compact JSON without nulls, as null where empty."""
    action = F.when(F.col("change") == "write", F.when(F.col("existed"), "edit").otherwise("upload")).otherwise(F.col("change"))
    details = F.when(F.col("change") == "write", F.to_json(F.struct(F.col("existed").alias("existed_before"))))
    kind = F.when(F.col("change").startswith("invite_"), "invite").when(F.col("change").startswith("admin_") | (F.col("change") == "self_delete_account"), "user").otherwise("library")
    return changes.select("id", F.col("actor").alias("actor_username"), action.alias("action"), kind.alias("target_type"), F.col("path").alias("target_path"), F.col("username").alias("target_username"), details.alias("details"), F.col("ts").alias("created_at"))
