"""Upload ownership as a keyed snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import layout
from shelfspark.functions import paths
from shelfspark.operators.library import ancestors

_COLUMNS = ["volume_key", "uploader_username", "uploaded_at", "last_modified_by", "last_modified_at"]


def volume_owner(rows: DataFrame, uploads: DataFrame, path: str = "path", sidecar: str = layout.SIDECAR) -> DataFrame:
    """rows with ``owner`` of the volume that the path belongs to; unknown paths have none."""
    keyed = rows.withColumn("__key", spread(paths.volume_key(F.col(path), sidecar), rows.columns))
    return keyed.join(uploads.select(F.col("volume_key").alias("__key"), F.col("uploader_username").alias("owner")), "__key", "left").drop("__key")


def spread(key: Column, columns: list[str]) -> Column:
    """key, or where it is null a text that no key has and few rows share: a left join then deals rows without a key out evenly."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*columns).cast("string")))


def can_delete(requests: DataFrame, uploads: DataFrame, root: str = layout.READER_ROOT, sidecar: str = layout.SIDECAR) -> DataFrame:
    """requests(path, username) with ``may_delete``: a library path, not a top-level folder, whose owner is the user."""
    inside = F.col("path").startswith(f"/{root}/")
    relative = paths.stripped(F.substring("path", len(root) + 3, 2**31 - 1))
    deep = relative.contains("/") | relative.contains(".")
    owned = volume_owner(requests.withColumn("relative", F.when(inside, relative)), uploads, "relative", sidecar)
    return owned.withColumn("may_delete", F.coalesce(inside & (relative != "") & deep & (F.col("owner") == F.col("username")), F.lit(False))).drop("owner", "relative")


def apply_uploads(uploads: DataFrame, events: DataFrame, sidecar: str = layout.SIDECAR) -> DataFrame:
    """uploads after events(path, username, ts): the first uploader stays, the last modifier is kept; other paths are ignored.

    One aggregation over old rows and events; events before the stored ones do not take a volume over. Ties go by user name.
    """
    new = events.select(paths.volume_key(F.col("path"), sidecar).alias("volume_key"), F.col("username").alias("user"), "ts").where("volume_key is not null")
    old_first = uploads.select("volume_key", F.col("uploader_username").alias("user"), F.col("uploaded_at").alias("ts"), F.lit(0).alias("age"), F.lit(True).alias("first"), F.lit(False).alias("last"))
    old_last = uploads.select("volume_key", F.col("last_modified_by").alias("user"), F.col("last_modified_at").alias("ts"), F.lit(0).alias("age"), F.lit(False).alias("first"), F.lit(True).alias("last"))
    both = old_first.unionByName(old_last).unionByName(new.select("volume_key", "user", "ts", F.lit(1).alias("age"), F.lit(True).alias("first"), F.lit(True).alias("last")))
    begin, end = F.struct("age", "ts", "user"), F.struct("age", "ts", "user")
    return both.groupBy("volume_key").agg(
        F.min_by("user", F.when(F.col("first"), begin)).alias("uploader_username"),
        F.min_by("ts", F.when(F.col("first"), begin)).alias("uploaded_at"),
        F.max_by("user", F.when(F.col("last"), end)).alias("last_modified_by"),
        F.max_by("ts", F.when(F.col("last"), end)).alias("last_modified_at"),
    )


def forget_uploads(uploads: DataFrame, removed: DataFrame, sidecar: str = layout.SIDECAR) -> DataFrame:
    """uploads without the volumes of removed(path)."""
    keys = removed.select(paths.volume_key(F.col("path"), sidecar).alias("volume_key")).where("volume_key is not null").distinct()
    return uploads.join(keys, "volume_key", "left_anti")


def forget_prefix(uploads: DataFrame, prefixes: DataFrame, prefix_match: str = "literal") -> DataFrame:
    """uploads without the volumes below prefixes(prefix); empty prefixes remove nothing.

    "literal" joins on the ancestor folders of each key. "like" ignores ASCII case and takes % and _ as wildcards, as a
    pattern match; prefixes without either join on lower-case ancestors. One with a wildcard is indexed by its literal text
    in front: keys join on their beginnings of the lengths that occur, and only what meets there is matched. A pattern that begins with a wildcard meets every key.
    """
    folders = prefixes.select(paths.stripped(F.col("prefix")).alias("folder")).where("folder <> ''").distinct()
    if prefix_match != "like":
        hit = uploads.select("volume_key", F.explode(ancestors(F.col("volume_key"))).alias("folder")).join(folders, "folder", "left_semi").select("volume_key").distinct()
        return uploads.join(hit, "volume_key", "left_anti")
    wild = F.col("folder").rlike(r"[%_\\]")
    plain = folders.where(~wild).select(F.lower("folder").alias("folder")).distinct()
    below = uploads.select("volume_key", F.explode(ancestors(F.lower("volume_key"))).alias("folder")).join(plain, "folder", "left_semi").select("volume_key")
    patterns = folders.where(wild).select(F.concat(F.lower("folder"), F.lit("/%")).alias("pattern")).withColumn("front", F.regexp_extract("pattern", r"(?s)^([^%_\\]*)", 1))
    lengths = [r["n"] for r in patterns.select(F.length("front").alias("n")).distinct().collect()]  # at most as many as a path has characters
    beginnings = F.array_distinct(F.array(*[F.substring("low", 1, n) for n in lengths]).cast("array<string>"))
    fronts = uploads.select("volume_key", F.lower("volume_key").alias("low")).distinct().select("volume_key", "low", F.explode(beginnings).alias("front"))
    matched = fronts.join(patterns, "front").where(F.like("low", F.col("pattern"))).select("volume_key")
    return uploads.join(below.unionAll(matched).distinct(), "volume_key", "left_anti")


def rename_uploads(uploads: DataFrame, renames: DataFrame, now: Column, sidecar: str = layout.SIDECAR) -> DataFrame:
    """uploads after renames(old_path, new_path): moved rows replace what lies at the new key and get ``now`` as last change.

    One rename per old key and batch; chains must be resolved before. Unknown, equal or foreign paths change nothing.
    Of several rows moved to one key, the one with the smallest old key stays.
    """
    moves = renames.select(paths.volume_key(F.col("old_path"), sidecar).alias("volume_key"), paths.volume_key(F.col("new_path"), sidecar).alias("new_key")).where("volume_key is not null and new_key is not null and volume_key <> new_key")
    joined = uploads.join(moves, "volume_key", "left")
    moved = F.col("new_key").isNotNull()
    target = joined.select(F.coalesce("new_key", "volume_key").alias("key"), moved.alias("moved"), F.col("volume_key").alias("old"), *_COLUMNS[1:4], F.when(moved, now).otherwise(F.col("last_modified_at")).alias("last_modified_at"))
    best = target.groupBy("key").agg(F.min_by(F.struct(*_COLUMNS[1:]), F.struct((~F.col("moved")).alias("stays"), "old")).alias("row"))
    return best.select(F.col("key").alias("volume_key"), "row.*")


def rename_folder(uploads: DataFrame, old: str, new: str, now: Column, sidecar: str = layout.SIDECAR) -> DataFrame:
    """rename_uploads for every volume below a folder."""
    prefix = f"{old.strip('/')}/"
    inside = uploads.where(F.col("volume_key").startswith(prefix))
    renames = inside.select(F.col("volume_key").alias("old_path"), F.concat(F.lit(f"{new.strip('/')}/"), F.substring("volume_key", len(prefix) + 1, 2**31 - 1)).alias("new_path"))
    return rename_uploads(uploads, renames, now, sidecar)


def delete_volumes(files: DataFrame, removed: DataFrame, sidecar: str = layout.SIDECAR) -> DataFrame:
    """files without removed(rel_path); removing a volume removes its sidecars, removing a sidecar only itself."""
    is_volume = F.lower("rel_path").endswith(layout.VOLUME)
    stem = F.substring("rel_path", F.lit(1), F.length("rel_path") - len(layout.VOLUME))
    with_sidecars = F.when(is_volume, F.array("rel_path", *[F.concat(stem, F.lit(e)) for e in layout.sidecars(sidecar)])).otherwise(F.array("rel_path"))
    gone = removed.select(F.explode(with_sidecars).alias("rel_path")).distinct()
    return files.join(gone, "rel_path", "left_anti")
