"""The file inventory as volumes, series and work queues."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import layout
from shelfspark.functions import paths, scalars
from shelfspark.operators.running import running_total
from shelfspark.shared import stored
from shelfspark.shipping import map_arrow


def drop_hidden(files: DataFrame, scope: str = "index") -> DataFrame:
    """Files outside hidden directories; scope "index" also leaves out files in the root itself, scope "worker" keeps everything."""
    if scope == "worker":
        return files
    return files.where(~paths.is_hidden(F.col("rel_path")) & F.col("rel_path").contains("/"))


def relevant_changes(events: DataFrame, sidecar: str = layout.SIDECAR) -> DataFrame:
    """Directory events, and events whose source or destination is a library file."""
    ends = rf"({'|'.join(e.replace('.', '[.]') for e in (layout.VOLUME, sidecar, '.gz', layout.COVER))})\z"
    named = lambda c: F.coalesce(F.lower(c).rlike(ends), F.lit(False))
    return events.where(F.col("is_directory") | named(F.col("path")) | named(F.col("dest_path")))


def processable(files: DataFrame) -> DataFrame:
    """(path, kind): archives by their ending, and directories with an image directly inside."""
    ext = F.lower(F.regexp_extract("rel_path", r"[^/][.]([^./]+)\z", 1))
    archives = files.where(ext.isin(*layout.ARCHIVES)).select(F.col("rel_path").alias("path"), F.lit("file").alias("kind"))
    folders = files.where(ext.isin(*layout.IMAGES) & F.col("rel_path").contains("/")).select(paths.series_of(F.col("rel_path")).alias("path"), F.lit("directory").alias("kind")).distinct()
    return archives.unionByName(folders)


def attach_sidecars(files: DataFrame, sidecar: str = layout.SIDECAR, scope: str = "index") -> DataFrame:
    """One row per volume of visible files: series, name, has_cbz, has_sidecar, has_sidecar_gz, has_cover, no_cover, cover, mtime.

    One aggregation by (series, stem) instead of a join per ending. A volume whose ending is not in lower case is
    listed with has_cbz false. Repeated files count once.
    """
    seen = drop_hidden(files, scope).select(paths.series_of(F.col("rel_path")).alias("series"), paths.name_of(F.col("rel_path")).alias("file"), "mtime")
    ends = [e for e in (layout.VOLUME, *layout.sidecars(sidecar))]
    stem = reduce(lambda c, e: c.when(F.col("file").endswith(e), F.substring("file", F.lit(1), F.length("file") - len(e))), sorted(ends, key=len, reverse=True), F.when(F.lit(False), ""))
    stem = F.coalesce(stem, paths.volume_of(F.col("file")))
    has = lambda e: F.bool_or(F.col("file").endswith(e)) if e != sidecar else F.bool_or(F.col("file") == F.concat("name", F.lit(e)))
    named = seen.withColumn("name", stem).where(F.col("name").isNotNull())
    volumes = named.groupBy("series", "name").agg(
        F.bool_or(F.lower("file").endswith(layout.VOLUME)).alias("listed"),
        has(layout.VOLUME).alias("has_cbz"),
        has(sidecar).alias("has_sidecar"),
        has(f"{sidecar}.gz").alias("has_sidecar_gz"),
        has(layout.COVER).alias("has_cover"),
        has(layout.NO_COVER).alias("no_cover"),
        F.max(F.when(F.col("file").endswith(layout.VOLUME), F.col("mtime"))).alias("mtime"),
    )
    cover = F.when(F.col("has_cover"), F.concat("series", F.lit("/"), "name", F.lit(layout.COVER)))
    return volumes.where("listed").drop("listed").withColumn("cover", cover)


def needs_sidecar(volumes: DataFrame) -> DataFrame:
    return volumes.where("has_cbz and not has_sidecar and not has_sidecar_gz")


def needs_thumbnail(volumes: DataFrame) -> DataFrame:
    return volumes.where("has_cbz and not has_cover and not no_cover")


def orphan_sidecars(files: DataFrame, sidecar: str = layout.SIDECAR) -> DataFrame:
    """Sidecar files without their volume."""
    key = paths.volume_key(F.col("rel_path"), sidecar)
    is_volume = F.lower("rel_path").endswith(layout.VOLUME)
    side = files.withColumn("volume_key", key).where(F.col("volume_key").isNotNull() & ~is_volume)
    own = files.where(F.col("rel_path").endswith(layout.VOLUME)).select(paths.stripped(F.col("rel_path")).alias("volume_key"))
    return side.join(own, "volume_key", "left_anti").select("rel_path", "volume_key")


def corrupt_sidecars(sidecars: DataFrame, valid: Column) -> DataFrame:
    """Sidecars that do not parse; null counts as corrupt."""
    return sidecars.where(~F.coalesce(valid, F.lit(False)))


def valid_sidecar(json: Column) -> Column:
    """Whether the text is JSON, by Spark's parser (stricter than Python's: no NaN, no repeated keys)."""
    return F.try_parse_json(json).isNotNull()


#: Volumes in one row of a series.
PAGE_VOLUMES = 10_000


def series_rollup(volumes: DataFrame, page_volumes: int = PAGE_VOLUMES) -> DataFrame:
    """series, page, cover (of the first volume of the series that has one) and volumes in name order: a row for each page_volumes volumes of a series, pages from 0, so that no row grows with the library."""
    numbered = running_total(volumes, ["series"], ["name"], F.lit(1), "series", "number")
    covers = numbered.groupBy("series").agg(F.min_by("cover", F.when(F.col("cover").isNotNull(), F.col("name"))).alias("cover"))
    item = F.struct("name", "has_cbz", "has_sidecar", "has_sidecar_gz", "cover")
    pages = numbered.groupBy("series", F.expr(f"(number - 1) div {page_volumes}").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("volumes"))
    return pages.join(covers, "series").select("series", "page", "cover", "volumes")


def series_detail(volumes: DataFrame, name: str) -> DataFrame:
    return series_rollup(volumes.where(F.col("series") == name))


def pending_thumbnails(volumes: DataFrame) -> DataFrame:
    return volumes.agg(F.count_if(F.expr("has_cbz and not has_cover and not no_cover")).alias("pending_thumbnails"))


def volume_count(volumes: DataFrame) -> DataFrame:
    return volumes.groupBy("series").agg(F.count(F.lit(1)).alias("volumes"))


def top_level_count(files: DataFrame) -> DataFrame:
    """Distinct first directories; files in the root have none."""
    first = F.when(F.col("rel_path").contains("/"), F.substring_index("rel_path", "/", 1))
    return files.agg(F.count_distinct(first).alias("directories"))


def page_json_count(files: DataFrame) -> DataFrame:
    """Finished pages per job: JSON files below its ``_ocr`` folder."""
    page = files.where(F.col("rel_path").rlike(r"^[^/]+/_ocr/.*[.]json\z"))
    return page.groupBy(F.substring_index("rel_path", "/", 1).alias("job")).agg(F.count(F.lit(1)).alias("pages"))


def distinct_volumes(files: DataFrame) -> DataFrame:
    """Distinct (series, name) of visible volume files."""
    seen = drop_hidden(files)
    return seen.select(paths.series_of(F.col("rel_path")).alias("series"), paths.volume_of(F.col("rel_path")).alias("name")).where(F.col("name").isNotNull()).distinct()


def corrupt_count(sidecars: DataFrame, valid: Column) -> DataFrame:
    return sidecars.agg(F.count_if(~F.coalesce(valid, F.lit(False))).alias("corrupt"))


def image_counts(archives: DataFrame, members: DataFrame) -> DataFrame:
    """Images per archive; an archive without readable members has none."""
    image = F.lower(F.regexp_extract("member", r"[^/][.]([^./]+)\z", 1)).isin(*layout.ARCHIVE_IMAGES)
    counts = members.groupBy("rel_path").agg(F.count_if(image).alias("images"))
    return archives.select("rel_path").join(counts, "rel_path", "left").select("rel_path", F.coalesce("images", F.lit(0)).alias("images"))


def cover_member(members: DataFrame) -> DataFrame:
    """First image of each archive by member name."""
    image = members.where(F.lower(F.regexp_extract("member", r"[^/][.]([^./]+)\z", 1)).isin(*layout.IMAGES))
    return image.groupBy("rel_path").agg(F.min("member").alias("cover_member"))


def overlay_progress(volumes: DataFrame, progress: DataFrame) -> DataFrame:
    """volumes with active, pending and the progress of the job on them; keys match in any (ASCII) case. Several jobs on one volume: the latest update counts."""
    one = progress.where(F.col("active")).groupBy(F.lower("relative_cbz").alias("key")).agg(F.max_by(F.struct("percent", "eta_seconds", "status", "done_pages", "total_pages"), F.coalesce("updated_at", F.lit(0.0))).alias("progress"))
    keyed = volumes.withColumn("key", F.lower(F.concat("series", F.lit("/"), "name", F.lit(layout.VOLUME))))
    active = F.col("progress").isNotNull()
    pending = F.expr("has_cbz and not has_sidecar and not has_sidecar_gz")
    return keyed.join(one, "key", "left").withColumns({"active": active, "pending": pending & ~active}).drop("key")


def pending_queue(volumes: DataFrame, tie_break: str = "index", inflight: DataFrame | None = None) -> DataFrame:
    """series, name, mtime and library position of volumes that wait, oldest first inside each top-level directory.

    Ties go by (series, name) for "index", and by the relative path for "worker".
    """
    waiting = needs_sidecar(volumes)
    if inflight is not None:
        waiting = waiting.join(inflight.select("series", "name"), ["series", "name"], "left_anti")
    tie = ["series", "name"] if tie_break == "index" else ["path"]
    keyed = waiting.select(F.substring_index("series", "/", 1).alias("library"), "series", "name", "mtime", F.concat("series", F.lit("/"), "name", F.lit(layout.VOLUME)).alias("path"))
    return running_total(keyed, ["library"], ["mtime", *tie], F.lit(1), "queue", "position").drop("path")


def queue_order(waiting: DataFrame) -> DataFrame:
    """waiting with ``queue_position`` over all libraries, oldest first, ties by (series, name): a running total over range blocks, so no
    task sees the whole queue."""
    return running_total(waiting, [], ["mtime", "series", "name"], F.lit(1), "queue", "queue_position")


def catalog_order(rows: DataFrame) -> DataFrame:
    """Series in walk order: by path component, not by plain text."""
    return rows.orderBy(F.split("series", "/"))


def queue_status(volumes: DataFrame, progress: DataFrame, backend: str) -> DataFrame:
    """One row: the current job, how many volumes wait for text and for covers, and the backend. The list itself is pending_queue."""
    current = progress.where(F.col("active")).agg(F.max_by(F.struct("series", "volume", F.coalesce("percent", F.lit(0)).alias("percent"), "eta_seconds", F.coalesce("done_pages", F.lit(0)).alias("done_pages"), "total_pages", F.coalesce("status", F.lit("running")).alias("status")), F.coalesce("updated_at", F.lit(0.0))).alias("current"))
    counts = volumes.agg(F.count_if(F.expr("has_cbz and not has_sidecar and not has_sidecar_gz")).alias("pending_ocr"), F.count_if(F.expr("has_cbz and not has_cover and not no_cover")).alias("pending_thumbnails"))
    return counts.crossJoin(F.broadcast(current)).withColumn("backend", F.lit(backend))  # one row each


def list_children(files: DataFrame, directory: str) -> DataFrame:
    """(name, kind) of what lies directly in a directory; the empty name is the root."""
    prefix = f"{directory.strip('/')}/" if directory.strip("/") else ""
    inner = files.where(F.col("rel_path").startswith(prefix)).select(F.substring("rel_path", len(prefix) + 1, 2**31 - 1).alias("rest"))
    return inner.select(F.substring_index("rest", "/", 1).alias("name"), F.when(F.col("rest").contains("/"), "directory").otherwise("file").alias("kind")).distinct()


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_contents(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, rel_path) of the volumes anywhere below each directory: an equi-join on the ancestors of each file."""
    volumes = files.where(F.lower("rel_path").endswith(layout.VOLUME))
    above = volumes.select("rel_path", F.explode(ancestors(F.col("rel_path"))).alias("directory"))
    return above.join(directories.select(paths.stripped(F.col("directory")).alias("directory")).distinct(), "directory").select("directory", "rel_path")


def preferred_sidecar(candidates: DataFrame) -> DataFrame:
    """Per volume_key the first valid of candidates(volume_key, path, is_root, valid): root ones only if there are any, compressed first, then by path."""
    fit = candidates.groupBy("volume_key").agg(
        F.bool_or("is_root").alias("rooted"),
        F.min(F.when(F.col("valid") & F.col("is_root"), F.struct((~F.col("path").endswith(".gz")).alias("plain"), "path"))).alias("at_root"),
        F.min(F.when(F.col("valid"), F.struct((~F.col("path").endswith(".gz")).alias("plain"), "path"))).alias("anywhere"),
    )
    best = F.when(F.col("rooted"), F.col("at_root")).otherwise(F.col("anywhere"))
    return fit.select("volume_key", best["path"].alias("path")).where(F.col("path").isNotNull())


def _numbered_of(names: DataFrame) -> DataFrame:
    """name, base and number of the names that are a base with a number before its suffix."""
    ending = r"_([1-9][0-9]{0,17})(\.[^.]+)?\z"
    parted = names.where(F.col("name").rlike(ending)).select("name", F.regexp_replace("name", ending, "$2").alias("base"), F.regexp_extract("name", ending, 1).cast("long").alias("number"))
    return parted.where(F.concat(paths.stem_of(F.col("base")), F.lit("_"), "number", paths.suffix_of(F.col("base"))) == F.col("name"))


def _family(name: Column) -> Column:
    """The same for a name and all that are numbered after it: without numbers before the suffix, or after a closing dot."""
    number = r"(_[1-9][0-9]{0,17})+\z"
    stem = F.regexp_replace(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*\z", "$1"), number, "")
    return F.concat(stem, F.regexp_replace(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1), rf"^\.{number}", "."))


#: Requests and existing names of a family that one task goes through in order.
FAMILY_ROWS = 100_000


def unique_names(incoming: DataFrame, existing: DataFrame, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """incoming(id, name) with ``stored_name``: the name where it is free, else the first free of stem_1, stem_2 and so on.

    Requests come in the order of id. Taken are existing(name) and the names given to earlier requests, made ones too.
    Existing names may repeat; ids must not. Null names stay null.

    Names that differ only in numbers before the suffix are a family, and no other name concerns it. Families of up to family_rows
    rows, and those of names with a closing dot (numbered in two ways: x_1._1 is after x_1. and after x._1), are dealt out, and a task goes through one after the other in the order of the requests: one shuffle, however the names hang on each
    other. Larger ones, such as one name for a third of all requests, are numbered by running totals over range blocks.
    """
    asked = incoming.select("id", "name").withColumn("family", _family(F.col("name")))
    held = existing.select("name").distinct().withColumn("family", _family(F.col("name"))).join(asked.select("family").distinct(), "family", "left_semi")
    both = stored(asked.select("family", "name", "id", F.lit(True).alias("asks")).unionByName(held.select("family", "name", F.lit(None).cast(incoming.schema["id"].dataType).alias("id"), F.lit(False).alias("asks"))), "names")
    large = both.groupBy("family").count().where((F.col("count") > family_rows) & ~F.col("family").endswith(".")).select("family")
    if large.isEmpty():
        return _named_in_order(both)
    large = stored(large, "names-large")
    near = both.join(large, "family", "left_anti")
    far = stored(both.join(large, "family", "left_semi"), "names-far")
    return _named_in_order(near).unionByName(_named_by_totals(far.where("asks").select("id", "name"), far.where("not asks").select("name")))


def _named_in_order(rows: DataFrame) -> DataFrame:
    """id, name, stored_name of rows(family, name, id, asks), family after family."""
    dealt = rows.repartition("family").sortWithinPartitions("family", "asks", "id").select("family", "name", "id", "asks")

    def run(batches):
        family, taken, following = None, set(), {}
        for batch in batches:
            made = []
            asks = batch.column(3)
            for of, name, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), asks.to_pylist(), strict=True):
                if of != family:
                    family, taken, following = of, set(), {}
                found = name
                if wants and name in taken:
                    parted = re.fullmatch(r"(?s)(.+)(\.[^.]+)", name)
                    stem, suffix = parted.groups() if parted else (name, "")
                    number = following.get(name, 1)
                    while (found := f"{stem}_{number}{suffix}") in taken:
                        number += 1
                    following[name] = number + 1
                if name is not None:
                    taken.add(found)
                if wants:
                    made.append(found)
            kept = batch.filter(asks)
            yield pa.RecordBatch.from_arrays([kept.column(2), kept.column(1), pa.array(made, pa.string())], names=["id", "name", "stored_name"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(dealt, run, f"id {kind}, name string, stored_name string")


def _named_by_totals(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The same by running totals, for families of any size.

    A numbered name goes to a request for its base or for itself. Requests for one base use up free numbers from below, so
    number k is skipped if it exists, or if it was asked for itself (``limit`` requests for the base came before) and the
    k - 1 - (skipped below) numbers used first are no fewer. Whether the first request for a base gets the base itself
    hangs on the base's own base in the same way. Both are found by rounds until nothing changes: one where no incoming
    name is numbered, else as many as claims hang on each other. Every round is joins and running totals.
    """
    asked = incoming.select("id", "name")
    first = stored(asked.groupBy("name").agg(F.min("id").alias("id")), "names-first")
    taken = stored(existing.select("name").distinct(), "names-taken")
    bases = first.select(F.col("name").alias("base"))
    open_ = _numbered_of(first.join(taken, "name", "left_anti")).join(bases, "base", "left_semi").join(first, "name")
    events = asked.select(F.col("name").alias("base"), "id", F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("name")).unionByName(open_.select("base", "id", "number", "name"))
    ranked = stored(running_total(events, ["base"], ["id"], F.when(F.col("number").isNull(), 1).otherwise(0), "names-events", "rank"), "names-ranked")
    closed = _numbered_of(taken).join(bases, "base", "left_semi").withColumn("limit", F.lit(0).cast("long"))
    numbered = closed.unionByName(ranked.where("number is not null").select("name", "base", "number", F.col("rank").alias("limit")))

    held = taken.select(F.col("name").alias("base")).join(bases, "base", "left_semi")
    state = stored(numbered.withColumn("skipped", F.col("limit") == 0), "names-state")
    while True:
        counted = running_total(state, ["base"], ["number"], F.col("skipped").cast("int"), "names-skipped", "upto")
        lost = held.unionAll(state.where("not skipped").select(F.col("name").alias("base"))).distinct().withColumn("lost", F.lit(1))
        before = F.col("number") - 1 - F.col("upto") + F.col("skipped").cast("int")
        tested = counted.join(lost, "base", "left").withColumns({"before": before, "now": before >= F.col("limit") - F.when(F.col("lost").isNull() & (F.col("limit") > 0), 1).otherwise(0)})
        state = stored(tested.select("name", "base", "number", "limit", F.col("now").alias("skipped"), "before", (F.col("now") != F.col("skipped")).alias("changed")), "names-state")
        if not state.where("changed").limit(1).count():
            break
        state = state.drop("before", "changed")

    requests = ranked.where("number is null").join(lost, "base", "left").select("base", "id", (F.col("rank") - F.when(F.col("lost").isNull(), 1).otherwise(0)).alias("place"))
    skips = state.where("skipped").select("base", F.lit(None).cast(incoming.schema["id"].dataType).alias("id"), F.col("before").alias("place"))
    both = requests.withColumn("skip", F.lit(0)).unionByName(skips.withColumn("skip", F.lit(1)))
    placed = running_total(both, ["base"], ["place", "skip"], F.col("skip"), "names-placed", "over").where("skip = 0")
    made = F.concat(paths.stem_of(F.col("base")), F.lit("_"), F.col("place") + F.col("over"), paths.suffix_of(F.col("base")))
    return placed.select("id", F.col("base").alias("name"), F.when(F.col("place") == 0, F.col("base")).otherwise(made).alias("stored_name"))


def first_seen(events: DataFrame) -> DataFrame:
    """The first event of each path by (ts, id)."""
    fields = [c for c in events.columns if c != "path"]
    return events.groupBy("path").agg(F.min_by(F.struct(*fields), F.struct("ts", "id")).alias("e")).select("path", "e.*")


def merged_listing(library: DataFrame, user_files: DataFrame, username: str | None) -> DataFrame:
    """(rank, name): the user's own files, then shared entries; without a user only shared ones. Order by (rank, name)."""
    shared = list_children(library, "").select(F.lit(1).alias("rank"), "name").distinct()
    if not username:
        return shared
    own = user_files.where((F.col("username") == username) & F.col("filename").isin(*layout.PER_USER_FILES)).select(F.lit(0).alias("rank"), F.col("filename").alias("name")).distinct()
    return own.unionByName(shared)


def inject_missing(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base and the rows of extra whose key base does not have; null keys are always added."""
    return base.unionByName(extra.join(base.select(key).distinct(), key, "left_anti").select(*base.columns))


def new_files(current: DataFrame, known: DataFrame) -> DataFrame:
    return current.join(known.select("rel_path").distinct(), "rel_path", "left_anti")


def exclude_inflight(queue: DataFrame, inflight: DataFrame, keys: list[str]) -> DataFrame:
    return queue.join(inflight.select(*keys).distinct(), keys, "left_anti")


def dedupe_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path, source): every path once, from the first list where it is in both."""
    both = first.select("path", F.lit(1).alias("source")).unionByName(second.select("path", F.lit(2).alias("source")))
    return both.groupBy("path").agg(F.min("source").alias("source"))


def export_catalog(volumes: DataFrame) -> DataFrame:
    """(series, page, document): each series as JSON with nested volumes, one document a page of series_rollup; a null cover is left out."""
    return series_rollup(volumes).select("series", "page", F.to_json(F.struct(F.col("series").alias("name"), "cover", F.transform("volumes", lambda v: F.struct(v["name"].alias("name"), v["cover"].alias("cover"))).alias("volumes"))).alias("document"))


def search(rows: DataFrame, column: str, query: str) -> DataFrame:
    return rows.where(scalars.matches(F.col(column), query))
