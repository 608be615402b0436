"""URL filters by a temporal list join.

A list is a log of dated entries (add or remove a domain or a URL prefix).
Entries become validity intervals; each capture is evaluated against the entries
that were active when it was fetched, by an as-of join on (key, time bucket).

Every host suffix and every path prefix of a capture is a key, so matching is an
equi-join, never a scan of the list. Keys are hashed in one pass over a URL, and
compared as text where hashes met. Those that the list does not have are left out
before anything is shuffled, by a bitmap. Time buckets bound how many intervals of a key a
capture meets, and spread a hot host; a closed interval is covered by buckets of several
levels, so it has few rows however long it is, and an open one has a single row. Spark
broadcasts the intervals only when they are measured small, else it joins by shuffle and
splits skewed keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.shared import flagged, numbered, stored, table
from shelfspark.shipping import map_arrow

#: Seconds of a fine bucket, buckets in one of the next level, and levels; all seconds of a long fit.
BUCKET_S, BASE, LEVELS = 8 * 86400, 16, 12
#: Of Spark's xxhash64.
SEED = 42


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot, an IPv6 address with its brackets; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, without slashes at its ends."""
    return F.trim(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))


def _hashes(host: str, path: str) -> Iterator[int]:
    """Hashes of the keys of a URL: ``d:`` and each host suffix, ``p:`` and the host with each path prefix, in time linear in the path."""
    whole = host.encode()
    labels = [0] if host.startswith("[") else [0, *(i + 1 for i, c in enumerate(whole) if c == 46)]
    for at in labels:
        yield xxhash.xxh64_intdigest(b"d:" + whole[at:], SEED)
    if path:
        prefix = xxhash.xxh64(b"p:" + whole, SEED)
        for segment in re.split("/+", path):
            prefix.update(b"/" + segment.encode())
            yield prefix.intdigest()


def key_hashes(rows: DataFrame) -> DataFrame:
    """(__row, fetched, hash) for each key of rows(__row, url, fetched); hash is what xxhash64 makes of the key. No host, no keys."""

    def run(batches):
        def made(held):
            rows, times, hashes = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(times, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["__row", "fetched", "hash"])

        held: list[tuple] = []
        for batch in batches:
            for row, at, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for h in _hashes(host, path):
                    held.append((row, at, h))
                    if len(held) >= 20_000:
                        yield made(held)
                        held = []
        if held:
            yield made(held)

    parted = rows.select("__row", F.col("fetched").cast("long").alias("fetched"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null and fetched is not null")
    return map_arrow(parted, run, "__row long, fetched long, hash long")


def matches(key: Column, host: Column, path: Column) -> Column:
    """Whether a key is one of the URL's: a hash may be that of another key too."""
    domain = F.substring(key, 3, 2**31 - 1)
    own = F.concat(F.lit("p:"), host, F.lit("/"), F.regexp_replace(path, "/+", "/"), F.lit("/"))
    is_domain = (host == domain) | (~F.startswith(host, F.lit("[")) & F.endswith(host, F.concat(F.lit("."), domain)))
    return F.when(F.startswith(key, F.lit("d:")), is_domain).otherwise((path != "") & F.startswith(own, F.concat(key, F.lit("/"))))


def entry_key(key: Column) -> Column:
    """The key of a list entry as ``list_keys`` writes it: in a prefix, runs of slashes are one and none is at its end."""
    return F.when(F.startswith(key, F.lit("p:")), F.regexp_replace(F.regexp_replace(key, "/+", "/"), r"/\z", "")).otherwise(key)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, key, valid_from, valid_to) from (list_name, key, action, effective): active from an add until the next entry.

    Times are epoch seconds; an open end is null. Of entries with one time, a remove wins. Rows with a null key,
    list, time or another action are ignored; repeated rows count once. Keys come out as ``list_keys`` writes them.
    """
    clean = entries.where(F.col("action").isin("add", "remove") & F.col("key").isNotNull() & F.col("list_name").isNotNull() & F.col("effective").isNotNull()).withColumn("key", entry_key(F.col("key")))
    one = clean.groupBy("list_name", "key", "effective").agg(F.max("action").alias("action"))
    after = F.lead("effective").over(Window.partitionBy("list_name", "key").orderBy("effective"))
    return one.select("list_name", "key", "action", F.col("effective").alias("valid_from"), after.alias("valid_to")).where(F.col("action") == "add").drop("action")


def cover(first: Column, last: Column) -> Column:
    """(level, bucket) whose spans, BASE**level fine buckets each, are together the fine buckets first to last, each of them once.

    However long the interval is, there are fewer than 2 * BASE a level, and LEVELS levels hold every span of a long.
    """
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    some = lambda a, b, level: F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda x: F.struct(level.alias("level"), x.alias("bucket")))).otherwise(none)

    def climb(acc: Column, level: Column) -> Column:
        a, b, out = acc["a"], acc["b"], acc["out"]
        low, high = F.ceil(a / BASE), F.floor((b + 1) / BASE) - 1  # of the next level
        here = (low > high) | (level == LEVELS - 1)
        ends = F.when(here, some(a, b, level)).otherwise(F.concat(some(a, low * BASE - 1, level), some((high + 1) * BASE, b, level)))
        return F.struct(F.when(here, F.lit(1)).otherwise(low).cast("long").alias("a"), F.when(here, F.lit(0)).otherwise(high).cast("long").alias("b"), F.concat(out, ends).alias("out"))

    start = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), none.alias("out"))
    return F.aggregate(F.array(*[F.lit(n) for n in range(LEVELS)]), start, climb)["out"]


def _spans(entries: DataFrame) -> DataFrame:
    """list_name, key, hash, valid_from, valid_to, level, bucket: the cover of a closed interval; an open one is a single row of level -1."""
    bucket = lambda c: F.floor(c / BUCKET_S)
    at = F.when(F.col("valid_to").isNull(), F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bucket")))).otherwise(cover(bucket(F.col("valid_from")), bucket(F.col("valid_to") - 1)))
    return validity_intervals(entries).withColumn("hash", F.xxhash64("key")).select("list_name", "key", "hash", "valid_from", "valid_to", F.explode(at).alias("at")).select("list_name", "key", "hash", "valid_from", "valid_to", "at.*")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(capture_id, url, fetched) with host, blocked, n_rules and rules (list/key of the active matches, sorted, comma-joined).

    One row per row of captures, which is judged by itself; ids may repeat or be null. Null or malformed URLs and null times match
    nothing. Empty lists block nothing. Columns of captures keep their names. URLs of any length and times of any size are taken whole;
    at one instant a remove wins over an add.
    """
    rows = numbered(captures.select("capture_id", "url", "fetched"), "url-captures")
    spans = stored(_spans(entries), "url-spans")
    levels = [r["level"] for r in spans.select("level").distinct().collect()]  # LEVELS + 1 at most
    bucket = F.floor(F.col("fetched") / BUCKET_S)
    at = F.array(*[F.struct(F.lit(n).alias("level"), (F.lit(0) if n < 0 else F.floor(bucket / float(BASE**n))).cast("long").alias("bucket")) for n in levels]).cast("array<struct<level:int,bucket:bigint>>")
    named = flagged(key_hashes(rows), "hash", spans, "hash", "__may").where("__may").select("__row", "fetched", "hash", F.explode(at).alias("at")).select("__row", "fetched", "hash", "at.*")
    hits = named.join(spans, ["hash", "level", "bucket"]).where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    found = stored(hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("list_name", "key"))).alias("found")), "url-hits")
    near = flagged(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), "__row", found, "__row", "__may")
    none = F.array().cast(found.schema["found"].dataType)
    judged = near.where("not __may").withColumn("found", none).unionByName(near.where("__may").join(found, "__row", "left").withColumn("found", F.coalesce("found", none)))
    true = F.filter("found", lambda f: matches(f["key"], F.col("host"), F.col("path")))
    rules = judged.select("capture_id", "url", "fetched", "host", F.array_sort(F.transform(true, lambda f: F.concat_ws("/", f["list_name"], f["key"]))).alias("rules"))
    return rules.select("capture_id", "url", "fetched", "host", (F.size("rules") > 0).alias("blocked"), F.size("rules").cast("long").alias("n_rules"), F.array_join("rules", ",").alias("rules"))


EPOCH, MONTH_S = 1704067200, 2592000


def captures_of(pages: DataFrame) -> DataFrame:
    """pages as captures, fetched at a time of January 2024 that the page_id gives."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", (F.lit(EPOCH) + F.pmod(F.col("page_id") * 7919, F.lit(MONTH_S))).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, sections and paths of pages: value hashes give the dates, even entries add, odd ones remove."""
    at = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where(F.col("host").isNotNull())
    values = at.select(F.explode(F.array(
        F.struct(F.lit("hosts").alias("list_name"), F.concat(F.lit("d:"), "host").alias("key"), F.lit(6).alias("n")),
        F.struct(F.lit("sections").alias("list_name"), F.concat(F.lit("p:"), "host", F.lit("/"), F.substring_index("path", "/", 1)).alias("key"), F.lit(4).alias("n")),
        F.struct(F.lit("paths").alias("list_name"), F.concat(F.lit("p:"), "host", F.lit("/"), "path").alias("key"), F.lit(2).alias("n")),
    )).alias("v")).select("v.*").distinct()
    dated = values.select("list_name", "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    effective = F.lit(EPOCH) + F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "list_name", "key", F.col("i").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(MONTH_S))
    return dated.select("list_name", "key", F.when(F.col("i") % 2 == 0, "add").otherwise("remove").alias("action"), effective.alias("effective"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures_of(pages), entries_of(pages)).withColumnRenamed("capture_id", "page_id")


ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 2592000 AS fetched,
    nullif(rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[]+)', 1), '.'), '') AS host,
    trim(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path
  FROM pages
), v AS (
  SELECT DISTINCT list_name, key, n FROM (
    SELECT 'hosts' AS list_name, 'd:' || host AS key, 6 AS n FROM c WHERE host IS NOT NULL
    UNION ALL SELECT 'sections', 'p:' || host || '/' || split_part(path, '/', 1), 4 FROM c WHERE host IS NOT NULL
    UNION ALL SELECT 'paths', 'p:' || host || '/' || path, 2 FROM c WHERE host IS NOT NULL)
), e AS (
  SELECT list_name, key, effective, max(action) AS action FROM (
    SELECT list_name, key, CASE WHEN i % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
      1704067200 + CAST('0x' || substr(md5(list_name || ':' || key || ':' || i), 1, 8) AS BIGINT) % 2592000 AS effective
    FROM v, range(6) r(i) WHERE i < n) GROUP BY ALL
), s AS (
  SELECT * FROM (SELECT list_name, key, action, effective AS valid_from, lead(effective) OVER (PARTITION BY list_name, key ORDER BY effective) AS valid_to FROM e) WHERE action = 'add'
), k AS (
  SELECT page_id, fetched, 'd:' || array_to_string(l[i + 1 :], '.') AS key FROM (SELECT *, CASE WHEN host LIKE '[%' THEN [host] ELSE string_split(host, '.') END AS l FROM c), LATERAL (SELECT unnest(range(len(l))) AS i)
  UNION SELECT page_id, fetched, 'p:' || host || '/' || array_to_string(l[1 : i + 1], '/') FROM (SELECT *, regexp_split_to_array(path, '/+') AS l FROM c WHERE path <> '' AND host IS NOT NULL), LATERAL (SELECT unnest(range(len(l))) AS i)
), h AS (
  SELECT page_id, string_agg(list_name || '/' || key, ',' ORDER BY list_name || '/' || key) AS rules, count(*) AS n_rules
  FROM k JOIN s USING (key) WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id
)
SELECT page_id, url, fetched, host, rules IS NOT NULL AS blocked, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules
FROM c LEFT JOIN h USING (page_id)
"""
