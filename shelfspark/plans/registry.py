"""Registered queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import layout, schemas
from shelfspark.functions import paths, scalars
from shelfspark.operators import access, accounts, audit, library, ownership, progress
from shelfspark.operators.running import running_total
from shelfspark.plans.bindings import NOW_EVENTS, NOW_INVITES, Tables, with_relations
from shelfspark.shared import shared_path, stored
from shelfspark.sources import files, records, tree
from shelfspark.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def now_i():
    return F.expr(NOW_INVITES)


def now_e():
    return F.expr(NOW_EVENTS)


SQL_NOW_I, SQL_NOW_E = NOW_INVITES.replace("_NTZ", ""), NOW_EVENTS.replace("_NTZ", "")


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None):
    """Registers build(tables) under a name; with sql, what DuckDB must return."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_relations(needs, sql)
        return build

    return add


def _volumes(t: Tables) -> DataFrame:
    return library.attach_sidecars(t.files())


# --- sources ---------------------------------------------------------------------

query("s2_manifest", ("files",), "SELECT rel_path, size, mtime FROM files")(lambda t: t.files())


@query("s4_existing", ("files",), "SELECT * FROM files WHERE mtime % 3 <> 0")
def _(t):
    return files.scan_existing(t.files(), t.files().where("mtime % 3 = 0"))


query("s7_users", ("users",), "SELECT * FROM users")(lambda t: t.users())

# files that tasks write from the tables, read back

@query("s1_scan_files", ("user_tree",), "SELECT username || '/' || filename AS rel_path, size, true AS fresh FROM user_tree")
def _(t):
    begun = int(time.time())
    found = files.scan_files(t.spark, t.user_tree())
    return found.select("rel_path", "size", F.col("mtime").between(begun - 1, int(time.time()) + 1).alias("fresh"))


_WATCHED = """SELECT 'user_' || s_suppkey || '/' || path AS path, kind FROM supplier, (VALUES ('volume-data.json', 'modified', 5), ('sub/_new.cbz', 'created', 7), ('renamed.json', 'moved', 6), ('profiles.json', 'deleted', 8)) e(path, kind, m) WHERE s_suppkey % m = 0"""


@query("s3_watch_tree", (), _WATCHED)
def _(t):
    root, home, out = t.user_tree(), shared_path(t.spark, "watched"), shared_path(t.spark, "watched-events")
    tree.poll_tree(t.spark, root, home)
    t.change_user_tree(root)
    tree.poll_tree(t.spark, root, home)
    files.stream_files(t.spark, f"{home}/events").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(t.spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schemas.FILE_EVENTS).parquet(out).select("path", "kind")


query("s5_sidecars", ("sidecar_tree",), "SELECT rel_path, CASE WHEN block % 3 <> 2 THEN json END AS json, block % 3 <> 2 AS bytes_ok FROM sidecar_tree")(lambda t: files.read_sidecars(t.spark, t.sidecar_tree()))
query("s6_archive_members", ("archive_tree",), "SELECT rel_path, doc_id || '.txt' AS member FROM archive_tree WHERE block % 5 <> 4 UNION ALL SELECT DISTINCT rel_path, 'info.txt' FROM archive_tree WHERE block % 5 <> 4")(lambda t: files.read_archive_members(t.spark, t.archive_tree()))
query("s8_user_files", ("user_tree",), "SELECT * FROM user_tree WHERE filename IN ('profiles.json', 'volume-data.json')")(lambda t: files.scan_user_files(t.spark, t.user_tree()).drop("mtime"))
query("f30_valid_archives", ("archive_tree",), "SELECT DISTINCT rel_path, block % 5 <> 4 AND block % 7 <> 6 AS valid FROM archive_tree")(lambda t: files.valid_archives(t.spark, t.archive_tree()))


@query("s3_stream_files", ("file_events",), "SELECT path, kind, ts FROM file_events")
def _(t):
    came, out = shared_path(t.spark, "file-events"), shared_path(t.spark, "file-events-seen")
    t.file_events().select("path", "kind", F.col("ts").cast("timestamp").alias("ts")).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(came)
    stream = files.stream_files(t.spark, came)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(t.spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schemas.FILE_EVENTS).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s11_audit", ("audit",), "SELECT *, strftime(created_at, '%Y-%m-%d') AS dt FROM audit")
def _(t):
    path = shared_path(t.spark, "audit")
    records.write_audit(t.audit(), path)
    return t.spark.read.parquet(path).withColumn("dt", F.col("dt").cast("string"))


def _streamed(t: Tables, df: DataFrame, name: str, batches: int = 1) -> DataFrame:
    """The rows of df as a stream of the files of a table, in so many batches; rows of any time may come in any of them."""
    if batches == 1:
        return t.spark.readStream.schema(df.schema).parquet(stored(df, name).stored_at)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(stored(df.repartition(batches), name).stored_at)


@query("t6_audit_stream", ("audit",), "SELECT * FROM audit WHERE CAST(created_at AS DATE) >= DATE '2024-01-11'")
def _(t):
    path, clock = shared_path(t.spark, "audit"), lambda: dt.datetime(2024, 1, 25, 12, tzinfo=dt.UTC)
    records.stream_audit(_streamed(t, t.audit(), "audit-events", 3), path, shared_path(t.spark, "offsets"), keep_days=14, clock=clock).awaitTermination()
    return records.read_audit(t.spark, path, t.audit().schema)


@query("s13_write_progress", ("progress",), "SELECT job, true AS active, CAST(max(done) AS DOUBLE) AS updated_at, max(total) AS total FROM progress GROUP BY job HAVING max(done) < max(total)")
def _(t):
    path, states = shared_path(t.spark, "running"), t.progress().select("job", F.expr("done < total").alias("active"), F.col("done").cast("double").alias("updated_at"), "total")
    records.write_progress(_streamed(t, states, "states", 4), path, shared_path(t.spark, "offsets")).awaitTermination()
    return records.read_snapshot(t.spark, path, states.schema)


@query("t7_latest_progress", ("progress",), "SELECT job, true AS active, CAST(max(done) AS DOUBLE) AS updated_at, CAST(max(done) AS DOUBLE) AS ts, max(total) AS total FROM progress GROUP BY job")
def _(t):
    path, at = shared_path(t.spark, "latest"), F.col("done").cast("double")
    updates = t.progress().select("job", F.lit(True).alias("active"), at.alias("updated_at"), at.alias("ts"), "total")
    latest = streams.latest_progress_stream(_streamed(t, updates, "updates"))
    records.write_progress(latest, path, shared_path(t.spark, "offsets"), mode="update").awaitTermination()
    return records.read_snapshot(t.spark, path, latest.schema)


@query("s9_progress", ("jobs",), "SELECT job, relative_cbz, percent, done_pages, total_pages, 'running' AS status, updated_at FROM jobs WHERE active AND NOT broken")
def _(t):
    return records.read_progress(t.jobs()).select("job", "relative_cbz", "percent", "done_pages", "total_pages", "status", "updated_at")


@query("s10_request_log", ("logged",), "SELECT thread, method, path, code, elapsed_ms / 1000.0 AS elapsed, exception, message FROM logged")
def _(t):
    return records.parse_request_log(records.format_request_log(t.logged()))


_PAGES = f"(SELECT *, (row_number() OVER (PARTITION BY series ORDER BY name) - 1) // {library.PAGE_VOLUMES} AS page, arg_min(cover, name) FILTER (cover IS NOT NULL) OVER (PARTITION BY series) AS front FROM volumes)"


@query("s12_export_catalog", ("volumes",), f"""SELECT series, page, '{{"name":"' || series || '",' || coalesce('"cover":"' || min(front) || '",', '') || '"volumes":[' || string_agg('{{"name":"' || name || '"' || coalesce(',"cover":"' || cover || '"', '') || '}}', ',' ORDER BY name) || ']}}' AS document FROM {_PAGES} GROUP BY series, page""")
def _(t):
    return library.export_catalog(_volumes(t))


# --- projections and predicates -----------------------------------------------------

query("f1_drop_hidden", ("visible",), "SELECT rel_path, size, mtime FROM visible")(lambda t: library.drop_hidden(t.files()))


@query("f2_relevant_changes", ("changed_paths",), r"SELECT id, path, dest_path FROM changed_paths WHERE is_directory OR regexp_matches(lower(path), '[.](cbz|ocr|gz|webp)$') OR regexp_matches(lower(coalesce(dest_path, '')), '[.](cbz|ocr|gz|webp)$')")
def _(t):
    return library.relevant_changes(t.changed_paths()).select("id", "path", "dest_path")


@query("f3_processable", ("files",), "SELECT rel_path AS path, 'file' AS kind FROM files WHERE ends_with(rel_path, '.cbz') UNION ALL SELECT DISTINCT regexp_extract(rel_path, '^(.*)/[^/]*$', 1), 'directory' FROM files WHERE ends_with(rel_path, '.webp')")
def _(t):
    return library.processable(t.files())


@query("f4_volume_key", ("files",), "SELECT rel_path, regexp_replace(rel_path, '(\\.ocr\\.gz|\\.ocr|\\.webp|\\.nocover)$', '.cbz') AS volume_key FROM files")
def _(t):
    return t.files().select("rel_path", paths.volume_key(F.col("rel_path")).alias("volume_key"))


@query("f5_split_volume", ("files",), "SELECT regexp_extract(rel_path, '^(.*)/', 1) AS series, left(regexp_extract(rel_path, '[^/]*$'), -4) AS volume FROM files WHERE ends_with(rel_path, '.cbz')")
def _(t):
    split = t.files().select(paths.series_of(F.col("rel_path")).alias("series"), paths.volume_of(F.col("rel_path")).alias("volume"))
    return split.where("volume is not null")


@query("f6_series_title", ("files",), "SELECT rel_path, split_part(rel_path, '/', 2) AS title FROM files")
def _(t):
    return t.files().select("rel_path", paths.series_title(F.col("rel_path")).alias("title"))


query("f7_needs_sidecar", ("waiting",), "SELECT series, name FROM waiting")(lambda t: library.needs_sidecar(_volumes(t)).select("series", "name"))
query("f8_needs_thumbnail", ("volumes",), "SELECT series, name FROM volumes WHERE has_cbz AND NOT has_cover AND NOT no_cover")(lambda t: library.needs_thumbnail(_volumes(t)).select("series", "name"))

_TYPE = "CASE WHEN path = '/reader' THEN 'reader_root' WHEN path IN ('/reader/volume-data.json', '/reader/profiles.json') THEN 'progress' WHEN starts_with(path, '/reader/') THEN 'library' WHEN path = '/inbox' OR starts_with(path, '/inbox/') THEN 'inbox' ELSE 'unknown' END"


@query("f9_path_type", ("requests",), f"SELECT request_id, {_TYPE} AS path_type FROM requests")
def _(t):
    return t.requests().select("request_id", paths.path_type(F.col("path")).alias("path_type"))


@query("f10_to_physical", ("requests",), f"SELECT request_id, CASE {_TYPE} WHEN 'progress' THEN 'users/' || username || substr(path, 8) WHEN 'library' THEN 'library' || substr(path, 8) WHEN 'inbox' THEN substr(path, 2) END AS physical FROM requests")
def _(t):
    return t.requests().select("request_id", paths.to_physical(F.col("path"), F.col("username")).alias("physical"))


@query("f11_to_virtual", ("requests",), f"SELECT request_id, CASE WHEN {_TYPE} IN ('progress', 'library', 'inbox') AND NOT ({_TYPE} = 'progress' AND username IS NULL) THEN path END AS virtual FROM requests")
def _(t):
    return t.requests().select("request_id", paths.to_virtual(paths.to_physical(F.col("path"), F.col("username"))).alias("virtual"))


@query("f12_is_contained", ("files",), "SELECT p, list_min(list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: CASE x WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END)))) >= 0 AS contained FROM (SELECT p, string_split(p, '/') AS s FROM (SELECT CASE size % 4 WHEN 0 THEN rel_path WHEN 1 THEN '../' || rel_path WHEN 2 THEN 'a/.././' || rel_path ELSE 'a/../../' || rel_path END AS p FROM files))")
def _(t):
    p = F.expr("case size % 4 when 0 then rel_path when 1 then '../' || rel_path when 2 then 'a/.././' || rel_path else 'a/../../' || rel_path end")
    return t.files().select(p.alias("p")).select("p", paths.is_contained(F.col("p")).alias("contained"))


@query("f13_routes", ("requests",), f"SELECT request_id, {_TYPE} = 'progress' AS progress, {_TYPE} = 'library' AS library, starts_with(path, '/inbox/') AS inbox, starts_with(path, '/_admin') AS admin, path = '/_admin/api/invites' AS invite_api FROM requests")
def _(t):
    p = F.col("path")
    return t.requests().select("request_id", paths.is_progress_file(p).alias("progress"), paths.is_library_path(p).alias("library"), paths.is_inbox_path(p).alias("inbox"), paths.is_admin_path(p).alias("admin"), paths.is_invite_api_path(p).alias("invite_api"))


#: Headers as both engines write them; what they mean is worked out by each alone.
_ACCEPT = "CASE WHEN request_id % 7 = 0 THEN NULL WHEN request_id % 5 = 0 THEN 'application/xml, text/html;q=0.' || request_id WHEN request_id % 3 = 0 THEN 'TEXT/HTML' ELSE path END"
_AGENT = "CASE request_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Mozilla/5.0 (' || path || ')' WHEN 2 THEN 'DAVFS2/1.' || request_id WHEN 3 THEN path || ' WebDAVFS/3' WHEN 4 THEN 'Curl/' || request_id WHEN 5 THEN 'da vfs ' || request_id WHEN 6 THEN 'my Cadaver/' || request_id ELSE '' END"


@query("f14_is_browser", ("requests",), f"SELECT request_id, coalesce(contains(accept, 'text/html'), false) OR len(list_filter({list(layout.DAV_CLIENTS)!r}, lambda c: coalesce(contains(lower(agent), c), false))) = 0 AS browser FROM (SELECT request_id, {_ACCEPT} AS accept, {_AGENT} AS agent FROM requests)")
def _(t):
    return t.requests().select("request_id", paths.is_browser(F.expr(_ACCEPT), F.expr(_AGENT)).alias("browser"))


query("f15_user_by_name", ("users",), "SELECT id, role FROM users WHERE username = 'user_7'")(lambda t: accounts.user_by_name(t.users(), "user_7").select("id", "role"))
query("f16_list_users", ("users",), "SELECT id, username, CASE role WHEN 'writer' THEN 'uploader' ELSE role END AS role, status, notes, created_at FROM users WHERE status = 'pending'")(lambda t: accounts.list_users(t.users(), "pending"))
query("f17_can_log_in", ("users",), "SELECT id FROM users WHERE status = 'active'")(lambda t: accounts.can_log_in(t.users()).select("id"))


@query("f18_validation", ("registrations",), "SELECT request_id, CASE WHEN NOT regexp_full_match(username, '[a-zA-Z0-9_-]{3,32}') THEN 'Username must be 3-32 characters and contain only letters, numbers, underscores, and hyphens' END AS username_error, CASE WHEN password_length = 0 THEN 'Password is required' WHEN password_length < 8 THEN 'Password must be at least 8 characters' WHEN password_length > 128 THEN 'Password must be at most 128 characters' END AS password_error FROM registrations")
def _(t):
    return t.registrations().select("request_id", scalars.username_error(F.col("username")).alias("username_error"), scalars.password_error(F.expr("repeat('p', password_length)")).alias("password_error"))


query("f19_normalize_role", ("users",), "SELECT id, CASE role WHEN 'writer' THEN 'uploader' ELSE role END AS role FROM users")(lambda t: t.users().select("id", scalars.normalize_role(F.col("role")).alias("role")))
query("f20_invite_status", ("invites",), f"SELECT id, CASE WHEN used_by IS NOT NULL THEN 'used' WHEN {SQL_NOW_I} > expires_at THEN 'expired' ELSE 'valid' END AS status FROM invites")(lambda t: t.invites().select("id", accounts.invite_status(now_i()).alias("status")))
query("f21_active_invites", ("invites",), f"SELECT id, code FROM invites WHERE used_by IS NULL AND expires_at > {SQL_NOW_I}")(lambda t: accounts.active_invites(t.invites(), now_i()).select("id", "code"))
query("f22_validate_invites", ("invites", "registrations"), f"SELECT id, code FROM invites WHERE code IN (SELECT invite_code FROM registrations) AND used_by IS NULL AND expires_at >= {SQL_NOW_I}")(lambda t: accounts.validate_invites(t.invites(), t.registrations().select(F.col("invite_code").alias("code")), now_i()).select("id", "code"))


@query("f23_auth_header", ("requests",), "SELECT request_id, CASE WHEN header IS NULL OR NOT starts_with(header, 'Basic ') THEN 'anonymous' WHEN contains(coalesce(text, ''), ':') THEN 'basic' ELSE 'malformed' END AS state, CASE WHEN starts_with(header, 'Basic ') AND contains(text, ':') THEN split_part(text, ':', 1) END AS username FROM (SELECT *, try(decode(from_base64(substr(header, 7)))) AS text FROM (SELECT request_id, CASE request_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Bearer ' || to_base64(encode(path || ':pw')) WHEN 2 THEN 'Basic ' || to_base64(encode(path || ':pw:' || request_id)) WHEN 3 THEN 'Basic ' || to_base64(encode(path)) WHEN 4 THEN 'Basic ' || to_base64(unhex('FF') || encode(':' || path)) WHEN 5 THEN 'basic ' || to_base64(encode(path || ':pw')) ELSE 'Basic ' || to_base64(encode(':é' || path)) END AS header FROM requests))")
def _(t):
    encoded = lambda text: f"base64(encode({text}, 'UTF-8'))"
    header = F.expr(f"case request_id % 7 when 0 then null when 1 then 'Bearer ' || {encoded("path || ':pw'")} when 2 then 'Basic ' || {encoded("path || ':pw:' || request_id")} when 3 then 'Basic ' || {encoded("path")} when 4 then 'Basic ' || base64(unhex('FF') || encode(':' || path, 'UTF-8')) when 5 then 'basic ' || {encoded("path || ':pw'")} else 'Basic ' || {encoded("':é' || path")} end")
    return access.auth_states(t.requests().select("request_id", F.regexp_replace(header, r"\r\n", "").alias("header")), "header")


_FORWARDED = "CASE request_id % 5 WHEN 0 THEN ' 10.0.0.' || request_id || ' , 10.9.9.9' WHEN 1 THEN '' WHEN 2 THEN ' ,10.8.' || request_id WHEN 3 THEN NULL ELSE '10.7.' || request_id END"
_REAL = "CASE request_id % 3 WHEN 0 THEN ' 10.1.' || request_id || ' ' WHEN 1 THEN '  ' END"


@query("f24_client_ip", ("requests",), "SELECT request_id, CASE WHEN trim(coalesce(regexp_extract(forwarded, '^[^,]*'), '')) <> '' THEN trim(regexp_extract(forwarded, '^[^,]*')) WHEN trim(coalesce(real_ip, '')) <> '' THEN trim(real_ip) ELSE '127.0.0.1' END AS ip FROM (SELECT request_id, " + f"{_FORWARDED} AS forwarded, {_REAL} AS real_ip FROM requests)")
def _(t):
    return t.requests().select("request_id", paths.client_ip(F.expr(_FORWARDED), F.expr(_REAL), F.lit("127.0.0.1")).alias("ip"))


_IP = "CASE request_id % 6 WHEN 0 THEN '::' || request_id % 4 WHEN 1 THEN '0:0:0:0:0:0:0:' || request_id % 4 WHEN 2 THEN '0:' || request_id % 2 || '::0' || request_id % 3 WHEN 3 THEN 'localhost' ELSE '12' || (request_id % 2 + 7) || '.' || request_id % 300 || '.' || request_id * 7 % 290 || '.0' || request_id * 13 % 270 END"
_IPS = [_IP, _IP.replace("'.0'", "'.'")]


@query("f25_is_loopback", ("requests",), "SELECT request_id, ip, CASE WHEN contains(ip, ':') THEN regexp_full_match(ip, '[0:]*1') AND (len(string_split(ip, ':')) = 8 AND NOT contains(ip, '::') OR len(string_split(ip, '::')) = 2) ELSE len(o) = 4 AND o[1] = '127' AND len(list_filter(o, lambda x: regexp_full_match(x, '0|[1-9][0-9]{0,2}') AND coalesce(TRY_CAST(x AS INTEGER) <= 255, false))) = 4 END AS loopback FROM (SELECT request_id, ip, string_split(ip, '.') AS o FROM (" + " UNION ALL ".join(f"SELECT request_id, {ip} AS ip FROM requests" for ip in _IPS) + "))")
def _(t):
    ips = t.requests().select("request_id", F.explode(F.array(*[F.expr(ip) for ip in _IPS])).alias("ip"))
    return ips.withColumn("loopback", paths.is_loopback(F.col("ip")))


query("f26_search", ("volumes",), "SELECT series, name FROM volumes WHERE contains(lower(series), 'src1')")(lambda t: library.search(_volumes(t), "series", " SRC1 ").select("series", "name"))
query("f27_series_detail", ("volumes",), "SELECT series, arg_min(cover, name) FILTER (cover IS NOT NULL) AS cover, count(*) AS volumes FROM volumes WHERE series = 'en/src1' GROUP BY series")(lambda t: library.series_detail(_volumes(t), "en/src1").groupBy("series", "cover").agg(F.sum(F.size("volumes")).alias("volumes")))
query("f28_freshness", ("files",), "SELECT rel_path, CASE WHEN mtime % 100000 < 120 THEN 'fresh' WHEN mtime % 100000 < 86400 THEN 'stale' ELSE 'expired' END AS state FROM files")(lambda t: t.files().select("rel_path", scalars.freshness(F.expr("mtime % 100000")).alias("state")))
query("f29_valid_sidecar", ("sidecars",), "SELECT rel_path, json_valid(json) AS valid FROM sidecars")(lambda t: t.sidecars().select("rel_path", library.valid_sidecar(F.col("json")).alias("valid")))

# --- joins -----------------------------------------------------------------------------

query("j1_attach_sidecars", ("volumes",), "SELECT * FROM volumes")(lambda t: _volumes(t))
query("j2_orphan_sidecars", ("files",), "SELECT rel_path, regexp_replace(rel_path, '(\\.ocr\\.gz|\\.ocr|\\.webp|\\.nocover)$', '.cbz') AS volume_key FROM files WHERE NOT ends_with(rel_path, '.cbz') AND regexp_replace(rel_path, '(\\.ocr\\.gz|\\.ocr|\\.webp|\\.nocover)$', '.cbz') NOT IN (SELECT rel_path FROM files WHERE ends_with(rel_path, '.cbz'))")(lambda t: library.orphan_sidecars(t.files()))
query("j3_corrupt_sidecars", ("sidecars",), "SELECT rel_path FROM sidecars WHERE NOT json_valid(json)")(lambda t: library.corrupt_sidecars(t.sidecars(), library.valid_sidecar(F.col("json"))).select("rel_path"))


@query("j4_volume_owner", ("files", "uploads"), "SELECT f.rel_path, u.uploader_username AS owner FROM files f LEFT JOIN uploads u ON u.volume_key = regexp_replace(f.rel_path, '(\\.ocr\\.gz|\\.ocr|\\.webp|\\.nocover)$', '.cbz')")
def _(t):
    return ownership.volume_owner(t.files().select("rel_path"), t.uploads(), "rel_path")


@query("j5_can_delete", ("requests", "uploads"), f"SELECT request_id, coalesce({_TYPE} = 'library' AND uploader_username = username, false) AS may_delete FROM requests LEFT JOIN uploads ON volume_key = substr(path, 9)")
def _(t):
    return ownership.can_delete(t.requests(), t.uploads()).select("request_id", "may_delete")


_LATEST_JOB = "SELECT lower(relative_cbz) AS key, max(updated_at) AS updated_at FROM jobs WHERE active AND NOT broken GROUP BY 1"


@query("j6_overlay_progress", ("volumes", "jobs"), f"SELECT series, name, k.key IS NOT NULL AS active, has_cbz AND NOT has_sidecar AND NOT has_sidecar_gz AND k.key IS NULL AS pending, j.percent FROM volumes v LEFT JOIN ({_LATEST_JOB}) k ON k.key = lower(series || '/' || name || '.cbz') LEFT JOIN jobs j ON lower(j.relative_cbz) = k.key AND j.updated_at = k.updated_at")
def _(t):
    return library.overlay_progress(_volumes(t), records.read_progress(t.jobs())).select("series", "name", "active", "pending", F.col("progress.percent").alias("percent"))


_GRANTS = "(VALUES ('anonymous', ['read']), ('registered', ['read','write_progress']), ('uploader', ['read','write_progress','add_files']), ('inviter', ['read','write_progress','add_files','modify_delete','manage_invites']), ('editor', ['read','write_progress','add_files','modify_delete']), ('admin', ['read','write_progress','add_files','modify_delete','manage_invites','admin'])) m(role, p)"


@query("j7_permissions", ("users",), f"SELECT username, role, array_to_string(list_sort(coalesce(p, [])), ',') AS permissions, coalesce(list_contains(p, 'add_files'), false) AS can_add, coalesce(list_contains(p, 'modify_delete'), false) AS can_modify, coalesce(list_contains(p, 'admin'), false) AS is_admin FROM users LEFT JOIN {_GRANTS} USING (role)")
def _(t):
    return accounts.permissions(t.users(), accounts.permission_matrix(t.spark)).withColumn("permissions", F.array_join("permissions", ","))


_LACK = "CASE WHEN auth_state = 'ok' THEN 403 ELSE 401 END"
_MAY = lambda p: f"coalesce(list_contains(p, '{p}'), false)"
_OWN = f"CASE WHEN auth_state <> 'ok' THEN 401 WHEN NOT {_MAY('write_progress')} THEN 403 ELSE 200 END"


@query("j8_authorize", ("requests", "users", "uploads"), f"""SELECT request_id, role, CASE
  WHEN method = 'OPTIONS' THEN 200 WHEN auth_state = 'blocked' THEN 429 WHEN auth_state = 'failed' THEN 401
  WHEN starts_with(path, '/_admin') THEN CASE WHEN method IN ('GET', 'HEAD') AND NOT contains(path, '/api/') THEN 200 WHEN path = '/_admin/api/invites' THEN CASE WHEN {_MAY('manage_invites')} THEN 200 ELSE {_LACK} END WHEN {_MAY('admin')} THEN 200 ELSE {_LACK} END
  WHEN method IN ('GET', 'HEAD', 'PROPFIND') THEN CASE WHEN auth_state <> 'ok' AND method <> 'PROPFIND' AND kind = 'library' THEN 401 ELSE 200 END
  WHEN method = 'PUT' THEN CASE WHEN kind = 'progress' THEN {_OWN} WHEN kind = 'library' THEN CASE WHEN {_MAY('add_files')} THEN 200 ELSE {_LACK} END ELSE 403 END
  WHEN method = 'MKCOL' THEN CASE WHEN kind = 'library' THEN CASE WHEN {_MAY('add_files')} THEN 200 ELSE {_LACK} END ELSE 403 END
  WHEN method = 'PROPPATCH' THEN CASE WHEN {_MAY('modify_delete')} THEN 200 ELSE {_LACK} END
  WHEN kind = 'progress' THEN {_OWN}
  WHEN method = 'DELETE' AND role = 'uploader' AND owned THEN 200
  WHEN {_MAY('modify_delete')} THEN 200 ELSE {_LACK} END AS status_code
FROM (SELECT r.*, {_TYPE} AS kind, CASE WHEN auth_state = 'ok' THEN u.role ELSE 'anonymous' END AS role, coalesce({_TYPE} = 'library' AND uploader_username = r.username, false) AS owned FROM requests r LEFT JOIN users u ON u.username = r.username LEFT JOIN uploads ON volume_key = substr(path, 9)) LEFT JOIN {_GRANTS} USING (role)""")
def _(t):
    return access.authorize(t.requests(), t.users(), t.uploads(), accounts.permission_matrix(t.spark), browse=True, download=False).select("request_id", "role", "status_code")


_ORIGIN = "CASE request_id % 7 WHEN 0 THEN 'https://reader.example' WHEN 1 THEN 'http://localhost:' || request_id WHEN 2 THEN 'http://localhost:' || path WHEN 3 THEN 'http://127.0.0.1:' || request_id % 90 || '/' WHEN 4 THEN 'http://127.0.0.1:' || request_id * 3 WHEN 5 THEN 'https://' || request_id || '.example' END"


@query("j9_match_origin", ("requests",), f"SELECT request_id, origin FROM (SELECT request_id, {_ORIGIN} AS origin FROM requests) WHERE origin = 'https://reader.example' OR regexp_full_match(origin, 'http://(localhost|127[.]0[.]0[.]1):[0-9]+')")
def _(t):
    patterns = t.spark.createDataFrame([("https://reader.example",), ("http://localhost:*",), ("http://127.0.0.1:*",), ("https://*.example",)], "pattern string")
    return access.match_origin(t.requests().select("request_id", F.expr(_ORIGIN).alias("origin")), patterns).select("request_id", "origin")


query("j10_list_children", ("files",), "SELECT DISTINCT split_part(rel_path, '/', 2) AS name, 'directory' AS kind FROM files WHERE starts_with(rel_path, 'en/')")(lambda t: library.list_children(t.files(), "/en/"))


@query("j11_folder_contents", ("files",), "SELECT d AS directory, rel_path FROM files, (SELECT DISTINCT regexp_extract(rel_path, '^([^/]*)/', 1) AS d FROM files UNION SELECT DISTINCT regexp_extract(rel_path, '^(.*)/', 1) FROM files) WHERE starts_with(rel_path, d || '/') AND ends_with(rel_path, '.cbz')")
def _(t):
    folders = t.files().select(F.explode(library.ancestors(F.col("rel_path"))).alias("directory")).distinct()
    return library.folder_contents(t.files(), folders)


_REG = "SELECT request_id, trim(username) AS username, password_length, invite_code FROM registrations"
_EARLY = "CASE WHEN NOT regexp_full_match(r.username, '[a-zA-Z0-9_-]{3,32}') OR password_length < 8 OR password_length > 128 OR invite_code = '' OR i.code IS NULL THEN 400 WHEN u.username IS NOT NULL THEN 409 END"


#: Request after request, with the names and invites that are taken so far.
@query("j12_register", ("registrations", "users", "invites"), f"""WITH RECURSIVE e AS (SELECT r.*, i.role, {_EARLY} AS early FROM ({_REG}) r LEFT JOIN users u USING (username) LEFT JOIN (SELECT code, role FROM invites WHERE used_by IS NULL AND expires_at >= {SQL_NOW_I}) i ON i.code = r.invite_code),
o AS (SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM e WHERE early IS NULL),
s AS (SELECT 0::BIGINT AS n, 0::BIGINT AS request_id, 0 AS code, []::VARCHAR[] AS names, []::VARCHAR[] AS codes UNION ALL
SELECT o.n, o.request_id, CASE WHEN list_contains(codes, invite_code) THEN 400 WHEN list_contains(names, username) THEN 409 ELSE 201 END, CASE WHEN list_contains(codes, invite_code) OR list_contains(names, username) THEN names ELSE list_append(names, username) END, CASE WHEN list_contains(codes, invite_code) OR list_contains(names, username) THEN codes ELSE list_append(codes, invite_code) END
FROM s JOIN o ON o.n = s.n + 1),
d AS (SELECT request_id, code FROM s WHERE n > 0), x AS (SELECT e.invite_code, min(request_id) AS first FROM d JOIN e USING (request_id) WHERE code = 201 GROUP BY e.invite_code)
SELECT request_id, username, CAST(CASE WHEN early = 409 AND x.first < request_id THEN 400 ELSE coalesce(early, code) END AS INTEGER) AS status_code, CASE WHEN early IS NULL AND code = 201 THEN role END AS role FROM e LEFT JOIN d USING (request_id) LEFT JOIN x USING (invite_code)""")
def _(t):
    return accounts.register(t.registrations(), t.users(), t.invites(), "invite", now_i()).select("request_id", "username", "status_code", "role")


# --- aggregations --------------------------------------------------------------------------

query("a1_series_rollup", ("volumes",), f"SELECT series, page, min(front) AS cover, string_agg(name, ',' ORDER BY name) AS volumes FROM {_PAGES} GROUP BY series, page")(lambda t: library.series_rollup(_volumes(t)).select("series", "page", "cover", F.array_join(F.transform("volumes", lambda v: v["name"]), ",").alias("volumes")))
query("a2_pending_thumbnails", ("volumes",), "SELECT count(*) FILTER (has_cbz AND NOT has_cover AND NOT no_cover) AS pending_thumbnails FROM volumes")(lambda t: library.pending_thumbnails(_volumes(t)))


@query("a3_queue_status", ("volumes", "jobs"), "SELECT * FROM (SELECT count(*) FILTER (has_cbz AND NOT has_sidecar AND NOT has_sidecar_gz) AS pending_ocr, count(*) FILTER (has_cbz AND NOT has_cover AND NOT no_cover) AS pending_thumbnails FROM volumes), (SELECT arg_max(done_pages, updated_at) AS done_pages, arg_max(percent, updated_at) AS percent FROM jobs WHERE active AND NOT broken)")
def _(t):
    return library.queue_status(_volumes(t), records.read_progress(t.jobs()), "cpu").select("pending_ocr", "pending_thumbnails", "current.done_pages", "current.percent")


query("a4_volume_count", ("volumes",), "SELECT series, count(*) AS volumes FROM volumes GROUP BY series")(lambda t: library.volume_count(_volumes(t)))
query("a5_user_count", ("users",), "SELECT count(*) AS users FROM users WHERE status <> 'deleted'")(lambda t: accounts.user_count(t.users()))
query("a6_top_level_count", ("files",), "SELECT count(DISTINCT split_part(rel_path, '/', 1)) AS directories FROM files")(lambda t: library.top_level_count(t.files()))
query("a7_has_admin", ("users",), "SELECT bool_or(role = 'admin') AS has_admin FROM users")(lambda t: accounts.has_admin(t.users()))


@query("a9_page_json_count", ("progress",), "SELECT 'job' || job AS job, count(*) AS pages FROM progress GROUP BY job")
def _(t):
    return library.page_json_count(t.progress().select(F.expr("'job' || job || '/_ocr/p' || done || '.json'").alias("rel_path")))


query("a10_distinct_volumes", ("visible",), "SELECT DISTINCT series, left(file, -4) AS name FROM visible WHERE ends_with(file, '.cbz')")(lambda t: library.distinct_volumes(t.files()))
_TIME = "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h ' || s // 60 % 60 || 'm' ELSE s // 86400 || 'd ' || s // 3600 % 24 || 'h' END"


@query("a11_reading_stats", ("event_paths",), f"SELECT user_id, count(DISTINCT volume) AS volumes, CAST(sum(event_id % 9) AS BIGINT) AS pages_read, CAST(sum(event_id % 900) AS BIGINT) AS characters_read, CAST(sum(event_id % 3000) AS BIGINT) AS reading_time_seconds, any_value(f) AS reading_time_formatted FROM event_paths JOIN (SELECT user_id, {_TIME} AS f FROM (SELECT user_id, CAST(sum(event_id % 3000) AS BIGINT) AS s FROM event_paths GROUP BY user_id)) USING (user_id) GROUP BY user_id")
def _(t):
    read = t.event_paths().select("user_id", "volume", F.expr("event_id % 9").alias("pages"), F.expr("event_id % 900").alias("characters"), F.expr("event_id % 3000").alias("seconds"))
    return accounts.reading_stats(read, ["user_id"])


query("a12_corrupt_count", ("sidecars",), "SELECT count(*) FILTER (NOT json_valid(json)) AS corrupt FROM sidecars")(lambda t: library.corrupt_count(t.sidecars(), library.valid_sidecar(F.col("json"))))



def _members(t: Tables) -> DataFrame:
    return t.progress().select(F.expr("'job' || job || '.cbz'").alias("rel_path"), F.expr("if(done % 4 = 0, 'info.txt', 'p/' || lpad(cast(done as string), 3, '0') || if(done % 2 = 0, '.JPG', '.png'))").alias("member"))


@query("a8_image_counts", ("progress",), "SELECT 'job' || job || '.cbz' AS rel_path, count(*) FILTER (done % 4 <> 0) AS images FROM progress GROUP BY job")
def _(t):
    return library.image_counts(_members(t).select("rel_path").distinct(), _members(t))


query("w2_cover_member", ("progress",), "SELECT 'job' || job || '.cbz' AS rel_path, min('p/' || lpad(CAST(done AS VARCHAR), 3, '0') || CASE WHEN done % 2 = 0 THEN '.JPG' ELSE '.png' END) AS cover_member FROM progress WHERE done % 4 <> 0 GROUP BY job")(lambda t: library.cover_member(_members(t)))


@query("f29_check_sidecars", ("sidecars",), "SELECT rel_path, json, json_valid(json) AS valid FROM sidecars")
def _(t):
    return files.check_sidecars(t.sidecars())


_UUID5 = "left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("x13_normalize_sidecars", ("placed_sidecars",), f"""SELECT rel_path, CASE WHEN json_valid(json) THEN '{{"k":' || json_extract_string(json, '$.k') || ',"title":"' || title || '","volume":"' || regexp_extract(rel_path, '([^/]*)[.]ocr$', 1) || '","title_uuid":"' || {_UUID5} || '"}}' ELSE json END AS json
FROM (SELECT *, split_part(rel_path, '/', 2) AS title, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(split_part(rel_path, '/', 2))) AS h FROM placed_sidecars)""")
def _(t):
    return files.normalize_sidecars(t.placed_sidecars())


# --- windows, top-k, sets ------------------------------------------------------------------

query("w1_pending_queue", ("waiting",), "SELECT split_part(series, '/', 1) AS library, series, name, mtime, row_number() OVER (PARTITION BY split_part(series, '/', 1) ORDER BY mtime, series, name) AS position FROM waiting")(lambda t: library.pending_queue(_volumes(t)))


query("w1_global_queue", ("waiting",), "SELECT series, name, mtime, row_number() OVER (ORDER BY mtime, series, name) AS queue_position FROM waiting")(lambda t: library.queue_order(library.needs_sidecar(_volumes(t)).select("series", "name", "mtime")))


@query("w3_preferred_sidecar", ("files", "sidecars"), "WITH c AS (SELECT regexp_replace(rel_path, '(\\.ocr\\.gz|\\.ocr)$', '.cbz') AS volume_key, rel_path AS path, size % 4 <> 0 AS is_root, size % 3 <> 0 AS valid, ends_with(rel_path, '.gz') AS gz FROM files WHERE ends_with(rel_path, '.ocr') OR ends_with(rel_path, '.ocr.gz')), r AS (SELECT *, bool_or(is_root) OVER (PARTITION BY volume_key) AS rooted FROM c) SELECT volume_key, path FROM (SELECT *, row_number() OVER (PARTITION BY volume_key ORDER BY NOT gz, path) AS n FROM r WHERE valid AND (is_root OR NOT rooted)) WHERE n = 1")
def _(t):
    c = t.files().where("rel_path like '%.ocr' or rel_path like '%.ocr.gz'")
    return library.preferred_sidecar(c.select(paths.volume_key(F.col("rel_path")).alias("volume_key"), F.col("rel_path").alias("path"), F.expr("size % 4 <> 0").alias("is_root"), F.expr("size % 3 <> 0").alias("valid")))


_NUMBERED = "CASE WHEN id % 13 = 0 THEN left(path, -4) || '_' || (id % 5 + 1) || '.cbz' ELSE path END"


#: Request after request of each document's names, with the names that are taken so far.
@query("w4_unique_names", ("file_events",), f"""WITH RECURSIVE e AS (SELECT path AS family, list(DISTINCT CASE WHEN id % 2 = 0 THEN path ELSE left(path, -4) || '_' || (id % 7 + 1) || '.cbz' END) AS names FROM file_events WHERE id % 11 = 0 GROUP BY path),
i AS (SELECT path AS family, id, {_NUMBERED} AS name, row_number() OVER (PARTITION BY path ORDER BY id) AS n FROM file_events),
c AS (SELECT family, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS name, NULL::VARCHAR AS stored_name, coalesce(names, []::VARCHAR[]) AS taken FROM (SELECT DISTINCT family FROM i) LEFT JOIN e USING (family) UNION ALL
SELECT family, n, id, name, got, list_append(taken, got) FROM (SELECT c.family, i.n, i.id, i.name, c.taken, CASE WHEN NOT list_contains(taken, i.name) THEN i.name ELSE left(i.name, -4) || '_' || list_min(list_filter(range(1, len(taken) + 2), lambda k: NOT list_contains(taken, left(i.name, -4) || '_' || k || '.cbz'))) || '.cbz' END AS got FROM c JOIN i ON i.family = c.family AND i.n = c.n + 1))
SELECT id, name, stored_name FROM c WHERE n > 0""")
def _(t):
    ev = t.file_events()
    taken = ev.where("id % 11 = 0").select(F.expr("if(id % 2 = 0, path, replace(path, '.cbz', '') || '_' || (id % 7 + 1) || '.cbz')").alias("name"))
    return library.unique_names(ev.select("id", F.expr("if(id % 13 = 0, replace(path, '.cbz', '') || '_' || (id % 5 + 1) || '.cbz', path)").alias("name")), taken)


query("w5_first_seen", ("file_events",), "SELECT path, arg_min(id, (ts, id)) AS id, min(ts) AS ts FROM file_events GROUP BY path")(lambda t: library.first_seen(t.file_events().select("path", "ts", "id")).select("path", "id", "ts"))


@query("w6_current_progress", ("file_events",), "WITH u AS (SELECT library AS job, ts, id, kind = 'deleted' AND id % 3 = 0 AS done, id % 2 = 0 AS has_a, CASE WHEN id % 4 <> 0 THEN CAST(id AS VARCHAR) END AS a FROM file_events), g AS (SELECT *, coalesce(sum(CAST(done AS INT)) OVER (PARTITION BY job ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM u), l AS (SELECT job, max(seg) AS seg FROM g GROUP BY job) SELECT job, min(ts) AS started_at, max(ts) AS updated_at, (arg_max({'a': a}, (ts, id)) FILTER (has_a)).a AS a FROM g JOIN l USING (job, seg) GROUP BY job HAVING NOT bool_or(done)")
def _(t):
    fields = F.expr("map_concat(map('status', if(kind = 'deleted' and id % 3 = 0, 'done', 'running')), if(id % 2 = 0, map('a', if(id % 4 <> 0, cast(id as string), null)), cast(map() as map<string,string>)))")
    updates = t.file_events().select(F.col("library").alias("job"), "ts", "id", fields.alias("fields"))
    return progress.current_progress(updates).select("job", "started_at", "updated_at", F.try_element_at("fields", F.lit("a")).alias("a"))


query("w7_failures_in_window", ("attempts",), "SELECT attempt_id, count(*) FILTER (outcome = 'failure') OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS failures FROM attempts")(lambda t: access.failures_in_window(t.attempts(), 172800).select("attempt_id", "failures"))
query("l1_recent_audit", ("audit",), "SELECT id, action FROM audit ORDER BY created_at DESC, id DESC LIMIT 200")(lambda t: audit.recent_audit(t.audit()).select("id", "action"))
query("l2_list_invites", ("invites",), "SELECT id, code FROM invites")(lambda t: accounts.list_invites(t.invites(), True, now_i()).select("id", "code"))
query("l3_catalog_order", ("volumes",), "SELECT series, count(*) AS volumes FROM volumes GROUP BY series")(lambda t: library.catalog_order(library.volume_count(_volumes(t))))


def _user_files(t: Tables) -> DataFrame:
    return t.users().select("username", F.expr("if(id % 2 = 0, 'volume-data.json', 'profiles.json')").alias("filename"))


query("u1_merged_listing", ("files",), "SELECT 0 AS rank, 'volume-data.json' AS name UNION ALL SELECT DISTINCT 1, split_part(rel_path, '/', 1) FROM files")(lambda t: library.merged_listing(t.files(), _user_files(t), "user_8"))
query("u2_inject_missing", ("files",), "SELECT rel_path, CASE WHEN size % 2 = 0 THEN size ELSE -1 END AS size FROM files")(lambda t: library.inject_missing(t.files().where("size % 2 = 0").select("rel_path", "size"), t.files().select("rel_path", F.lit(-1).cast("long").alias("size")), "rel_path"))
query("u3_new_files", ("files",), "SELECT rel_path FROM files WHERE size % 5 <> 0")(lambda t: library.new_files(t.files().select("rel_path"), t.files().where("size % 5 = 0")))
query("u4_exclude_inflight", ("waiting",), "SELECT series, name FROM waiting WHERE mtime % 2 = 0")(lambda t: library.exclude_inflight(library.needs_sidecar(_volumes(t)).select("series", "name"), library.needs_sidecar(_volumes(t)).where("mtime % 2 <> 0"), ["series", "name"]))
query("u5_dedupe_candidates", ("files",), "SELECT rel_path AS path, CASE WHEN size % 2 = 0 THEN 1 ELSE 2 END AS source FROM files WHERE size % 2 = 0 OR size % 3 = 0")(lambda t: library.dedupe_candidates(t.files().where("size % 2 = 0").select(F.col("rel_path").alias("path")), t.files().where("size % 3 = 0").select(F.col("rel_path").alias("path"))))

# --- scalar functions ------------------------------------------------------------------------


@query("x_formats", ("files",), f"""SELECT rel_path, {_TIME} AS reading_time,
  s // 3600 || ':' || s % 3600 // 60 || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS eta_clock,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s // 60 % 60 || 'm' END AS eta_short,
  CASE WHEN n >= 1000000 THEN regexp_replace((n + 50000) // 100000 // 10 || '.' || (n + 50000) // 100000 % 10, '\\.0$', '') || 'M' WHEN n >= 1000 THEN regexp_replace((n + 50) // 100 // 10 || '.' || (n + 50) // 100 % 10, '\\.0$', '') || 'K' ELSE CAST(n AS VARCHAR) END AS short_count,
  CASE WHEN n = 0 THEN '0 B' ELSE regexp_replace(printf('%.1f', round(n / power(1024.0, b), 1)), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][b + 1] END AS bytes,
  CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 60 || 'm' END AS uptime
FROM (SELECT rel_path, mtime % 200000 AS s, size * (mtime % 5000) AS n, CASE WHEN size * (mtime % 5000) >= 1073741824 THEN 3 WHEN size * (mtime % 5000) >= 1048576 THEN 2 WHEN size * (mtime % 5000) >= 1024 THEN 1 ELSE 0 END AS b FROM files)""")
def _(t):
    s, n = F.expr("mtime % 200000"), F.expr("size * (mtime % 5000)")
    return t.files().select("rel_path", scalars.format_reading_time(s).alias("reading_time"), scalars.format_eta_clock(s).alias("eta_clock"), scalars.format_eta_short(s).alias("eta_short"), scalars.format_count(n).alias("short_count"), scalars.format_bytes(n).alias("bytes"), scalars.format_uptime(s).alias("uptime"))


@query("x7_x8_texts", (), "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 117) || '...' END AS short, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM documents")
def _(t):
    return t.table("documents").select("doc_id", scalars.truncate_text(F.col("text"), 120).alias("short"), scalars.escape_html(F.col("text")).alias("escaped"))


@query("x9_duration", (), "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS BIGINT) * 3600 WHEN 1 THEN CAST(o_orderkey AS BIGINT) * 86400 WHEN 2 THEN CAST(o_orderkey AS BIGINT) * 604800 END AS seconds FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey <= 0")
def _(t):
    return t.table("orders").select("o_orderkey", scalars.duration_seconds(F.expr("o_orderkey || element_at(array('h', 'D', 'w', 'm'), cast(o_orderkey % 4 as int) + 1)")).alias("seconds"))


@query("x10_progress_metrics", ("progress",), "SELECT job, done, CASE WHEN done >= total THEN 100 ELSE CAST(least(99, trunc(CAST(done AS DOUBLE) / total * 100)) AS BIGINT) END AS percent, CASE WHEN done >= total THEN 0 ELSE CAST(trunc((total - done) / (CAST(done AS DOUBLE) / greatest(elapsed, 1e-6))) AS BIGINT) END AS eta_seconds, CASE WHEN done >= total THEN 'finalizing' ELSE 'running' END AS status FROM progress")
def _(t):
    return t.progress().select("job", "done", scalars.progress_metrics(F.col("done"), F.col("total"), F.col("elapsed")).alias("m")).select("job", "done", "m.*")


query("x11_live_eta", ("files",), "SELECT rel_path, CASE WHEN size % 7 <> 0 THEN greatest(0, size - greatest(0, CAST(floor((mtime % 5000) / 2.0 - 100.5) AS BIGINT))) END AS eta FROM files")(lambda t: t.files().select("rel_path", scalars.live_eta(F.expr("if(size % 7 = 0, -1, size)"), F.lit(100.5), F.expr("(mtime % 5000) / 2.0D")).cast("long").alias("eta")))
_SHA = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(series))"
query("x12_title_uuid", ("volumes",), f"SELECT series, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[CAST('0x' || h[17] AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS title_uuid FROM (SELECT DISTINCT series, {_SHA} AS h FROM volumes)")(lambda t: _volumes(t).select("series").distinct().select("series", scalars.title_uuid(F.col("series")).alias("title_uuid")))
query("x14_content_type", ("files",), "SELECT rel_path, CASE WHEN ends_with(rel_path, '.cbz') THEN 'application/vnd.comicbook+zip' WHEN ends_with(rel_path, '.gz') THEN 'application/gzip' WHEN ends_with(rel_path, '.webp') THEN 'image/webp' ELSE 'application/octet-stream' END AS content_type FROM files")(lambda t: t.files().select("rel_path", paths.content_type(F.col("rel_path")).alias("content_type")))
query("x15_etag", ("files",), "SELECT rel_path, mtime || '.250000-' || size AS etag FROM files")(lambda t: t.files().select("rel_path", scalars.etag(F.expr("mtime + 0.25D"), F.col("size")).alias("etag")))
query("x16_quote_path", (), "SELECT doc_id, replace(url_encode(text), '%2F', '/') AS quoted FROM documents")(lambda t: t.table("documents").select("doc_id", paths.quote_path(F.col("text")).alias("quoted")))


@query("x17_reader_link", ("volumes",), "SELECT series, name, 'https://reader.example/#/upload?cbz=' || url_encode('https://lib.example/reader/' || url_encode(series) || '/' || url_encode(name) || '.cbz') || coalesce('&cover=' || url_encode(cover), '') AS link FROM volumes")
def _(t):
    return _volumes(t).select("series", "name", paths.reader_link(F.col("series"), F.col("name"), F.col("cover"), "https://reader.example", "https://lib.example").alias("link"))


@query("x18_audit_target", ("requests",), f"SELECT request_id, CASE {_TYPE} WHEN 'library' THEN 'library' WHEN 'progress' THEN 'progress' ELSE 'webdav' END AS target_type, path AS target_path FROM requests")
def _(t):
    relative = F.when(paths.is_library_path(F.col("path")), F.substring("path", 9, 2**31 - 1))
    return t.requests().select("request_id", audit.audit_target(relative, F.col("path")).alias("a")).select("request_id", "a.*")


query("x19_audit_display", ("audit",), "SELECT id, actor_username AS actor, action, target_path AS target, details FROM audit")(lambda t: audit.audit_display(t.audit()))
query("x20_mask_secret", ("invites", "registrations"), "SELECT id, CASE WHEN used_by IS NOT NULL THEN '****' END AS shown FROM invites UNION ALL SELECT request_id, CASE WHEN invite_code = '' THEN '' ELSE '****' END FROM registrations")(lambda t: t.invites().select("id", F.col("used_by").alias("text")).unionAll(t.registrations().select("request_id", "invite_code")).select("id", scalars.mask_secret(F.col("text")).alias("shown")))

# --- keyed tables ------------------------------------------------------------------------------

_UP = "volume_key, uploader_username, uploaded_at, last_modified_by, last_modified_at"


@query("m1_apply_uploads", ("uploads",), f"SELECT {_UP} FROM uploads")
def _(t):
    """In three batches, each on the table that the one before left."""
    kept = t.spark.createDataFrame([], schemas.UPLOADS)
    for batch in range(3):
        kept = ownership.apply_uploads(kept, t.upload_events().where(F.expr(f"least(datediff(ts, date'2024-01-01') div 10, 2) = {batch}")))
    return kept


query("m2_forget_uploads", ("uploads", "audit"), f"SELECT {_UP} FROM uploads WHERE '/reader/' || volume_key NOT IN (SELECT target_path FROM audit WHERE action = 'delete')")(lambda t: ownership.forget_uploads(t.uploads(), t.audit().where("action = 'delete'").select(F.expr("replace(substring(target_path, 9), '.cbz', '.ocr.gz')").alias("path"))))
query("m3_forget_prefix", ("uploads",), f"SELECT {_UP} FROM uploads WHERE NOT starts_with(volume_key, 'en/src1/') AND NOT starts_with(volume_key, 'fr/')")(lambda t: ownership.forget_prefix(t.uploads(), t.spark.createDataFrame([("/en/src1/",), ("fr",), ("",)], "prefix string")))
_MOVED = "length(volume_key) > 0 AND CAST(regexp_extract(volume_key, 'v(\\d+)', 1) AS BIGINT) % 10 = 3"
query("m4_rename_uploads", ("uploads",), f"SELECT CASE WHEN {_MOVED} THEN 'moved/' || volume_key ELSE volume_key END AS volume_key, uploader_username, uploaded_at, last_modified_by, CASE WHEN {_MOVED} THEN {SQL_NOW_E} ELSE last_modified_at END AS last_modified_at FROM uploads")(lambda t: ownership.rename_uploads(t.uploads(), t.uploads().where("cast(regexp_extract(volume_key, 'v([0-9]+)', 1) as long) % 10 = 3").select(F.col("volume_key").alias("old_path"), F.concat(F.lit("moved/"), "volume_key").alias("new_path")), now_e()))
query("m5_rename_folder", ("uploads",), f"SELECT CASE WHEN starts_with(volume_key, 'en/') THEN 'english' || substr(volume_key, 3) ELSE volume_key END AS volume_key, uploader_username, uploaded_at, last_modified_by, CASE WHEN starts_with(volume_key, 'en/') THEN {SQL_NOW_E} ELSE last_modified_at END AS last_modified_at FROM uploads")(lambda t: ownership.rename_folder(t.uploads(), "/en/", "english", now_e()))


@query("m6_delete_volumes", ("files",), "SELECT rel_path FROM files WHERE regexp_replace(rel_path, '(\\.ocr\\.gz|\\.ocr|\\.webp|\\.nocover)$', '.cbz') NOT IN (SELECT rel_path FROM files WHERE size % 4 = 0 AND ends_with(rel_path, '.cbz')) AND NOT (size % 4 = 1 AND ends_with(rel_path, '.webp'))")
def _(t):
    gone = t.files().where("(size % 4 = 0 and rel_path like '%.cbz') or (size % 4 = 1 and rel_path like '%.webp')")
    return ownership.delete_volumes(t.files(), gone).select("rel_path")


@query("m7_update_users", ("users",), f"SELECT id, CASE WHEN id % 5 = 0 THEN 'editor' ELSE role END AS role, CASE WHEN id % 5 = 2 AND status = 'pending' THEN 'active' WHEN id % 5 = 3 THEN 'disabled' WHEN id % 5 = 4 THEN 'deleted' ELSE status END AS status, CASE WHEN id % 5 = 1 THEN 'editor' END AS notes, CASE WHEN id % 5 IN (0, 1, 3) OR id % 5 = 2 AND status = 'pending' OR id % 5 = 4 AND status <> 'deleted' THEN {SQL_NOW_E} ELSE updated_at END AS updated_at FROM users")
def _(t):
    changes = t.users().select("username", F.expr("element_at(array('role', 'notes', 'approve', 'disable', 'delete'), cast(id % 5 as int) + 1)").alias("change"), F.lit("editor").alias("value"))
    return accounts.update_users(t.users(), changes, now_e()).select("id", "role", "status", "notes", "updated_at")


@query("m8_use_invites", ("invites",), f"SELECT id, CASE WHEN used_by IS NULL AND expires_at >= {SQL_NOW_I} THEN 'b' || id ELSE used_by END AS used_by, CASE WHEN used_by IS NULL AND expires_at >= {SQL_NOW_I} THEN {SQL_NOW_I} ELSE used_at END AS used_at FROM invites")
def _(t):
    uses = t.invites().select("code", F.explode(F.expr("array(struct('a' || id as username, 2 as use_id), struct('b' || id as username, 1 as use_id))")).alias("u")).select("code", "u.*")
    return accounts.use_invites(t.invites(), uses, now_i()).select("id", "used_by", "used_at")


@query("m9_create_users", ("registrations", "users"), f"SELECT id, username FROM (SELECT request_id AS id, r.username, row_number() OVER (PARTITION BY r.username ORDER BY request_id) AS n FROM registrations r) WHERE n = 1 AND regexp_full_match(username, '[a-zA-Z0-9_-]{{3,32}}') AND username NOT IN (SELECT username FROM users)")
def _(t):
    new = t.registrations().select(F.col("request_id").alias("id"), "username", F.lit("writer").alias("role"), F.lit("active").alias("status"))
    return accounts.create_users(t.users(), new, now_e())[0].select("id", "username")


query("m10_conform", ("users",), "SELECT id, username, CASE role WHEN 'writer' THEN 'uploader' ELSE role END AS role, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS notes, created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM users")(lambda t: accounts.conform(t.users().select("id", "username", "role", "created_at"), schemas.USERS))
query("m11_cleanup_invites", ("invites",), f"SELECT id FROM invites WHERE NOT (expires_at < {SQL_NOW_I} AND used_by IS NULL)")(lambda t: accounts.cleanup_invites(t.invites(), now_i()).select("id"))
query("m12_prune_audit", ("audit",), f"SELECT id FROM audit WHERE created_at >= {SQL_NOW_E} - INTERVAL 30 DAY")(lambda t: audit.prune_audit(t.audit(), now_e()).select("id"))
query("m13_delete_invites", ("invites", "registrations"), "SELECT id FROM invites WHERE code NOT IN (SELECT invite_code FROM registrations)")(lambda t: accounts.delete_invites(t.invites(), t.registrations().select(F.col("invite_code").alias("code"))).select("id"))


@query("m14_create_invites", (), f"SELECT o_orderkey AS id, 'c' || o_orderkey AS code, CASE o_orderkey % 3 WHEN 0 THEN 'uploader' ELSE 'editor' END AS role, {SQL_NOW_I} + to_seconds((o_orderkey % 30 + 1) * 86400) AS expires_at FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 7 <> 0")
def _(t):
    asked = t.table("orders").select(F.col("o_orderkey").alias("id"), F.expr("'c' || o_orderkey").alias("code"), F.expr("element_at(array('writer', 'editor', 'king'), cast(o_orderkey % 3 as int) + 1)").alias("role"), F.lit("user_1").alias("invited_by"), F.expr("if(o_orderkey % 7 = 0, 'soon', (o_orderkey % 30 + 1) || 'd')").alias("duration"))
    return accounts.create_invites(asked, now_i()).select("id", "code", "role", "expires_at")


@query("m15_audit_from_changes", ("upload_events",), "SELECT row_number() OVER (ORDER BY ts, path) AS id, username AS actor_username, CASE WHEN existed THEN 'edit' ELSE 'upload' END AS action, '{\"existed_before\":' || existed || '}' AS details FROM upload_events")
def _(t):
    numbered = running_total(t.upload_events(), [], ["ts", "path"], F.lit(1), "changes", "id")
    changes = numbered.select("id", F.col("username").alias("actor"), F.lit("write").alias("change"), "path", F.lit(None).cast("string").alias("username"), "existed", "ts")
    return audit.audit_from_changes(changes).select("id", "actor_username", "action", "details")


query("m16_drop_user_files", ("users",), "SELECT username FROM users WHERE status <> 'deleted'")(lambda t: accounts.drop_user_files(_user_files(t), t.users().where("status = 'deleted'")).select("username"))

query("m3_forget_prefix_like", ("uploads",), f"SELECT {_UP} FROM uploads WHERE NOT lower(volume_key) LIKE 'e_/src1/%' AND NOT lower(volume_key) LIKE 'fr/%5.cbz/%' AND NOT lower(volume_key) LIKE 'de/s%4/%' AND NOT lower(volume_key) LIKE 'es/src_/%'")(lambda t: ownership.forget_prefix(t.uploads(), t.spark.createDataFrame([("/E_/src1/",), ("fr/%5.cbz",), ("de/S%4",), ("es/src_",), ("",)], "prefix string"), "like"))

# --- batch forms of the stream operators ----------------------------------------------------------


_SETTLED_SQL = "WITH x AS (SELECT *, epoch_us(ts) / 1e6 AS sec FROM file_events), i AS (SELECT *, sum(g) OVER (PARTITION BY path ORDER BY sec) AS island FROM (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY path ORDER BY sec) >= 7200 THEN 1 ELSE 0 END AS g FROM x WHERE kind <> 'deleted')), f AS (SELECT path, island, max(sec) FILTER (kind = 'created') AS created, max(sec) + 7200 AS settled_at FROM i GROUP BY path, island) SELECT path, round(min(settled_at), 3) AS settled_at FROM f WHERE created IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x WHERE x.path = f.path AND kind = 'deleted' AND x.sec >= f.created AND x.sec < f.settled_at) GROUP BY path"


@query("t1_settled_files", ("file_events",), _SETTLED_SQL)
def _(t):
    return streams.settled_files(t.file_events(), 7200).select("path", F.round("settled_at", 3).alias("settled_at"))


_REFRESH_SQL = "SELECT library, max(ts) + INTERVAL 7200 SECOND AS refreshed_at, count(*) AS events FROM (SELECT *, sum(g) OVER (PARTITION BY library ORDER BY ts) AS p FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY library ORDER BY ts) >= INTERVAL 7200 SECOND THEN 1 ELSE 0 END AS g FROM file_events)) GROUP BY library, p"
query("t2_debounced_refresh", ("file_events",), _REFRESH_SQL)(lambda t: streams.debounced_refresh(t.file_events(), 7200))
_LIMIT_SQL = """WITH RECURSIVE a AS (SELECT *, count(*) FILTER (outcome = 'failure') OVER w AS k, coalesce(max(rn) FILTER (outcome = 'success') OVER w, 0) AS cleared
FROM (SELECT *, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY key ORDER BY ts, attempt_id) AS rn FROM attempts) WINDOW w AS (PARTITION BY key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT a.key, a.rn, a.sec, f.sec AS oldest, row_number() OVER (PARTITION BY a.key ORDER BY a.rn) AS n FROM a JOIN a f ON f.key = a.key AND f.outcome = 'failure' AND f.k = a.k - 3 WHERE f.sec >= a.sec - 172800 AND f.rn > a.cleared),
b AS (SELECT key, n, rn, true AS begins, sec + 86400 AS until FROM c WHERE n = 1 UNION ALL SELECT c.key, c.n, c.rn, c.oldest >= b.until, CASE WHEN c.oldest >= b.until THEN c.sec + 86400 ELSE b.until END FROM b JOIN c ON c.key = b.key AND c.n = b.n + 1)
SELECT attempt_id, key, NOT begins AND until <= sec AS allowed, CAST(CASE WHEN begins THEN 86400 WHEN until > sec THEN floor(until - sec) + 1 ELSE 0 END AS BIGINT) AS retry_after
FROM (SELECT attempt_id, key, sec, coalesce(b.begins, false) AS begins, coalesce(max(CASE WHEN b.begins THEN b.until END) OVER (PARTITION BY key ORDER BY rn), 0) AS until FROM a LEFT JOIN b USING (key, rn))"""

query("t3_login_limiter", ("attempts",), _LIMIT_SQL)(lambda t: access.replay_limiter(t.attempts(), 3, 172800, 86400))


def _polls(t: Tables) -> DataFrame:
    return t.progress().select("job", F.expr("done * 400D").alias("at"), F.expr("done - done % 3").alias("done"), "total", F.lit(False).alias("valid_sidecar"))


_STALLED_SQL = "WITH p AS (SELECT job, done * 400.0 AS sec, done - done % 3 AS d, total FROM progress), m AS (SELECT *, max(sec) FILTER (mv) OVER w AS moved_at FROM (SELECT *, d IS DISTINCT FROM lag(d) OVER (PARTITION BY job ORDER BY sec) AS mv FROM p) WINDOW w AS (PARTITION BY job ORDER BY sec)), c AS (SELECT *, min(sec) FILTER (d >= total) OVER (PARTITION BY job ORDER BY sec) AS since FROM m), v AS (SELECT job, sec, CASE WHEN sec > 3600 THEN 'hard' WHEN d >= total AND sec - since > 300 THEN 'finalizing' WHEN sec - moved_at > 600 THEN 'idle' END AS verdict FROM c) SELECT job, coalesce(arg_min(verdict, sec) FILTER (verdict IS NOT NULL), 'running') AS verdict, min(sec) FILTER (verdict IS NOT NULL) AS ended_at FROM v GROUP BY job"


@query("t4_stalled_jobs", ("progress",), _STALLED_SQL)
def _(t):
    return progress.stalled_jobs(_polls(t), finalizing=300).withColumnRenamed("at", "ended_at")


# --- the stream forms, over rows in the order of their time ---------------------------------------


def _in_time(t: Tables, rows: DataFrame, closing: list[DataFrame], parts: int = 3) -> DataFrame:
    """A stream of rows(ts) in parts that follow each other in time, each a batch, then of closing batches, which move the watermark on."""
    came = shared_path(t.spark, "in-time")
    first, last = rows.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    step = (last - first) / parts
    for n in range(parts):
        begin = F.lit(True) if n == 0 else F.col("ts") >= F.lit(first + n * step)
        rows.where(begin & (F.lit(True) if n == parts - 1 else F.col("ts") < F.lit(first + (n + 1) * step))).coalesce(1).write.parquet(f"{came}/{n}")
    for n, batch in enumerate(closing):
        batch.select(*rows.columns).coalesce(1).write.parquet(f"{came}/{parts + n}")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(came)


def _collected(t: Tables, stream: DataFrame) -> DataFrame:
    """The rows that a stream appends."""
    out, kept = shared_path(t.spark, "streamed"), t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(t.spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return t.spark.read.schema(stream.schema).parquet(out)


def _closing(t: Tables, *days: int, **columns) -> list[DataFrame]:
    """A batch of one late row for each of so many days after the last event."""
    return [t.file_events().agg(F.max("ts").cast("timestamp").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {d} DAYS")).alias("ts"), *[v.alias(k) for k, v in columns.items()]) for d in days]


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_settled_stream", ("file_events",), f"SELECT path, CAST(floor(settled_at) AS BIGINT) AS settled_at FROM ({_SETTLED_SQL})")
def _(t):
    rows = _stamped(t.file_events().select("path", "kind", "ts"))
    stream = _in_time(t, rows, _closing(t, 10, 20, path=F.lit("end"), kind=F.lit("modified")))
    return _collected(t, streams.settled_files_stream(stream, 7200, forget=1e9)).select("path", F.floor(F.round(F.col("settled_at") * 1000) / 1000).alias("settled_at"))


@query("t2_refresh_stream", ("file_events",), _REFRESH_SQL)
def _(t):
    rows = _stamped(t.file_events().select("library", "ts"))
    stream = _in_time(t, rows, _closing(t, 10, 20, library=F.lit("end")))
    found = _collected(t, streams.debounced_refresh_stream(stream, 7200, "1 second")).where("library <> 'end'")
    return found.withColumn("refreshed_at", F.col("refreshed_at").cast("timestamp_ntz"))


@query("t4_stalled_stream", ("progress",), f"SELECT job, verdict, CAST(ended_at AS DOUBLE) AS ended_at FROM ({_STALLED_SQL}) WHERE verdict <> 'running'")
def _(t):
    polls = _polls(t).withColumn("ts", F.timestamp_seconds("at"))
    ended = _collected(t, streams.stalled_jobs_stream(_in_time(t, polls, []).drop("ts"), finalizing=300))
    return ended.select("job", "verdict", F.col("at").alias("ended_at"))


@query("t5_once_stream", ("file_events",), "SELECT path, min(ts) AS ts FROM file_events GROUP BY path")
def _(t):
    firsts = _stamped(t.file_events().select("path", "ts", "id").repartition("path").sortWithinPartitions("ts"))
    once = _collected(t, streams.once_per_path(_in_time(t, firsts.orderBy("ts"), []), "100 days"))
    return once.select("path", F.col("ts").cast("timestamp_ntz").alias("ts"))


query("t5_once_per_path", ("file_events",), "SELECT path, min(ts) AS ts FROM file_events GROUP BY path")(lambda t: streams.first_per_path(t.file_events()).select("path", "ts"))
