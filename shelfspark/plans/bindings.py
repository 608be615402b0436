"""The engine's relations, derived from the given tables: as DataFrames and, for checking, as SQL.

Series are ``lang/source``, volumes ``v`` and the document number; accounts come from customers, invites from
orders, audit events, requests and attempts from events, progress from conversations. Times are without a zone.
"""

from __future__ import annotations

import gzip
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.shared import shared_path
from shelfspark.shipping import map_arrow
from shelfspark.sources.files import move_files, write_files

NOW_INVITES = "TIMESTAMP_NTZ '1997-06-01 00:00:00'"
NOW_EVENTS = "TIMESTAMP_NTZ '2024-02-10 00:00:00'"


#: Documents of one archive or sidecar in the trees that are written from documents.
BLOCK = 64


def _packed(batches):
    """(rel_path, content) of an archive for every block of documents: some lose their directory, some get a wrong byte."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, docs = (column[row].as_py() for column in batch.columns)
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr("info.txt", str(block))
                for doc in docs:
                    archive.writestr(f"{doc['doc_id']}.txt", doc["text"] or "")
            content = bytearray(out.getvalue())
            if block % 5 == 4:
                del content[-30:]
            elif block % 7 == 6:
                content[30 + len("info.txt")] ^= 1
            yield pa.RecordBatch.from_arrays([pa.array([f"s/b{block}.cbz"]), pa.array([bytes(content)])], names=["rel_path", "content"])


def _encoded(batches):
    """(rel_path, content) of sidecars(rel_path, json, pack)."""
    for batch in batches:
        contents = [gzip.compress(text.encode()) if pack else text.encode() for text, pack in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["rel_path", "content"])


class Tables:
    """Derived relations of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _stems(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.expr("lang || '/' || source || '/v' || lpad(cast(doc_id as string), 9, '0')").alias("stem"), "n_chars")

    def files(self) -> DataFrame:
        ends = F.expr("array_compact(array(if(doc_id % 11 <> 0, '.cbz', null), if(doc_id % 3 = 0, '.ocr', null), if(doc_id % 5 = 0, '.ocr.gz', null), if(doc_id % 2 = 0, '.webp', null), if(doc_id % 7 = 0, '.nocover', null)))")
        return self._stems().select("stem", F.explode(ends).alias("ext"), "n_chars", "doc_id").select(F.expr("stem || ext").alias("rel_path"), F.col("n_chars").alias("size"), F.expr("1704067200 + (doc_id * 7919) % 2592000").alias("mtime"))

    def archive_tree(self) -> str:
        """A folder of volumes, one for every BLOCK documents."""
        blocks = self.table("documents").groupBy(F.expr(f"doc_id div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("doc_id", "text")).alias("docs"))
        root = shared_path(self.spark, "volumes")
        write_files(map_arrow(blocks, _packed, "rel_path string, content binary"), root)
        return root

    def sidecar_tree(self) -> str:
        """A folder of sidecars, one for every BLOCK documents: plain, packed, or plain under the name of a packed one."""
        blocks = self.table("documents").groupBy(F.expr(f"doc_id div {BLOCK}").alias("block")).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids"))
        root = shared_path(self.spark, "sidecars")
        texts = blocks.select(F.expr("'s/b' || block || if(block % 3 = 0, '.ocr', '.ocr.gz')").alias("rel_path"), F.expr("""'{"ids":[' || ids || ']}'""").alias("json"), F.expr("block % 3 = 1").alias("pack"))
        write_files(map_arrow(texts, _encoded, "rel_path string, content binary"), root)
        return root

    def user_tree(self) -> str:
        """A folder of the files of users, made of suppliers."""
        names = F.expr("array_compact(array('volume-data.json', if(s_suppkey % 2 = 0, 'profiles.json', null), if(s_suppkey % 3 = 0, 'notes.json', null), if(s_suppkey % 4 = 0, '_draft.json', null)))")
        rows = self.table("supplier").select("s_suppkey", "s_name", F.explode(names).alias("name"))
        root = shared_path(self.spark, "users")
        write_files(rows.select(F.expr("'user_' || s_suppkey || '/' || name").alias("rel_path"), F.expr("""encode('{"name":"' || s_name || '"}', 'UTF-8')""").alias("content")), root)
        return root

    def change_user_tree(self, root: str) -> None:
        """Rewrites, adds, moves and removes files of a tree of user_tree; hidden ones come too."""
        rows = self.table("supplier").select("s_suppkey", F.expr("'user_' || s_suppkey || '/'").alias("folder"))
        new = F.expr("array_compact(array(if(s_suppkey % 5 = 0, 'volume-data.json', null), if(s_suppkey % 7 = 0, 'sub/_new.cbz', null), if(s_suppkey % 3 = 0, '.secret', null), if(s_suppkey % 3 = 0, '.git/x.cbz', null)))")
        written = rows.select("s_suppkey", "folder", F.explode(new).alias("name")).select(F.expr("folder || name").alias("rel_path"), F.expr("encode(repeat('x', 50), 'UTF-8')").alias("content"))
        write_files(written, root)
        move_files(rows.where("s_suppkey % 6 = 0").select(F.expr("folder || 'notes.json'").alias("rel_path"), F.expr("folder || 'renamed.json'").alias("to")), root)
        move_files(rows.where("s_suppkey % 8 = 0").select(F.expr("folder || 'profiles.json'").alias("rel_path"), F.lit(None).cast("string").alias("to")), root)

    def users(self) -> DataFrame:
        made = F.expr("timestampadd(MINUTE, c_custkey, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.expr("'user_' || c_custkey").alias("username"), F.expr("element_at(array('registered','uploader','inviter','editor','admin','writer'), cast(c_custkey % 6 as int) + 1)").alias("role"), F.expr("element_at(array('active','pending','disabled','deleted'), c_nationkey % 4 + 1)").alias("status"), F.lit(None).cast("string").alias("notes"), made.alias("created_at"), made.alias("updated_at"))

    def invites(self) -> DataFrame:
        orders = self.table("orders")
        used = "o_orderstatus = 'F'"
        return orders.select(F.col("o_orderkey").alias("id"), F.expr("'inv-' || o_orderkey").alias("code"), F.expr("element_at(array('registered','uploader','editor','writer'), cast(o_orderkey % 4 as int) + 1)").alias("role"), F.expr("'user_' || o_custkey").alias("invited_by"), F.col("o_orderdate").alias("created_at"), F.expr("timestampadd(SECOND, element_at(array(3600, 604800, 2592000), cast(o_orderkey % 3 as int) + 1), o_orderdate)").alias("expires_at"), F.expr(f"if({used}, 'user_' || o_custkey, null)").alias("used_by"), F.expr(f"if({used}, o_orderdate, null)").alias("used_at"))

    def event_paths(self) -> DataFrame:
        events, stems = self.table("events"), self._stems().select("doc_id", "stem")
        count = self.table("documents").agg(F.count(F.lit(1)).alias("n"))
        numbered = events.crossJoin(F.broadcast(count)).withColumn("doc_id", F.expr("event_id % n"))  # one row
        return numbered.join(stems, "doc_id").withColumn("volume", F.expr("stem || '.cbz'"))

    def audit(self) -> DataFrame:
        action = F.expr("case event_type when 'purchase' then 'upload' when 'click' then 'edit' when 'view' then 'move' when 'signup' then 'mkdir' else 'delete' end")
        return self.event_paths().select(F.col("event_id").alias("id"), F.expr("'user_' || user_id").alias("actor_username"), action.alias("action"), F.lit("library").alias("target_type"), F.expr("'/reader/' || volume").alias("target_path"), F.lit(None).cast("string").alias("target_username"), F.col("props").alias("details"), F.col("ts").alias("created_at"))

    def upload_events(self) -> DataFrame:
        return self.audit().where("action in ('upload', 'edit')").select(F.expr("substring(target_path, 9)").alias("path"), F.col("actor_username").alias("username"), F.col("created_at").alias("ts"), F.expr("action = 'edit'").alias("existed"))

    def uploads(self) -> DataFrame:
        from shelfspark import schemas
        from shelfspark.operators.ownership import apply_uploads

        return apply_uploads(self.spark.createDataFrame([], schemas.UPLOADS), self.upload_events())

    def attempts(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").cast("string").alias("key"), "ts", F.expr("case event_type when 'error' then 'failure' when 'signup' then 'success' else '' end").alias("outcome"))

    def requests(self) -> DataFrame:
        method = "element_at(array('GET','HEAD','PROPFIND','OPTIONS','PUT','MKCOL','DELETE','MOVE','LOCK','PROPPATCH'), cast(event_id % 10 as int) + 1)"
        path = "case event_id % 7 when 0 then '/reader' when 1 then '/reader/' || volume when 2 then '/reader/volume-data.json' when 3 then '/inbox/x.cbz' when 4 then '/_admin/api/users' when 5 then '/_admin/api/invites' else '/other' end"
        state = "case when event_id % 17 = 0 then 'failed' when event_id % 19 = 0 then 'blocked' when event_id % 5 = 0 then 'anonymous' else 'ok' end"
        return self.event_paths().select(F.col("event_id").alias("request_id"), F.expr(method).alias("method"), F.expr(path).alias("path"), F.expr("if(event_id % 5 = 0, null, 'user_' || user_id)").alias("username"), F.expr(state).alias("auth_state"))

    def progress(self) -> DataFrame:
        turns = self.table("conversations")
        total = turns.groupBy("conv_id").agg(F.expr("max(turn) + 1 + conv_id % 2").alias("total"))
        return turns.join(total, "conv_id").select(F.col("conv_id").alias("job"), F.expr("turn + 1").alias("done"), "total", F.expr("cast((turn + 1) * (conv_id % 7 + 1) as double)").alias("elapsed"))

    def jobs(self) -> DataFrame:
        """Progress records as JSON: a job of every conversation on a volume, in capitals for some; broken for others."""
        count = self.table("documents").agg(F.count(F.lit(1)).alias("n"))
        last = self.progress().groupBy("job").agg(F.max("done").alias("done"), F.max("total").alias("total"))
        named = last.crossJoin(F.broadcast(count)).withColumn("doc_id", F.expr("job % n")).join(self._stems(), "doc_id")  # one row
        path = F.expr("if(job % 2 = 0, upper(stem || '.cbz'), stem || '.cbz')")
        text = F.expr("""'{"active":' || if(job % 3 = 0, 'false', 'true') || ',"series":"s","volume":"v","relative_cbz":"' || path || '","done_pages":' || done || ',"total_pages":' || total || if(job % 4 = 0, '', ',"percent":' || (job % 100)) || ',"updated_at":' || job || '.5}'""")
        return named.withColumn("path", path).select("job", F.when(F.expr("job % 11 = 0"), "[1").otherwise(text).alias("json"))

    def sidecars(self) -> DataFrame:
        return self.table("events").select(F.expr("'s/v' || event_id || '.ocr'").alias("rel_path"), F.expr("if(event_id % 13 = 0, left(props, length(props) - 1), props)").alias("json"))

    def logged(self) -> DataFrame:
        code, failed = "if(auth_state = 'ok', 200, 401)", "auth_state = 'failed'"
        told = self.requests().select("request_id", "auth_state", F.expr("'worker-' || request_id % 8").alias("thread"), "method", "path", F.expr("request_id * 37 % 5000").alias("elapsed_ms"))
        return told.select("thread", "method", "path", F.expr(f"if({failed} or auth_state = 'blocked', null, {code})").alias("code"), "elapsed_ms", F.expr(f"if({failed}, 'AuthError', null)").alias("exception"), F.expr(f"if({failed}, 'bad: ' || path, null)").alias("message"))

    def changed_paths(self) -> DataFrame:
        """Changes with a source and for some a destination: files of documents, sidecars, and names that end in other ways."""
        ends = "array('.cbz', '.CBZ', '.ocr', '.ocr.gz', '.webp', '.txt', '', '.gz.part', '.webpx')"
        return self.file_events().join(self.table("events").select(F.col("event_id").alias("id"), "user_id"), "id").select("id", F.expr(f"replace(path, '.cbz', {ends}[cast(user_id % 9 as int)])").alias("path"), F.expr(f"if(kind = 'deleted', null, 'd/x' || {ends}[cast(id % 9 as int)])").alias("dest_path"), F.expr("kind = 'created'").alias("is_directory"))

    def placed_sidecars(self) -> DataFrame:
        """The sidecars, in a folder for every user."""
        return self.table("events").select(F.expr("'lib/Série ' || user_id || '/v' || event_id || '.ocr'").alias("rel_path"), F.expr("if(event_id % 13 = 0, left(props, length(props) - 1), props)").alias("json"))

    def file_events(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.expr("'f' || user_id || '/' || event_id % 3 || '.cbz'").alias("path"), F.expr("case event_type when 'signup' then 'created' when 'purchase' then 'created' when 'error' then 'deleted' else 'modified' end").alias("kind"), "ts", F.expr("'l' || user_id").alias("library"))

    def registrations(self) -> DataFrame:
        name = "case event_id % 4 when 0 then 'user_' || user_id when 1 then 'new_' || event_id % 50 when 2 then 'x' else ' new_' || event_id end"
        return self.table("events").select(F.col("event_id").alias("request_id"), F.expr(name).alias("username"), F.expr("cast(event_id % 140 as int)").alias("password_length"), F.expr("if(event_id % 6 = 0, '', 'inv-' || event_id % 3000)").alias("invite_code"))


STEM = "lang || '/' || source || '/v' || lpad(CAST(doc_id AS VARCHAR), 9, '0')"

#: SQL of each relation, and the relations that it needs.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "stems": ((), f"SELECT doc_id, {STEM} AS stem, n_chars FROM documents"),
    "ndocs": ((), "SELECT count(*) AS n FROM documents"),
    "files": (("stems",), "SELECT stem || ext AS rel_path, n_chars AS size, 1704067200 + (doc_id * 7919) % 2592000 AS mtime FROM stems, (VALUES ('.cbz', 11, false), ('.ocr', 3, true), ('.ocr.gz', 5, true), ('.webp', 2, true), ('.nocover', 7, true)) e(ext, m, hit) WHERE (doc_id % m = 0) = hit"),
    "archive_tree": ((), f"SELECT 's/b' || block || '.cbz' AS rel_path, block, doc_id FROM (SELECT doc_id, doc_id // {BLOCK} AS block FROM documents)"),
    "sidecar_tree": ((), f"""SELECT 's/b' || block || CASE WHEN block % 3 = 0 THEN '.ocr' ELSE '.ocr.gz' END AS rel_path, block, '{{"ids":[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']}}' AS json FROM (SELECT doc_id, doc_id // {BLOCK} AS block FROM documents) GROUP BY block"""),
    "user_tree": ((), "SELECT 'user_' || s_suppkey AS username, name AS filename, strlen(s_name) + 11 AS size FROM supplier, (VALUES ('volume-data.json', 1), ('profiles.json', 2), ('notes.json', 3), ('_draft.json', 4)) f(name, m) WHERE s_suppkey % m = 0"),
    "users": ((), "SELECT c_custkey AS id, 'user_' || c_custkey AS username, ['registered','uploader','inviter','editor','admin','writer'][c_custkey % 6 + 1] AS role, ['active','pending','disabled','deleted'][c_nationkey % 4 + 1] AS status, CAST(NULL AS VARCHAR) AS notes, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS updated_at FROM customer"),
    "invites": ((), "SELECT o_orderkey AS id, 'inv-' || o_orderkey AS code, ['registered','uploader','editor','writer'][o_orderkey % 4 + 1] AS role, 'user_' || o_custkey AS invited_by, o_orderdate AS created_at, o_orderdate + to_seconds([3600, 604800, 2592000][o_orderkey % 3 + 1]) AS expires_at, CASE WHEN o_orderstatus = 'F' THEN 'user_' || o_custkey END AS used_by, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS used_at FROM orders"),
    "event_paths": (("stems", "ndocs"), "SELECT e.*, s.stem || '.cbz' AS volume FROM events e CROSS JOIN ndocs JOIN stems s ON s.doc_id = e.event_id % n"),
    "audit": (("event_paths",), "SELECT event_id AS id, 'user_' || user_id AS actor_username, CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'click' THEN 'edit' WHEN 'view' THEN 'move' WHEN 'signup' THEN 'mkdir' ELSE 'delete' END AS action, 'library' AS target_type, '/reader/' || volume AS target_path, CAST(NULL AS VARCHAR) AS target_username, props AS details, ts AS created_at FROM event_paths"),
    "upload_events": (("audit",), "SELECT substr(target_path, 9) AS path, actor_username AS username, created_at AS ts, action = 'edit' AS existed FROM audit WHERE action IN ('upload', 'edit')"),
    "uploads": (("upload_events",), "SELECT path AS volume_key, arg_min(username, (ts, username)) AS uploader_username, min(ts) AS uploaded_at, arg_max(username, (ts, username)) AS last_modified_by, max(ts) AS last_modified_at FROM upload_events GROUP BY path"),
    "attempts": ((), "SELECT event_id AS attempt_id, CAST(user_id AS VARCHAR) AS key, ts, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' ELSE '' END AS outcome FROM events"),
    "requests": (("event_paths",), "SELECT event_id AS request_id, ['GET','HEAD','PROPFIND','OPTIONS','PUT','MKCOL','DELETE','MOVE','LOCK','PROPPATCH'][event_id % 10 + 1] AS method, CASE event_id % 7 WHEN 0 THEN '/reader' WHEN 1 THEN '/reader/' || volume WHEN 2 THEN '/reader/volume-data.json' WHEN 3 THEN '/inbox/x.cbz' WHEN 4 THEN '/_admin/api/users' WHEN 5 THEN '/_admin/api/invites' ELSE '/other' END AS path, CASE WHEN event_id % 5 <> 0 THEN 'user_' || user_id END AS username, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 19 = 0 THEN 'blocked' WHEN event_id % 5 = 0 THEN 'anonymous' ELSE 'ok' END AS auth_state FROM event_paths"),
    "progress": ((), "SELECT conv_id AS job, turn + 1 AS done, max(turn) OVER (PARTITION BY conv_id) + 1 + conv_id % 2 AS total, CAST((turn + 1) * (conv_id % 7 + 1) AS DOUBLE) AS elapsed FROM conversations"),
    "jobs": (("progress", "stems", "ndocs"), "SELECT job, job % 11 = 0 AS broken, job % 3 <> 0 AS active, CASE WHEN job % 2 = 0 THEN upper(stem || '.cbz') ELSE stem || '.cbz' END AS relative_cbz, done AS done_pages, total AS total_pages, CASE WHEN job % 4 = 0 THEN 0 ELSE CAST(job % 100 AS INTEGER) END AS percent, job + 0.5 AS updated_at FROM (SELECT job, max(done) AS done, max(total) AS total FROM progress GROUP BY job) CROSS JOIN ndocs JOIN stems ON doc_id = job % n"),
    "sidecars": ((), "SELECT 's/v' || event_id || '.ocr' AS rel_path, CASE WHEN event_id % 13 = 0 THEN left(props, length(props) - 1) ELSE props END AS json FROM events"),
    "logged": (("requests",), "SELECT 'worker-' || request_id % 8 AS thread, method, path, CASE WHEN auth_state = 'ok' THEN 200 WHEN auth_state = 'anonymous' THEN 401 END AS code, request_id * 37 % 5000 AS elapsed_ms, CASE WHEN auth_state = 'failed' THEN 'AuthError' END AS exception, CASE WHEN auth_state = 'failed' THEN 'bad: ' || path END AS message FROM requests"),
    "changed_paths": ((), "SELECT event_id AS id, 'f' || user_id || '/' || event_id % 3 || e[user_id % 9 + 1] AS path, CASE WHEN event_type <> 'error' THEN 'd/x' || e[event_id % 9 + 1] END AS dest_path, event_type IN ('signup', 'purchase') AS is_directory FROM events, (SELECT ['.cbz', '.CBZ', '.ocr', '.ocr.gz', '.webp', '.txt', '', '.gz.part', '.webpx'] AS e)"),
    "placed_sidecars": ((), "SELECT 'lib/Série ' || user_id || '/v' || event_id || '.ocr' AS rel_path, CASE WHEN event_id % 13 = 0 THEN left(props, length(props) - 1) ELSE props END AS json FROM events"),
    "file_events": ((), "SELECT event_id AS id, 'f' || user_id || '/' || event_id % 3 || '.cbz' AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, ts, 'l' || user_id AS library FROM events"),
    "registrations": ((), "SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'user_' || user_id WHEN 1 THEN 'new_' || event_id % 50 WHEN 2 THEN 'x' ELSE ' new_' || event_id END AS username, event_id % 140 AS password_length, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'inv-' || event_id % 3000 END AS invite_code FROM events"),
    "visible": (("files",), "SELECT *, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS series, regexp_extract(rel_path, '[^/]*$') AS file FROM files WHERE NOT regexp_matches('/' || rel_path, '/[.][^/]*/') AND contains(rel_path, '/')"),
    "volumes": (("visible",), "SELECT series, name, bool_or(ends_with(file, '.cbz')) AS has_cbz, bool_or(file = name || '.ocr') AS has_sidecar, bool_or(ends_with(file, '.ocr.gz')) AS has_sidecar_gz, bool_or(ends_with(file, '.webp')) AS has_cover, bool_or(ends_with(file, '.nocover')) AS no_cover, max(mtime) FILTER (ends_with(file, '.cbz')) AS mtime, CASE WHEN bool_or(ends_with(file, '.webp')) THEN series || '/' || name || '.webp' END AS cover FROM (SELECT *, regexp_replace(file, '(\\.ocr\\.gz|\\.ocr|\\.webp|\\.nocover|\\.cbz)$', '') AS name FROM visible) GROUP BY series, name HAVING bool_or(ends_with(file, '.cbz'))"),
    "waiting": (("volumes",), "SELECT * FROM volumes WHERE has_cbz AND NOT has_sidecar AND NOT has_sidecar_gz"),
}


def with_relations(needs: tuple[str, ...], select: str) -> str:
    """A query over some of the relations, with their SQL in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for need in needs:
        add(need)
    if not order:
        return select
    recursive = select.startswith("WITH RECURSIVE ")
    front = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({SQL[n][1]})" for n in order)
    return f"{front}, {select.removeprefix('WITH ').removeprefix('RECURSIVE ')}" if select.startswith("WITH ") else f"{front} {select}"
