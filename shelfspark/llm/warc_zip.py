"""WARC records in ZIP archives: written by tasks, read back by ranges without extraction.

Every task writes archives of its own: a stored member of gzip-per-record WARC
data and a stored index of record places. The archive gets its final name only
when complete, and the manifest lists what finished tasks wrote, so files of lost
or repeated attempts are never read. The reader parses the end records and
central directories (ZIP64 too, and with bytes in front), finds the stored WARC
members and the indexes (JSON lines, or CDX lines that end in JSON, with offset and
length), cuts what they list into ranges, deals the ranges out, and reads each range
on its own. What no index lists is read too: piece by piece, one record in memory.

Files are opened through pyarrow's file systems at the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import flagged, shared_path, stored, table
from shelfspark.shipping import map_arrow

ARCHIVE_BYTES, RANGE_BYTES = 64_000_000, 4_000_000
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.jsonl"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a reader takes at once.
PIECE_BYTES = 1_000_000
#: Names of index members.
_INDEX = re.compile(r"(^|/)[^/]*[.](jsonl|cdx|cdxj)([.]gz)?$")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


# --- writing -----------------------------------------------------------------


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record: a response with its payload, or a revisit that has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = [f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m.group()):02X}', url)}"] if url is not None else []
    revisit = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", *target, *revisit, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ArchiveWriter:
    """Stored ZIP archives below a folder; a new one begins when the last has ARCHIVE_BYTES."""

    def __init__(self, folder: str, archive_bytes: int = ARCHIVE_BYTES):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.uri, self.limit, self.done, self.zip = folder, archive_bytes, [], None
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, key, record: bytes) -> None:
        if self.zip is None:
            self.name, self.at, self.index = f"{uuid.uuid4().hex}.zip", 0, []
            self.file = self.fs.open_output_stream(f"{self.folder}/{self.name}.part")
            self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
            self.member = self.zip.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)
        packed = _gzip(record)
        self.member.write(packed)
        self.index.append(json.dumps({"id": key, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        if self.at >= self.limit:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.member.close()
            self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(self.index))
            self.zip.close()
            self.file.close()
            self.fs.move(f"{self.folder}/{self.name}.part", f"{self.folder}/{self.name}")
            self.done.append((f"{self.uri}/{self.name}", len(self.index), self.at))
            self.zip = None


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per row of pages(page_id, url, html) and return the manifest (archive, records, bytes).

    Null html is an empty payload; of equal payloads the smallest page_id is the response and the others revisit it.
    Rows that repeat the response's page_id, and rows of a group without any page_id, are responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    firsts = stored(pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha")).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first"), "warc-firsts")
    near = flagged(rows, "sha", firsts, "sha", "may")  # payloads that no other row can have stay where they are
    repeats = near.where("may").join(firsts, "sha", "left").select("page_id", "url", "html", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    linked = near.where("not may").select("page_id", "url", "html", "sha", F.lit(None).cast(repeats.schema["refers_to"].dataType).alias("refers_to")).unionAll(repeats)

    def run(batches):
        writer = ArchiveWriter(folder)
        for batch in batches:
            for page_id, url, html, sha, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                writer.add(page_id, warc_record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha)).decode(), refers_to))
        writer.close()
        yield pa.RecordBatch.from_pylist([{"archive": a, "records": n, "bytes": b} for a, n, b in writer.done], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(map_arrow(linked, run, "archive string, records long, bytes long"), "warc-manifest")


# --- reading -----------------------------------------------------------------


def read_at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    return file.read(size)


def _end_record(file, size: int) -> tuple[int, int, int, int]:
    """(members, length of the directory, its place, bytes in front of the archive) from the end records, ZIP64 where there is one."""
    tail_at = max(0, size - 65557)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # these four bytes can be part of the comment too
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    locator = read_at(file, tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] != b"PK\x06\x07":
        return count, length, tail_at + end - length, tail_at + end - length - start
    said = struct.unpack("<Q", locator[8:16])[0]
    # the record lies before its locator; with bytes in front of the archive it is not where the locator says
    before = max(0, tail_at + end - 20 - 65536)
    area = read_at(file, before, tail_at + end - 20 - before)
    place = area.rfind(b"PK\x06\x06")
    while place >= 0 and (place + 56 > len(area) or place + 12 + struct.unpack("<Q", area[place + 4 : place + 12])[0] != len(area)):
        place = area.rfind(b"PK\x06\x06", 0, place)
    if place < 0:
        raise ValueError("no ZIP64 end record before its locator")
    count, length, start = struct.unpack("<3Q", area[place + 32 : place + 56])
    front = before + place - said
    return count, length, start + front, front


def central_directory(file, size: int) -> list[dict]:
    """Members of a ZIP file: name, method, size (stored bytes) and header (place of the local header)."""
    count, length, start, front = _end_record(file, size)
    data, out, at = read_at(file, start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<2I3H", data[at + 20 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:  # 64-bit values, only for the fields that are full, in this order
                wide = io.BytesIO(extra[4 : 4 + n])
                plain = struct.unpack("<Q", wide.read(8))[0] if plain == 0xFFFFFFFF else plain
                packed = struct.unpack("<Q", wide.read(8))[0] if packed == 0xFFFFFFFF else packed
                header = struct.unpack("<Q", wide.read(8))[0] if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out.append({"name": name, "method": method, "size": packed, "header": header + front})
        at += 46 + n_name + n_extra + n_comment
    return out


def member_start(file, member: dict) -> int:
    """Place of a stored member's first byte."""
    head = read_at(file, member["header"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member['name']}")
    return member["header"] + 30 + sum(struct.unpack("<2H", head[26:30]))


def index_lines(file, member: dict) -> Iterator[tuple[str, int, int]]:
    """(file name or "", offset, length) of the lines of an index member that say them; a packed one is unpacked as it is read."""
    unpack = zlib.decompressobj(31) if member["name"].endswith(".gz") else zlib.decompressobj(-15) if member["method"] else None
    start, left, rest = member_start(file, member), member["size"], b""
    while left or rest:
        piece = read_at(file, start, min(left, PIECE_BYTES))
        start, left = start + len(piece), left - len(piece)
        if unpack is not None:
            out = unpack.decompress(piece)
            while unpack.eof and unpack.unused_data:  # gzip members one after another
                again = unpack.unused_data
                unpack = zlib.decompressobj(31)
                out += unpack.decompress(again)
            piece = out
        lines = (rest + piece).split(b"\n")
        rest = lines.pop() if left else b""
        for line in lines:
            try:
                said = json.loads(line[line.index(b"{") :])
                yield str(said.get("filename", "")), int(said["offset"]), int(said["length"])
            except (ValueError, KeyError, TypeError, AttributeError):
                continue  # a header or comment line


def ranges_of(places: list[tuple[int, int]], size: int, range_bytes: int) -> Iterator[tuple[int, list[int]]]:
    """(begin, lengths) that cover a member of ``size`` bytes: records at their (offset, length), gaps between them as pieces of their own."""
    held, begin, total, at = [], 0, 0, 0
    fit = sorted({(offset, length) for offset, length in places if offset >= 0 and 0 < length <= size - offset})
    for offset, length in [*fit, (size, 0)]:
        for n in ([offset - at] if offset > at else []) + ([length] if offset >= at and length else []):
            held.append(n)
            total += n
            at += n
            if total >= range_bytes:
                yield begin, held
                begin, held, total = begin + total, [], 0
    if held:
        yield begin, held


def find_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, member, start, lengths) of the stored WARC members: consecutive records by the indexes; without one the whole member is one
    piece, read as a stream. A file that is no ZIP archive, or whose directory or indexes are broken, gives one row with the archive only."""

    def of(uri: str) -> Iterator[dict]:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as file:
            members = {m["name"]: m for m in central_directory(file, file.size())}
            stored_ = {n: m for n, m in members.items() if not m["method"] and n.endswith((".warc", ".warc.gz"))}
            places: dict[str, list[tuple[int, int]]] = {}
            for m in members.values():
                if _INDEX.search(m["name"]) and m["method"] in (0, 8):
                    for name, offset, length in index_lines(file, m):
                        named = [n for n in stored_ if n.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]] if name else [n for n in stored_ if n == DATA_MEMBER or len(stored_) == 1]
                        for n in named[:1]:
                            places.setdefault(n, []).append((offset, length))
            for n, m in stored_.items():
                start = member_start(file, m)
                for begin, lengths in ranges_of(places.get(n, []), m["size"], range_bytes):
                    yield {"archive": uri, "member": n, "start": start + begin, "lengths": lengths}

    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                try:
                    found = list(of(uri))
                except (ValueError, struct.error, zlib.error):
                    found = [{"archive": uri}]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return map_arrow(archives.select("archive").distinct(), run, "archive string, member string, start long, lengths array<long>")


def records_of(file, start: int, size: int) -> Iterator[bytes]:
    """Records of a piece of a file, read as a stream: gzip members one by one, or uncompressed records by their lengths.

    Bytes that are no record end the piece; they come as one last item that does not begin with ``WARC/``.
    """
    left, held, ready = size, b"", b""
    packed = read_at(file, start, 2) == b"\x1f\x8b"
    unpack = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal start, left, held, ready, unpack
        if packed:
            if not held and left:
                held = read_at(file, start, min(left, PIECE_BYTES))
                start, left = start + len(held), left - len(held)
            if not held:
                return False
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            try:
                ready += unpack.decompress(held)
            except zlib.error:
                left, held = 0, b""
                return False
            held = unpack.unused_data
            return True
        piece = read_at(file, start, min(left, PIECE_BYTES))
        start, left = start + len(piece), left - len(piece)
        ready += piece
        return bool(piece)

    while True:
        while len(ready) < 5 and more():
            pass
        if not ready.strip(b"\r\n"):
            return
        head, seen = -1, 0
        while ready.startswith(b"WARC/") and (head := ready.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(ready)
            if not more():
                break
        said = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", ready[: max(head, 0)])
        if not ready.startswith(b"WARC/") or head < 0 or not said:
            yield b"?" + ready[:100]
            return
        need = head + 4 + int(said[1])
        if len(ready) < need:  # join once, not for every piece
            parts, have = [ready], len(ready)
            ready = b""
            while have < need and more():
                parts.append(ready)
                have, ready = have + len(ready), b""
            ready = b"".join(parts)
        yield ready[:need]
        ready = ready[need:]
        while not ready.lstrip(b"\r\n") and more():
            pass
        ready = ready.lstrip(b"\r\n")


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def parse_record(record: bytes) -> dict:
    """One record of any type.

    record_id, date, url, record_type and refers_to_id as they are written (null where missing); page_id and refers_to are the
    numbers of ``<urn:page:N>`` ids, else null. The payload is the HTTP body of an HTTP block, else the block; a revisit has none,
    and its payload_bytes is what its HTTP headers say (null without). payload_digest is computed, or for a revisit as written;
    digest_ok compares both (null if none is written, or it is not a bare or ``sha1:`` digest). What is no record has the type ``unreadable``.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        return dict.fromkeys(("page_id", "record_id", "date", "url", "refers_to", "refers_to_id", "payload", "payload_bytes", "payload_digest", "digest_ok")) | {"record_type": "unreadable"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type", "").lower() or None
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    is_http = "application/http" in fields.get("content-type", "").lower()
    http, _, body = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    written = fields.get("warc-payload-digest") or ("" if is_http else fields.get("warc-block-digest", ""))
    said = (written.partition(":")[2] if written.lower().startswith("sha1:") else "" if ":" in written else written).upper()
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
    told = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", http)
    out = {"page_id": _page(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "refers_to_id": fields.get("warc-refers-to")}
    if kind == "revisit":
        return out | {"payload": None, "payload_bytes": int(told[1]) if told else None, "payload_digest": said or None, "digest_ok": None}
    return out | {"payload": body, "payload_bytes": len(body), "payload_digest": own, "digest_ok": own == said if said else None}


def read_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives in column ``archive``; ranges are dealt out evenly, whatever archive they are in. An empty list gives no rows.

    A file that is no ZIP archive gives one row of type ``unreadable``; one that is not there is an error. Columns as in parse_record, and
    archive. One record is in memory at a time, with headers of any length.
    """
    spark = archives.sparkSession
    ranges = stored(find_ranges(archives), "warc-ranges")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = [("page_id", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("archive", pa.string()), *([("payload", pa.binary())] if payload else [])]
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["start"] is None:
                    out.append(parse_record(b"") | {"archive": row["archive"]})
                    continue
                fs, path = pafs.FileSystem.from_uri(row["archive"])
                with fs.open_input_file(path) as file:
                    at = row["start"]
                    for n in row["lengths"]:
                        for record in records_of(file, at, n):
                            out.append(parse_record(record) | {"archive": row["archive"]})
                            held += len(record) if payload else 500
                            if held >= RANGE_BYTES:
                                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))
                                out, held = [], 0
                        at += n
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    return map_arrow(ranges.repartition(parts), run, ", ".join(f"{name} {names[kind]}" for name, kind in kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_records(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (
  SELECT *, sha1(payload) AS hex FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(hex, 10 * (k // 8) + 1, 10) AS BIGINT) // CAST(pow(32, 7 - k % 8) AS BIGINT) % 32 AS INTEGER) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CASE WHEN page_id = first THEN true END AS digest_ok
FROM h
"""
