"""File trees, sidecars and archives as relations. Content is read only where an operator opens it."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import struct
import uuid
import zipfile
import zlib
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import layout, schemas
from shelfspark.functions import paths, scalars
from shelfspark.shared import stored
from shelfspark.shipping import map_arrow
from shelfspark.sources.places import place
from shelfspark.sources.tree import list_tree


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """files(rel_path, size, mtime) below a folder, listed by tasks; folders with a leading dot are not entered."""
    return list_tree(spark, root).select("rel_path", "size", F.floor(F.col("mtime_us") / 1_000_000).alias("mtime"))


def read_manifest(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """files from an inventory table: the way for large libraries, and the exact one."""
    return spark.read.schema(schemas.FILES).format(format).load(path)


def stream_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Stream of file events(path, kind, ts) from JSON files as they appear in a folder or below it, such as those of a watched tree."""
    return spark.readStream.schema(schemas.FILE_EVENTS).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").json(path)


def scan_existing(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that were not processed yet."""
    return files.join(processed.select("rel_path").distinct(), "rel_path", "left_anti")


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_sidecars(spark: SparkSession, root: str, sidecar: str = layout.SIDECAR) -> DataFrame:
    """(rel_path, json, bytes_ok) of sidecars, packed or not; unreadable bytes give a row with bytes_ok false."""
    files = _placed(spark, root, sidecar, f"{sidecar}.gz")

    def run(batches):
        for batch in batches:
            text, ok = [], []
            for rel, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with _opened(uri) as file:
                        content = file.read()
                    text.append((gzip.decompress(content) if rel.endswith(".gz") else content).decode())
                    ok.append(True)
                except (OSError, EOFError, UnicodeDecodeError, zlib.error):
                    text.append(None)
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(ok)], names=["rel_path", "json", "bytes_ok"])

    return map_arrow(files, run, "rel_path string, json string, bytes_ok boolean")


def _parses(text: str | None) -> bool:
    try:
        json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False
    return True


def check_sidecars(sidecars: DataFrame) -> DataFrame:
    """sidecars(rel_path, json) with ``valid`` by Python's JSON parser, which takes NaN and repeated keys."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_parses(t) for t in batch.column(1).to_pylist()], pa.bool_())], names=["rel_path", "json", "valid"])

    return map_arrow(sidecars.select("rel_path", "json"), run, "rel_path string, json string, valid boolean")


def normalize_sidecars(sidecars: DataFrame) -> DataFrame:
    """(rel_path, json) with title, volume and title_uuid set from the place of the volume; other roots and broken text stay as they are."""
    key = F.coalesce(paths.volume_key(F.col("rel_path")), F.col("rel_path"))
    title = paths.series_title(key)
    rows = sidecars.select("rel_path", "json", title.alias("title"), paths.stem_of(paths.name_of(key)).alias("volume"), scalars.title_uuid(title).alias("title_uuid"))

    def run(batches):
        for batch in batches:
            out = []
            for _, text, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = json.loads(text) if _parses(text) else None
                out.append(json.dumps(data | dict(zip(("title", "volume", "title_uuid"), values, strict=True)), ensure_ascii=False, separators=(",", ":")) if isinstance(data, dict) else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rel_path", "json"])

    return map_arrow(rows, run, "rel_path string, json string")


def _placed(spark: SparkSession, root: str, *endings: str) -> DataFrame:
    """(rel_path, uri) of the files below a folder with one of the endings, dealt out evenly; their content is not read."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = list_tree(spark, root).where(reduce(or_, [F.col("rel_path").endswith(e) for e in endings]))
    return found.select("rel_path", F.concat(F.lit(f"{root.rstrip('/')}/"), "rel_path").alias("uri")).repartition(parts)


class _Reader(io.RawIOBase):
    """A file of a file system as Python's readers expect it: a seek before its begin is an OSError."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    seekable = readable

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.size)[whence]
        if at < 0:
            raise OSError("a place before the file")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        found = self.file.read(len(into))
        into[: len(found)] = found
        return len(found)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(uri: str):
    """A seekable file at a URI that Spark listed: readers take the parts that they need."""
    fs, path = place(uri)
    return io.BufferedReader(_Reader(fs.open_input_file(path)), 1 << 16)


def write_files(contents: DataFrame, root: str) -> None:
    """Writes contents(rel_path, content) to files below a folder. A file gets its name when it is whole, so a repeated task leaves the same files."""

    def run(batches):
        for batch in batches:
            for rel, content in zip(batch.column(0), batch.column(1), strict=True):
                fs, path = place(f"{root}/{rel.as_py()}")
                folder = path.rpartition("/")[0]
                fs.create_dir(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_py())
                fs.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["rel_path"])

    map_arrow(contents.select("rel_path", "content"), run, "rel_path string").write.format("noop").mode("overwrite").save()


def move_files(moves: DataFrame, root: str) -> None:
    """Moves the files of moves(rel_path, to) below a folder; those without a ``to`` are removed. Files that are not there (any more) are
    left out, so a task may be repeated."""

    def run(batches):
        for batch in batches:
            for rel, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = place(f"{root}/{rel}")
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    continue
                if to is None:
                    fs.delete_file(path)
                else:
                    _, target = place(f"{root}/{to}")
                    fs.create_dir(target.rpartition("/")[0])
                    fs.move(path, target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["rel_path"])

    map_arrow(moves.select("rel_path", "to"), run, "rel_path string").write.format("noop").mode("overwrite").save()


#: What opening or reading a broken archive raises.
_BROKEN = (zipfile.BadZipFile, OSError, ValueError, EOFError, RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError)
_MEMBER = ("member", "method", "flags", "crc", "packed", "size", "offset")


def _directories(files: DataFrame) -> DataFrame:
    """(rel_path, uri, opens, member, method, flags, crc, packed, size, offset): a row for each member in the directory of each archive,
    one without a member for an archive that has none or does not open. No member is read."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 6]
        for batch in batches:
            for rel, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(uri) as file:
                    try:
                        found = [(rel, uri, True, i.orig_filename, i.compress_type, i.flag_bits, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in zipfile.ZipFile(file).infolist()]
                        opens = True
                    except _BROKEN:
                        found, opens = [], False
                found = found or [(rel, uri, opens, *[None] * 7)]
                for lo in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[lo : lo + 10_000], strict=True), kinds, strict=True)], names=["rel_path", "uri", "opens", *_MEMBER])

    return map_arrow(files, run, "rel_path string, uri string, opens boolean, member string, method long, flags long, crc long, packed long, size long, offset long")


def read_archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, member) of the volumes below a folder; a broken archive has no members. Only the directory of an archive is read."""
    return _directories(_placed(spark, root, layout.VOLUME)).where("member is not null").select("rel_path", "member")


def _holds(file, member: str, method: int, flags: int, crc: int, packed: int, size: int, offset: int) -> bool:
    """Whether a member is where its archive says, unpacks to its size and has its checksum; it is read as a stream."""
    file.seek(offset)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04" or flags & 0x41:  # encrypted ones cannot be read
        return False
    name, extra = struct.unpack("<HH", head[26:])
    told = file.read(name)
    if told != member.encode("utf-8" if struct.unpack("<H", head[6:8])[0] & 0x800 else "cp437", "replace"):
        return False
    file.seek(offset + 30 + name + extra)
    info = zipfile.ZipInfo(member)
    info.compress_type, info.CRC, info.compress_size, info.file_size = method, crc, packed, size
    with zipfile.ZipExtFile(file, "r", info) as content:
        while content.read(1 << 18):
            pass
    return True


def valid_archives(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, valid): whether each volume opens and all checksums of its members hold.

    The members of all archives are dealt out by what their directories say, so many tasks share a large archive; a member is a stream
    of one task.
    """
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = stored(_directories(_placed(spark, root, layout.VOLUME)), "archive-members")

    def run(batches):
        for batch in batches:
            good = []
            for uri, *member in zip(*(batch.column(c).to_pylist() for c in ("uri", *_MEMBER)), strict=True):
                try:
                    with _opened(uri) as file:
                        good.append(_holds(file, *member))
                except _BROKEN:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(good, pa.bool_())], names=["rel_path", "valid"])

    checked = map_arrow(listed.where("member is not null").repartition(parts), run, "rel_path string, valid boolean")
    return checked.unionAll(listed.where("member is null").select("rel_path", "opens")).groupBy("rel_path").agg(F.bool_and("valid").alias("valid"))


def scan_user_files(spark: SparkSession, root: str) -> DataFrame:
    """(username, filename, size, mtime) of the per-user files."""
    files = scan_files(spark, root)
    return files.select(F.regexp_extract("rel_path", r"^([^/]+)/([^/]+)\z", 1).alias("username"), F.regexp_extract("rel_path", r"^([^/]+)/([^/]+)\z", 2).alias("filename"), "size", "mtime").where(F.col("filename").isin(*layout.PER_USER_FILES))
