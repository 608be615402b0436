"""Token ids of whole texts, written in ascending document order as range-coded binary files, and read back.

1. The tokenizers library encodes the distinct words of each batch (map-only);
   ids are stored as packed 16-bit integers, so no text is shuffled.
2. A range sort by document deals the rows to tasks; each writes files of consecutive
   documents, so the files in order of their first document hold one stream of ids.
3. A file is blocks of ``range_coder``, then a footer (documents, their lengths, size
   and checksum of each block) and a fixed end. It gets its name only when it is complete,
   and the manifest lists what finished tasks wrote.
4. The reader takes one file a task, checks and decodes blocks side by side, and cuts
   the ids into documents. Where a file begins is a running total over the manifest.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.byte_bpe import CALL_CHARS, LATIN_END, _pieces, byte_characters
from shelfspark.llm.range_coder import BLOCK_IDS, LANES, decode_blocks, encode_blocks
from shelfspark.llm.shared import discard, shared_path, stored, table
from shelfspark.operators.running import running_total
from shelfspark.shipping import map_arrow

#: Ids after which a file ends with the document; three quarters of them are meant for a task.
FILE_IDS = BLOCK_IDS * LANES
MAGIC = b"TOKENID2"
#: Characters of distinct fields that a worker remembers, and of distinct words.
KEPT_CHARS = 5_000_000
_END = struct.Struct("<4QI8s")  # documents, ids, block length, blocks, checksum of the footer, MAGIC


# --- encoding ---------------------------------------------------------------------


class _Kept(dict):
    """Strings that are encoded already: the number of each, and the ids of number k from starts[k] to starts[k + 1].

    A string that is looked up for the first time gets the next number and waits in ``new`` for its ids.
    """

    def __init__(self):
        self.clear()

    def __missing__(self, string: str) -> int:
        self.new.append(string)
        self[string] = number = len(self)
        return number

    def clear(self) -> None:
        super().clear()
        self.new, self.ids, self.starts, self.chars = [], np.empty(0, np.uint32), np.zeros(1, np.int64), 0

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, strings), np.int64, len(strings))

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """The ids of the strings in ``new``, one after the other, and where those of each end."""
        self.starts = np.concatenate([self.starts, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.chars += sum(map(len, self.new))
        self.new = []

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers one after the other, and how many there are up to each."""
        begin = self.starts[which]
        n = self.starts[which + 1] - begin
        after = np.cumsum(n)
        return self.ids[np.repeat(begin - after + n, n) + np.arange(after[-1] if len(after) else 0)], after


@functools.lru_cache(maxsize=2)
def _loaded(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer, pre_tokenizers

    whole, made = Tokenizer.from_str(spec), json.loads(spec)
    lines = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
    lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    suffix = made["model"]["end_of_word_suffix"]
    ends = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
    ends[[i for token, i in made["model"]["vocab"].items() if token.endswith(suffix)]] = True
    pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    find = regex.compile(pattern).findall, regex.compile("\n|" + pattern).findall
    return whole, lines, ends, find, [t["content"] for t in made["added_tokens"]], _Kept(), _Kept()


#: The vocabulary's character for each byte, but a line end, which stands between words.
_WRITTEN = {i: c for i, c in enumerate(byte_characters()) if i != 10}


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")  # far faster than a look at each character
        return True
    except UnicodeEncodeError:
        return max(text) <= LATIN_END


def _learn(spec: str) -> None:
    """The ids of the fields that are new, by the words in them; each new word goes to the library once."""
    _, lines, is_end, (_, find), _, fields, words = _loaded(spec)
    if words.chars > KEPT_CHARS:
        words.clear()
    if not words:
        words["\n"] = 0  # has no ids
        words.add(np.empty(0, np.uint32), np.zeros(1, np.int64))
    of = words.numbers(find("\n".join([*fields.new, ""])))  # the words of each field, and a line end
    if words.new:
        written = "\n".join(words.new).encode().decode("latin-1").translate(_WRITTEN)
        ids = np.array(lines.encode_batch_fast([written], add_special_tokens=False)[0].ids, np.uint32)
        words.add(ids, np.flatnonzero(is_end[ids]) + 1)
    ids, after = words.gather(of)
    fields.add(ids, after[of == 0])


def encode_texts(spec: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, as the library gives them for the whole text without added special tokens.

    Latin text is lowered and cut at white space, which no match of the tokenizer's own pattern crosses. Each distinct field in about
    CALL_CHARS characters is cut into words by that pattern, and each distinct word goes to the library once; its last token is the
    one with the end-of-word suffix. Both are remembered. Texts with other scripts, or with the string of a special token (which the
    library takes as that token), go to the library in pieces that end between words.
    """
    whole, _, _, (words_of, _), special, kept, _ = _loaded(spec)

    def flush(held: list) -> Iterator[np.ndarray]:
        fields = list(chain.from_iterable(x for x in held if isinstance(x, list)))
        if kept.chars > KEPT_CHARS:
            kept.clear()
        known = kept.numbers(fields)
        if kept.new:
            _learn(spec)
        ids, after = kept.gather(known)
        ends, at = np.r_[0, after], 0
        for x in held:
            if isinstance(x, list):
                yield ids[ends[at] : ends[at + len(x)]]
                at += len(x)
            else:
                yield x

    held, chars = [], 0
    for text in texts:
        if _is_latin(text) and not any(s in text for s in special):
            low = text.lower()
            # str.split cuts at four characters that are no white space to the library
            held.append(words_of(low) if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split())
        else:
            held.append(np.concatenate([np.array(e.ids, np.uint32) for e in whole.encode_batch_fast(_pieces(text), add_special_tokens=False)]))
        chars += len(text)
        if chars >= CALL_CHARS:
            yield from flush(held)
            held, chars = [], 0
    if held:
        yield from flush(held)


def encode(docs: DataFrame, spec: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 16-bit) per row; end_id is appended to each document.

    Null text counts as empty. Repeated and null ids stay as they are; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [np.r_[ids, tail].astype("<u2") for ids in encode_texts(shared.value, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, got)), pa.int64()), pa.array([g.tobytes() for g in got], pa.binary())], names=["doc_id", "n_tokens", "ids"])
        for kept in _loaded(shared.value)[-2:]:
            kept.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids binary")


# --- files --------------------------------------------------------------------------


class _Writer:
    """One file at a time below a folder; ids wait until a set of blocks is full."""

    def __init__(self, folder: str, file_ids: int, block: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.uri, self.limit, self.block, self.file, self.done = folder, file_ids, block, None, []
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, row: tuple, ids: bytes) -> None:
        if self.file is None:
            self.name, self.first = f"{uuid.uuid4().hex}.ids", row
            self.file = self.fs.open_output_stream(f"{self.folder}/{self.name}.part")
            self.docs, self.lengths, self.blocks, self.held, self.n_held, self.n_done = [], [], [], [], 0, 0
        self.docs.append(row[0])
        got = np.frombuffer(ids, "<u2")
        self.lengths.append(len(got))
        while len(got):
            part, got = np.split(got, [min(len(got), LANES * self.block - self.n_held)])
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == LANES * self.block:
                self._flush()
        if self.n_done + self.n_held >= self.limit:
            self.close()

    def _flush(self) -> None:
        ids = np.concatenate(self.held)
        for data in encode_blocks(ids, self.block):
            self.file.write(data)
            self.blocks.append((len(data), zlib.crc32(data)))
        self.n_done += self.n_held
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.file is None:
            return
        if self.n_held:
            self._flush()
        lengths = np.array(self.lengths, "<i8")
        footer = b"".join([
            np.array([0 if d is None else d for d in self.docs], "<i8").tobytes(),
            np.array([d is None for d in self.docs], np.uint8).tobytes(),
            lengths.tobytes(),
            np.array(self.blocks, "<u4").reshape(-1, 2).tobytes(),
        ])
        self.file.write(footer + _END.pack(len(self.docs), int(lengths.sum()), self.block, len(self.blocks), zlib.crc32(footer), MAGIC))
        self.file.close()
        self.fs.move(f"{self.folder}/{self.name}.part", f"{self.folder}/{self.name}")
        self.done.append((f"{self.uri}/{self.name}", *self.first, len(self.docs), int(lengths.sum()), sum(b[0] for b in self.blocks)))
        self.file = None


def write_files(encoded: DataFrame, folder: str | None = None, file_ids: int = FILE_IDS, block: int = BLOCK_IDS) -> DataFrame:
    """Write encoded(doc_id, n_tokens, ids binary) in ascending doc_id order and return the manifest: file, first_id, first_row,
    documents, ids, bytes (of the blocks).

    Null ids come first; rows that share an id follow each other in any, but one, order, and may be in different files. A
    document is in one file, which ends with the document that fills it, so a longer document makes a longer file. A block has
    ``block`` ids, the last of a file what is left. No rows, no files.
    """
    spark = encoded.sparkSession
    folder = folder or shared_path(spark, "token-files")
    rows = stored(encoded.select("doc_id", "n_tokens", "ids").withColumn("__row", F.monotonically_increasing_id()), "token-ids")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total * 4 // (file_ids * 3)))

    def run(batches):
        writer = _Writer(folder, file_ids, block)
        for batch in batches:
            for i in range(batch.num_rows):
                writer.add((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py())
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in writer.done], pa.int64() if k else pa.string()) for k in range(6)], names=["file", "first_id", "first_row", "documents", "ids", "bytes"])

    dealt = rows.select("doc_id", "__row", "ids").repartitionByRange(parts, "doc_id", "__row").sortWithinPartitions("doc_id", "__row")
    manifest = stored(map_arrow(dealt, run, "file string, first_id long, first_row long, documents long, ids long, bytes long"), "token-manifest")
    discard(rows)
    return manifest


def _footer(file) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    size = file.size()
    file.seek(max(0, size - _END.size))
    end = file.read()
    if len(end) < _END.size or end[-8:] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, ids, block, blocks, crc, _ = _END.unpack(end)
    length = docs * 17 + blocks * 8
    file.seek(max(0, size - _END.size - length))
    footer = file.read(length)
    if zlib.crc32(footer) != crc:
        raise ValueError("the footer is damaged")
    sizes = np.frombuffer(footer, "<u4", 2 * blocks, docs * 17).reshape(-1, 2)
    return np.frombuffer(footer, "<i8", docs), np.frombuffer(footer, np.uint8, docs, docs * 8), np.frombuffer(footer, "<i8", docs, docs * 9), sizes, ids, block


def ids_of_file(uri: str) -> Iterator[tuple[int | None, int, np.ndarray, bool]]:
    """(document, number in the file, some of its ids, whether they are its last) in order; LANES blocks are in memory at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        docs, null, lengths, blocks, total, block = _footer(file)
        file.seek(0)
        doc, left = 0, int(lengths[0]) if len(lengths) else 0
        for lo in range(0, max(len(blocks), 1), LANES):
            part = blocks[lo : lo + LANES]
            data = [file.read(int(n)) for n, _ in part]
            if wrong := [lo + i for i, (d, (_, crc)) in enumerate(zip(data, part, strict=True)) if zlib.crc32(d) != crc]:
                raise ValueError(f"blocks {wrong} of {uri} are damaged")
            sizes = [min(block, total - (lo + i) * block) for i in range(len(part))]
            ids = np.concatenate([np.empty(0, np.uint16), *decode_blocks(data, sizes)])
            while doc < len(docs) and (left <= len(ids) or len(ids)):
                now, ids = ids[:left], ids[left:]
                left -= len(now)
                yield None if null[doc] else int(docs[doc]), doc, now, left == 0
                if left == 0:
                    doc += 1
                    left = int(lengths[doc]) if doc < len(docs) else 0


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files in manifest(file, first_id, first_row, ids): doc_id, start (ids of all documents before it, in all
    files in order), n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers), and on wish ids array<int>.

    A file without the format's end, or a block whose checksum differs, is an error that names it. No files, no rows.
    """
    order = running_total(manifest.select("file", "first_id", "first_row", "ids"), [], ["first_id", "first_row"], F.col("ids"), "token-starts", "upto")
    files = stored(order.select("file", (F.col("upto") - F.col("ids")).alias("start")), "token-order")
    n = max(1, files.count())

    def run(batches):
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, crc, length, held = [], 0, 0, []
                for doc, _, ids, last in ids_of_file(uri):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    length += len(ids)
                    if with_ids:
                        held.append(ids.astype(np.int32))
                    if last:
                        rows.append((doc, at, length, crc, np.concatenate(held) if with_ids else None))
                        at, crc, length, held = at + length, 0, 0, []
                    if len(rows) >= (100 if with_ids else 20_000):
                        yield made(rows)
                        rows = []
                yield made(rows)

    def made(rows):
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.list_(pa.int32()))] * with_ids
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return map_arrow(files.repartition(n), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def public_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        return file.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(encode(table(spark, sf_dir, "documents"), public_spec(), end_id=1)))
