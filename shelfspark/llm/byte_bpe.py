"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file gives every token as bytes. Bytes are written as printable
characters (the usual byte-level table), the merges are derived from the ranks,
and the library encodes the distinct matches of each batch. Offsets of a token are
code points of the text, from the bytes that its tokens have; a token that holds part
of a character covers that character. Decoding looks the bytes of each id up and joins
them before any UTF-8 decoding, so a character that is split over tokens comes back whole.

Map-only: rows stay in their partition and nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import table
from shelfspark.shipping import map_arrow

#: Characters that one call of the library gets, which bounds its memory; longer texts are cut where no match can cross.
CALL_CHARS = 1_000_000
#: Up to here (Latin Extended-B) the regex package agrees with the library on letters, digits and spaces; beyond, Unicode versions differ, and the library splits.
LATIN_END = "\u024f"
#: Characters of distinct matches that a worker remembers.
KEPT_CHARS = 1_500_000
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable, else the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """What a tokenizer of the library needs to merge by these ranks inside one match, and the pattern of the matches, as text."""
    chars = byte_characters()
    written = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (written[token[:i]], written[token[i:]])
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return json.dumps([pattern, {written[t]: r for t, r in ranks.items()}, merges])


class _Kept:
    """Matches that are encoded already: the number of each, and the ids of number k from starts[k] to starts[k + 1]."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number, self.ids, self.starts, self.chars = {}, np.empty(0, np.uint32), np.zeros(1, np.int64), 0

    def add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.chars += sum(map(len, words))


@functools.lru_cache(maxsize=2)
def _loaded(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pattern, vocab, merges = json.loads(spec)
    of = {c: b for b, c in enumerate(byte_characters())}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(of[c] for c in token)
    # matches come once each, so the library's own cache would only cost time
    made = Tokenizer(models.BPE(vocab=vocab, merges=[tuple(m) for m in merges], ignore_merges=True, cache_capacity=0))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    simple, split = regex.compile(pattern), pre_tokenizers.Split(Regex(pattern), "isolated")

    def matches(text: str) -> list[str]:
        if text.isascii() or max(text) <= LATIN_END:
            return simple.findall(text)
        return [piece for piece, _ in split.pre_tokenize_str(text)]

    return made, table, matches, _Kept(), np.array([len(t) for t in table])


def _pieces(text: str) -> list[str]:
    """text cut into pieces of about CALL_CHARS, only between two letters and a space: there a match always begins."""
    out, at = [], 0
    while len(text) - at > CALL_CHARS:
        cut = _CUT.search(text, at + CALL_CHARS)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode_texts(spec: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, in order.

    Matches are encoded separately, so each distinct match of about CALL_CHARS characters goes to the library once;
    they are remembered for later calls, up to KEPT_CHARS characters of them.
    """
    tokenizer, _, matches, kept, lengths = _loaded(spec)

    def flush(held: list[list[str]]) -> Iterator[np.ndarray]:
        words = list(chain.from_iterable(held))
        if kept.chars > KEPT_CHARS:
            kept.clear()
        known = list(map(kept.number.get, words))
        new = list({w for w, k in zip(words, known, strict=True) if k is None})
        if new:
            # one sequence with a word for each match; the tokens of a match have its bytes
            ids = np.array(tokenizer.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            sizes = list(map(len, new)) if "".join(new).isascii() else [len(w.encode()) for w in new]
            kept.add(new, ids, np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1)
            known = list(map(kept.number.__getitem__, words))
        which = np.array(known, np.int64)
        begin = kept.starts[which]
        n = kept.starts[which + 1] - begin
        after = np.cumsum(n)
        ids = kept.ids[np.repeat(begin - after + n, n) + np.arange(after[-1] if len(after) else 0)]
        cuts = np.r_[0, after][np.cumsum([0, *map(len, held)])]
        for a, b in pairwise(cuts.tolist()):
            yield ids[a:b]

    held, chars = [], 0
    for text in texts:
        held.append(list(chain.from_iterable(map(matches, _pieces(text)))))
        chars += len(text)
        if chars >= CALL_CHARS:
            yield from flush(held)
            held, chars = [], 0
    if held:
        yield from flush(held)


def token_offsets(spec: str, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in code points: a token covers every character that it holds a byte of."""
    ends = np.cumsum(_loaded(spec)[4][ids])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    if text.isascii():
        return starts, ends
    character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    return character[starts], character[ends - 1] + 1


def forget(spec: str) -> None:
    """Drops the remembered matches; called when a task ends, as Spark keeps the worker."""
    _loaded(spec)[3].clear()


def decode_ids(spec: str, ids) -> bytes:
    byte_of = _loaded(spec)[1]
    return b"".join(map(byte_of.__getitem__, ids))


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, and with offsets starts and ends array<int> (code points).

    Null text counts as empty and gives no tokens. Rows are taken one by one, so repeated and null ids are
    kept as they are; other columns are ignored; an empty table gives an empty result. Very long texts are encoded
    whole; where they go to the library in pieces, these end where a match must end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                got = list(encode_texts(shared.value, texts))
                columns = [part.column(0), pa.array([i.astype(np.int32) for i in got], pa.list_(pa.int32())), pa.array(list(map(len, got)), pa.int64())]
                if offsets:
                    spans = [token_offsets(shared.value, t, i) for t, i in zip(texts, got, strict=True)]
                    columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "starts", "ends"][: len(columns)])
        forget(shared.value)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, ids array<int>, n_tokens long" + ", starts array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """The columns named in keep, ``bytes`` (the decoded bytes) and ``text`` (null where they are not UTF-8).

    Null ids count as none. An id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    def text_of(b: bytes) -> str | None:
        try:
            return b.decode()
        except UnicodeDecodeError:
            return None

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [decode_ids(shared.value, ids) for ids in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(raw, pa.binary()), pa.array(map(text_of, raw), pa.string())], names=[*keep, "bytes", "text"])

    rows = encoded.select(*keep, F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("__ids"))
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(rows, run, f"{kinds}, bytes binary, text string")


def digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256 per row, and on wish ids: encode, then decode the ids, in one pass.

    offsets_sha256 is of the start and end of every token, as little-endian unsigned 32-bit integers. Cases as in encode.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts, rows, all_ids = part.column(1).to_pylist(), [], []
                for text, ids in zip(texts, encode_texts(shared.value, texts), strict=True):
                    spans = np.stack(token_offsets(shared.value, text, ids), axis=1)
                    rows.append((len(ids), sha(ids.astype("<u4").tobytes()), sha(decode_ids(shared.value, ids.tolist())), sha(spans.astype("<u4").tobytes())))
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                columns = [part.column(0), *[pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(4)]]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, all_ids)]).astype(np.int32)), pa.array(np.concatenate(all_ids))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "ids"][: len(columns)])
        forget(shared.value)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string" + ", ids array<int>" * with_ids)


def public_spec() -> str:
    import public_tokenizers

    return tokenizer_json(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_spec())
