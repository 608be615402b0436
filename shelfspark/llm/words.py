"""Hashes of the words of many texts at once, over the bytes of an Arrow batch.

A word of at most 8 bytes is taken as one number, so two such words of one length never share a hash. Longer ones are
folded 8 bytes at a time through ``mix``, very long ones through BLAKE2b: different words share a hash with a
probability of about 2**-64, whatever their structure, so equal hashes are taken for equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken together; a longer text is taken alone.
CHUNK_BYTES = 500_000
#: Bytes of a text that are hashed at once, which bounds the memory that a very long text takes.
PIECE_BYTES = 2_000_000
#: Words of more bytes than this go through BLAKE2b one by one.
_LONG = 64

_ODD = np.random.default_rng(20240101).integers(1, 2**63, _LONG // 8 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The lowest n bytes of a number, n from 0 to 8.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]

SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.isin(np.arange(256), [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text in that column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets has a last entry for the end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes (lower case) from each start to its end; data has 8 bytes more than the last word needs."""
    sizes = ends - starts
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, 0, (1,))  # the 8 bytes from every place
    out = mix((eight[starts] & _LOW[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _ODD[0])
    rest = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    for k in range(1, _LONG // 8):
        if not len(rest):
            break
        part = eight[starts[rest] + 8 * k] & _LOW[np.minimum(sizes[rest] - 8 * k, 8)]
        out[rest] = mix(out[rest] * _ODD[k] + part)
        rest = rest[sizes[rest] > 8 * k + 8]
    raw = memoryview(data)
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(texts: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a 64-bit hash of every word, A to Z as a to z, and for each text the index of its first word, with the end."""
    data, offsets = text_bytes(texts)
    found, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data):  # the piece ends with a separator or a text
            cut = offsets[min(np.searchsorted(offsets, end), len(offsets) - 1)]
            gap = np.flatnonzero(separators[data[end : end + PIECE_BYTES]])
            if len(gap) or cut <= end + PIECE_BYTES:
                end = min(int(cut), end + int(gap[0]) if len(gap) else len(data))
                break
            end = min(len(data), end + PIECE_BYTES)
        piece = np.zeros(end - at + 8, np.uint8)
        np.take(_LOWER, data[at:end], out=piece[: end - at])
        inside = ~separators[data[at:end]]
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)] - at  # texts that begin within
        start[edges] |= inside[edges]
        stop[edges - 1] |= inside[edges - 1]
        starts = np.flatnonzero(start)
        found.append(_hashes(piece, starts, np.flatnonzero(stop) + 1))
        begins.append(starts + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(begins), offsets)
