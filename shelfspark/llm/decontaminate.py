"""Benchmark decontamination by suffix arrays of the training text.

The documents are dealt into shards of about SHARD_WORDS words. For every shard the suffix array of all its words is
built (prefix doubling in numpy) and stored, with the words, in the shared folder. Every suffix of every test item is
then looked up in every shard: its range of the array is narrowed word by word by binary search. A suffix whose range
is not empty after a window's words occurs there; its range is narrowed on until the longest verbatim match with each
document is known. Matched places become word ranges of the document, and affected documents can be dropped.

A window is 10 consecutive words of an item; an item with fewer words is one window. The benchmark is the stated query
set: tasks cut its items into pieces, which overlap by a window less one word like the segments of long texts, and blocks of
pieces are searched one after the other, each sent to the executors by broadcast and freed again. A match that touches a
cut is put together with what goes on behind it: both lie on one diagonal (place in the text less place in the item).
Building and searching are map-only; only what is found is shuffled, by the row's own number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import discard, keyed, own_names, stored, table, without
from shelfspark.llm.words import NOT_ALNUM, chunks, word_hashes
from shelfspark.operators.running import running_total
from shelfspark.shipping import map_arrow

WINDOW = 10
#: Bytes of test words that are broadcast at once, eight for each hash; they take about four times that in a worker.
BLOCK_BYTES = 8_000_000
#: Words of a piece of a test item.
PIECE_WORDS = 2**16
#: Words of a shard. A document with more is cut into segments, which overlap by a window less one word.
SHARD_WORDS = 2**19  # less than 2**23, as places have three bytes
#: Places of matches that are listed at once.
PLACES = 2**20


# --- the suffix array of a shard ---------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of the words of text (numbers from 1; 0 ends a segment, and the text), ordered by the words from there to the segment's end; ties by place.

    Prefix doubling: a round orders suffixes by twice as many words as the one before, and takes only those that are not
    alone in their group yet.
    """
    stops = np.flatnonzero(text == 0)
    places = np.flatnonzero(text)
    left = np.zeros(len(text), np.int64)
    left[places] = stops[np.searchsorted(stops, places)] - places
    rank = np.zeros(len(text) + 1, np.int64)  # one more than the first place of the group in the order
    live, base, key, depth = places, np.ones(len(places), np.int64), text[places].astype(np.int64), 0
    while len(live):
        order = np.argsort(key)
        live, base, key = live[order], base[order], key[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begin, len(live)])
        old = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        own_old = old[np.searchsorted(old, begin, "right") - 1]
        rank[live] = np.repeat(base[begin] + begin - own_old, sizes)
        depth = 2 * depth or 1
        more = np.logical_or.reduceat(left[live] > depth, begin)
        live = live[np.repeat((sizes > 1) & more, sizes)]
        base = rank[live]
        key = (base << 32) | np.where(left[live] > depth, rank[np.minimum(live + depth, len(text))], 0)
    return places[np.argsort(rank[places], kind="stable")]


class Shard:
    """The words of some segments, numbered within the shard, and their suffix array."""

    def __init__(self, rows, starts, bounds, more, vocabulary, text, suffixes):
        #: For each segment the row that it is of, its first word in the row's text, its place in ``text``, and whether the text goes on.
        self.rows, self.starts, self.bounds, self.more = rows, starts, bounds, more
        self.vocabulary, self.text, self.suffixes = vocabulary, text, suffixes

    KINDS = (("rows", np.int64), ("starts", np.int64), ("bounds", np.int64), ("more", np.uint8), ("vocabulary", np.uint64), ("text", np.int32), ("suffixes", np.int32))
    #: Numbers of words and places are stored in three bytes, byte place by byte place, which packs well.
    SMALL = 3

    @classmethod
    def of(cls, segments: list[tuple[int, int, np.ndarray, bool]]) -> Shard:
        """The shard of segments (row, first word, hashes of the words, whether the text goes on)."""
        sizes = np.array([len(w) for _, _, w, _ in segments])
        vocabulary, number = np.unique(np.concatenate([w for _, _, w, _ in segments]), return_inverse=True)
        text = np.zeros(len(number) + len(segments), np.int32)
        text[np.arange(len(number)) + np.repeat(np.arange(len(segments)), sizes)] = number + 1
        bounds = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        return cls(np.array([r for r, _, _, _ in segments]), np.array([s for _, s, _, _ in segments]), bounds, np.array([m for _, _, _, m in segments], np.uint8), vocabulary, text, suffix_array(text).astype(np.int32))

    def packed(self) -> list[bytes]:
        parts = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.KINDS]
        return [part.view(np.uint8).reshape(-1, 4)[:, : self.SMALL].T.tobytes() if kind is np.int32 else part.tobytes() for part, (_, kind) in zip(parts, self.KINDS, strict=True)]

    @classmethod
    def unpacked(cls, parts) -> Shard:
        out = []
        for part, (_, kind) in zip(parts, cls.KINDS, strict=True):
            if kind is np.int32:
                planes = np.frombuffer(part, np.uint8).reshape(cls.SMALL, -1)
                wide = np.zeros((planes.shape[1], 4), np.uint8)
                wide[:, : cls.SMALL] = planes.T
                out.append(wide.view(np.int32).ravel())
            else:
                out.append(np.frombuffer(part, kind))
        return cls(*out)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range [lo, hi) of suffixes that agree in ``depth`` words the part whose next word is this one."""
        depth = np.broadcast_to(depth, lo.shape)
        out = []
        for right in (False, True):
            a, b = (lo if not right else out[0]).copy(), hi.copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                middle = (a[open_] + b[open_]) >> 1
                there = self.text[self.suffixes[middle] + depth[open_]]
                before = there <= word[open_] if right else there < word[open_]
                a[open_[before]] = middle[before] + 1
                b[open_[~before]] = middle[~before]
                open_ = open_[a[open_] < b[open_]]
            out.append(a)
        return out[0], out[1]


# --- looking test suffixes up ---------------------------------------------------------


class TestSuffixes:
    """The suffixes of a block of pieces of test items; a suffix counts if a window begins with it."""

    __test__ = False

    def __init__(self, pieces: list[tuple], window: int = WINDOW):
        """pieces(item, text, first word in the item, whether the item goes on, hashes of the words)."""
        sizes = np.array([len(p[4]) for p in pieces], np.int64)
        words = np.concatenate([np.empty(0, np.uint64), *[p[4] for p in pieces]])
        self.items, self.texts = [p[0] for p in pieces], [p[1] for p in pieces]
        self.first, self.more = np.array([p[2] for p in pieces], np.int64), np.array([p[3] for p in pieces], bool)
        self.distinct, number = np.unique(words, return_inverse=True)
        self.number = number.astype(np.int32)
        self.owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        self.end = np.cumsum(sizes).astype(np.int32)
        self.begin = (self.end - sizes).astype(np.int32)
        self.need = np.minimum(window, sizes).astype(np.int32)

    @classmethod
    def of_texts(cls, item_ids: list, texts: list[str], window: int = WINDOW) -> TestSuffixes:
        words, first = word_hashes(pa.array(texts, pa.string()), NOT_ALNUM)
        return cls([(item, n, 0, False, words[first[n] : first[n + 1]]) for n, item in enumerate(item_ids)], window)


def cut(size: int, most: int, window: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of at most so many words that overlap by a window less one word."""
    at = 0
    while at < size:
        stop = min(size, at + most)
        yield at, stop
        at = stop if stop == size else max(at + 1, stop - window + 1)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): all numbers of the ranges [lo, hi), and which range each is of."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) if len(lo) else which


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the beginning are the same."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        other = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(other):
            return at + int(other[0])
        at, step = at + step, 4 * step
    return n


class _Longest:
    """The longest match, and its first place, for each (segment, item)."""

    def __init__(self, items: int):
        self.items, self.held, self.n = items, [], 0

    def add(self, segment, item, length, place) -> None:
        self.held.append(np.stack([segment.astype(np.int64) * self.items + item, -np.broadcast_to(length, segment.shape).astype(np.int64), place.astype(np.int64)]))
        self.n += len(segment)
        if self.n > 4 * PLACES:
            self.held = [self.reduced()]
            self.n = self.held[0].shape[1]

    def reduced(self) -> np.ndarray:
        if not self.held:
            return np.empty((3, 0), np.int64)
        rows = np.concatenate(self.held, axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
        return rows[:, np.r_[True, rows[0, 1:] != rows[0, :-1]]]


def search(shard: Shard, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranges, matches, edges) of one shard: columns (segment, start, end) of merged hit words, columns (segment, piece, longest, start), and
    columns (segment, piece, place in the piece, start, length) of the matches that touch a cut of the text or of the item."""
    none = np.empty((3, 0), np.int64), np.empty((4, 0), np.int64), np.empty((5, 0), np.int64)
    if not len(shard.suffixes) or not len(tests.number):
        return none
    at = np.minimum(np.searchsorted(shard.vocabulary, tests.distinct), len(shard.vocabulary) - 1)
    words = np.where(shard.vocabulary[at] == tests.distinct, at + 1, -1).astype(np.int32)[tests.number]
    place = np.arange(len(words))
    end, need = tests.end[tests.owner], tests.need[tests.owner]
    missing = np.r_[0, np.cumsum(words < 0)]
    j = place[(end - place >= need)]
    j = j[missing[j + need[j]] == missing[j]]
    edge = np.r_[0, np.cumsum(np.bincount(shard.text[shard.suffixes], minlength=len(shard.vocabulary) + 1))]
    lo, hi = edge[words[j]], edge[words[j] + 1]
    for depth in range(1, int(tests.need.max())):
        more = np.flatnonzero(need[j] > depth)
        if len(more):
            lo[more], hi[more] = shard.narrow(lo[more], hi[more], depth, words[j[more] + depth])
        keep = lo < hi
        j, lo, hi = j[keep], lo[keep], hi[keep]
    if not len(j):
        return none
    # a window that many items share is one range
    _, one = np.unique(lo * (int(need.max()) + 1) + need[j], return_index=True)
    cover = np.zeros(len(shard.text) + 1, np.int64)
    for k in range(0, len(one), 4096):
        part = one[k : k + 4096]
        which, at = _expand(lo[part], hi[part])
        begins = shard.suffixes[at]
        cover += np.bincount(begins, minlength=len(cover)) - np.bincount(begins + need[j[part]][which], minlength=len(cover))
    hit = np.r_[False, np.cumsum(cover[:-1]) > 0, False]
    turn = np.flatnonzero(hit[1:] != hit[:-1])
    begin, stop = turn[::2], turn[1::2]
    segment = np.searchsorted(shard.bounds, begin, "right") - 1
    ranges = np.stack([segment, begin - shard.bounds[segment], stop - shard.bounds[segment]])

    longest, edges = _Longest(len(tests.items)), []
    stops = np.flatnonzero(shard.text == 0)
    may_cut = shard.more.any() or (shard.starts > 0).any() or tests.more.any()

    def touching(segment, piece, j, found, depth):
        """Keeps the matches at a cut."""
        left = (found == shard.bounds[segment]) & (shard.starts[segment] > 0) | (j == tests.begin[piece]) & (tests.first[piece] > 0)
        right = (found + depth == stops[segment]) & (shard.more[segment] > 0) | (j + depth == tests.end[piece]) & tests.more[piece]
        at = np.flatnonzero(left | right)
        if len(at):
            segment, piece = segment[at], piece[at]
            edges.append(np.stack([segment, piece, j[at] - tests.begin[piece], found[at] - shard.bounds[segment], depth[at]]).astype(np.int64))

    def record(j, lo, hi, depth):
        cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(hi - lo) // PLACES)) + 1, len(lo)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            for a in range(0, int((hi[x:y] - lo[x:y]).max(initial=0)), PLACES):
                which, at = _expand(np.minimum(lo[x:y] + a, hi[x:y]), np.minimum(lo[x:y] + a + PLACES, hi[x:y]))
                found = shard.suffixes[at]
                segment, piece, length = np.searchsorted(shard.bounds, found, "right") - 1, tests.owner[j[x:y]][which], depth[x:y][which]
                longest.add(segment, piece, length, found)
                if may_cut:
                    touching(segment, piece, j[x:y][which], found, length)

    depth, first = need[j].astype(np.int64), True
    while len(j):
        inside = np.flatnonzero(j + depth < end[j])
        below, above = lo.copy(), lo.copy()
        below[inside], above[inside] = shard.narrow(lo[inside], hi[inside], depth[inside], words[(j + depth)[inside]])
        # where the suffix before this one, one word longer, occurs as often, its matches hold those of this one
        held = np.r_[False, (j[1:] == j[:-1] + 1) & (tests.owner[j[1:]] == tests.owner[j[:-1]]) & ((above - below)[:-1] == (hi - lo)[1:])]
        keep = ~held
        j, lo, hi, below, above, depth = j[keep], lo[keep], hi[keep], below[keep], above[keep], depth[keep]
        record(np.r_[j, j], np.r_[lo, above], np.r_[below, hi], np.r_[depth, depth])
        keep = below < above
        j, lo, hi, depth = j[keep], below[keep], above[keep], depth[keep] + 1
        if not first:
            alone = hi - lo == 1
            for k in np.flatnonzero(alone).tolist():
                depth[k] += _agree(words[j[k] + depth[k] : end[j[k]]], shard.text[shard.suffixes[lo[k]] + depth[k] :])
            record(j[alone], lo[alone], hi[alone], depth[alone])
            j, lo, hi, depth = j[~alone], lo[~alone], hi[~alone], depth[~alone]
        first = False
    key, length, found = longest.reduced()
    segment = key // len(tests.items)
    return ranges, np.stack([segment, key % len(tests.items), -length, found - shard.bounds[segment]]), np.concatenate([none[2], *edges], axis=1)


# --- the job ----------------------------------------------------------------------------


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, window: int = WINDOW) -> DataFrame:
    """The stored index of docs: a row (row, doc_id, n_words) for each row of docs, and the shards (rows to suffixes, packed) with null there."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        held, n = [], 0
        id_type = None

        def flush() -> pa.RecordBatch:
            parts = Shard.of(held).packed()
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], names=names)

        for batch in batches:
            id_type = batch.column(1).type
            for part in chunks(batch, 2):
                words, first = word_hashes(part.column(2), NOT_ALNUM)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first), pa.int64()), *[pa.nulls(len(part), pa.binary()) for _ in Shard.KINDS]], names=names)
                for row, lo, hi in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for at, stop in cut(hi - lo, shard_words, window):
                        held.append((row, at, words[lo + at : lo + stop], stop < hi - lo))
                        n += stop - at
                        if n >= shard_words:
                            yield flush()
                            held, n = [], 0
        if held:
            yield flush()

    names = ["row", "doc_id", "n_words", *[name for name, _ in Shard.KINDS]]
    return stored(map_arrow(rows, run, f"row long, doc_id {kind}, n_words long, " + ", ".join(f"{name} binary" for name, _ in Shard.KINDS)), "suffix-index")


def _pieces(benchmark: DataFrame, item_col: str, item_text: str, window: int, piece_words: int) -> DataFrame:
    """item_id, text (a number of its own for every text), first, more, words (hashes) of the pieces of all items, cut by tasks."""
    items = benchmark.select(F.monotonically_increasing_id().alias("text"), F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("value"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2):
                words, first = word_hashes(part.column(2), NOT_ALNUM)
                rows = [(text, item, a, b < hi - lo, words[lo + a : lo + b].tobytes()) for text, item, lo, hi in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True) for a, b in cut(hi - lo, piece_words, window)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "item_id", "first", "more", "words"])

    return map_arrow(items, run, "text long, item_id string, first long, more boolean, words binary")


_EDGES = "array<struct<item_id:string,text:long,diagonal:long,start:long,end:long>>"


def _joined(parts: DataFrame) -> DataFrame:
    """row, items: the longest match of a row and item among those put together from matches that touch a cut."""
    each = parts.select("row", F.explode("edges").alias("e")).select("row", "e.*").distinct()
    along = each.groupBy("row", "item_id", "text", "diagonal").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def grow(acc, x):
        start = F.when(x["start"] <= acc["end"], acc["start"]).otherwise(x["start"])
        end = F.when(x["start"] <= acc["end"], F.greatest(acc["end"], x["end"])).otherwise(x["end"])
        best = F.greatest(acc["best"], F.struct((end - start).alias("longest"), (-start).alias("less")))
        return F.struct(start.alias("start"), end.alias("end"), best.alias("best"))

    long = lambda n: F.lit(n).cast("long")
    zero = F.struct(long(-1).alias("start"), long(-1).alias("end"), F.struct(long(0).alias("longest"), long(0).alias("less")).alias("best"))
    best = along.select("row", "item_id", F.aggregate("spans", zero, grow)["best"].alias("best")).groupBy("row", "item_id").agg(F.max("best").alias("best"))
    return best.select("row", F.array(F.struct("item_id", F.col("best.longest").alias("longest"), (-F.col("best.less")).alias("start"))).alias("items"))


def search_index(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """row, ranges, items for the rows of an index with a window of the benchmark; window is at most that of the index.

    A block has at most block_bytes and a piece of words; the driver holds one block at a time.
    """
    spark = index.sparkSession
    pieces = stored(_pieces(benchmark, item_col, item_text, window, piece_words), "benchmark-pieces")
    numbered = stored(running_total(pieces, [], ["text", "first"], F.octet_length("words"), "benchmark-order", "upto").withColumn("block", F.floor((F.col("upto") - F.octet_length("words")) / block_bytes)), "benchmark-blocks")
    shards = index.where("suffixes is not null").select(*[name for name, _ in Shard.KINDS])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    named = pa.list_(pa.struct([("item_id", pa.string()), ("longest", pa.int64()), ("start", pa.int64())]))
    cuts = pa.list_(pa.struct([("item_id", pa.string()), ("text", pa.int64()), ("diagonal", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(shard: Shard, tests: TestSuffixes) -> Iterator[pa.RecordBatch]:
        ranges, matches, edges = search(shard, tests)
        rows: dict[int, tuple[list, list, list]] = {}
        for segment, start, end in ranges.T.tolist():
            rows.setdefault(segment, ([], [], []))[0].append({"start": start + int(shard.starts[segment]), "end": end + int(shard.starts[segment])})
        for segment, piece, length, start in matches.T.tolist():
            rows[segment][1].append({"item_id": tests.items[piece], "longest": length, "start": start + int(shard.starts[segment])})
        for segment, piece, at, start, length in edges.T.tolist():
            begin = start + int(shard.starts[segment])
            rows[segment][2].append({"item_id": tests.items[piece], "text": tests.texts[piece], "diagonal": begin - at - int(tests.first[piece]), "start": begin, "end": begin + length})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(shard.rows[list(rows)]), *[pa.array([r[k] for r in rows.values()], kind) for k, kind in enumerate((spans, named, cuts))]], names=["row", "ranges", "items", "edges"])

    def searched(block: int) -> DataFrame:
        own = numbered.where(F.col("block") == block).collect()  # at most a block of the query set
        sent = spark.sparkContext.broadcast(TestSuffixes([(r["item_id"], r["text"], r["first"], r["more"], np.frombuffer(r["words"], np.uint64)) for r in own], window))

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from found(Shard.unpacked([column[k].as_buffer() for column in batch.columns]), sent.value)

        out = stored(map_arrow(shards, run, f"row long, ranges array<struct<start:long,end:long>>, items array<struct<item_id:string,longest:long,start:long>>, edges {_EDGES}"), "benchmark-found")
        sent.destroy()
        return out

    def merge(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end")))
        return F.when((F.size(acc) > 0) & (last["end"] >= r["start"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), longer)).otherwise(F.concat(acc, F.array(r)))

    blocks = sorted(r["block"] for r in numbered.select("block").distinct().collect())
    parts = reduce(DataFrame.unionAll, [searched(b) for b in blocks or [0]])
    discard(pieces, numbered)
    # segments of one row, pieces and texts of one item and blocks meet here: as many parts as a row has of them
    whole = parts.drop("edges").unionByName(_joined(parts), allowMissingColumns=True)
    once = whole.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    one_range = F.when(F.col("n") == 1, F.col("ranges")).otherwise(F.aggregate("ranges", F.array().cast("array<struct<start:bigint,end:bigint>>"), merge))
    # of the entries of an item, sorted by length, the last
    longest = F.filter("items", lambda x, i: (i == F.size("items") - 1) | ~F.get("items", i + 1)["item_id"].eqNullSafe(x["item_id"]))
    return once.select("row", one_range.alias("ranges"), longest.alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """doc_id, n_words, ranges array<struct<start, end>> of hit words, items array<struct<item_id string, longest, start>>.

    One row per row of docs, whatever its id. Null text has no words, in documents and items alike; items without words match
    nothing; items that repeat an id are one item. An empty benchmark hits nothing. Other columns are ignored. ``longest`` is
    the longest verbatim match in words, ``start`` its first word in the document (one of them where several are as long).
    Texts and items of any length are taken whole: a match may cross the cuts of both. The index is deleted when it is searched.
    """
    index = build_index(docs, id_col, text_col, shard_words, window)
    found = search_index(index, benchmark, item_col, item_text, window, block_bytes, piece_words)
    rows = stored(index.where("row is not null").select("row", "doc_id", "n_words"), "contamination-rows")
    discard(index)
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return rows.join(found, "row", "left").select("doc_id", "n_words", none("ranges"), none("items"))


def longest_matches(found: DataFrame) -> DataFrame:
    """item_id, longest, doc_id, start: for every item of find_contamination's result its longest match in the corpus and where it is; ties to the smallest id."""
    each = found.select("doc_id", F.explode("items").alias("i")).select("i.*", "doc_id")
    best = each.groupBy("item_id").agg(F.min(F.struct((-F.col("longest")).alias("less"), "doc_id", "start")).alias("b"))
    return best.select("item_id", (-F.col("b.less")).alias("longest"), "b.doc_id", "b.start")


@own_names
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any benchmark window; all columns stay. Rows are decided one by one, whatever their ids. Only rows
    that a bitmap of the contaminated ones flags are shuffled."""
    rows, key = keyed(docs, id_col, "contamination-docs")
    index = build_index(rows, key, text_col)
    hit = search_index(index, benchmark, block_bytes=block_bytes).select("row").join(index.where("row is not null").select("row", "doc_id"), "row").select(F.col("doc_id").alias(key))
    gone = stored(hit, "contamination-hits")
    discard(index)
    return without(rows, key, gone).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    names = F.array_sort(F.transform("items", lambda i: i["item_id"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p + 1 : p + least(len(w), 10)], ' ') AS s
  FROM i, LATERAL (SELECT unnest(range(len(w) - least(len(w), 10) + 1)) AS p) WHERE len(w) > 0
), lens AS (
  SELECT DISTINCT n FROM win
), m AS (
  SELECT doc_id, p, c.n, item_id FROM (
    SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS s FROM d, lens, LATERAL (SELECT unnest(range(len(w) - n + 1)) AS p) WHERE len(w) >= n
  ) c JOIN win USING (n, s)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM m) x, LATERAL (SELECT unnest(range(x.p, x.p + x.n)) AS q) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
