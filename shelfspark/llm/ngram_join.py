"""N-gram Jaccard join over count vectors.

The tokens of a document are the hashes of its word shingles. They are hashed
into groups twice:

* For finding candidates, sets of a size band get k + 1 or more groups, k being the most
  tokens by which two linked sets of the band differ. At least one group is then
  the same in both, so sets that can link share a (group, content) key. Sets that
  share keys form candidate groups. Tokens that many documents share stay out of
  the keys as long as enough groups remain. This stands in front of the R-tree because no
  order of so many dimensions keeps distant points apart: a tree over all
  documents would compare nearly every leaf with every other.
* For the join inside a candidate group, group counts are points of an R-tree.
  Sum of coordinate minima bounds the overlap of two points, and of a point and
  a node of any level (by the node's maxima and sizes). Only pairs that pass all
  bounds are verified on the token sets.

Sets that are equal are one point, so copies cost nothing. A candidate group with
more points than one task takes is split by another hash, then by rare tokens: of
two linked sets, the rarest fifth (or so) of the tokens of each share one. What
is still larger is linked to its most central set; pairs inside that component
need no test, and the rest meets the group block by block, a bounded number of
pairs of blocks at a time.

One row per document leaves: its set size and the smallest id that links reach.
Pairs are never expanded, and nothing but single figures reaches the driver.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfspark.llm.components import connected_components, forest
from shelfspark.llm.shared import discard, flagged, keyed, numbered, own_names, stored, table, without
from shelfspark.llm.words import SPACES, chunks, mix, word_hashes
from shelfspark.shipping import map_arrow

#: Points of a candidate group that one task joins, and of a block where there are more; and shingles of both, which bound the bytes.
BLOCK, UNIT_TOKENS = 256, 2**22
#: Where a group meets block by block: times BLOCK that such a block has, with half of UNIT_TOKENS at most, for each block is sent to a
#: task once for every block that it meets; and pairs of blocks that are sent at once, if these are not more than half of the blocks.
MEET_BLOCKS, MEET_PAIRS = 8, 64
#: Bits of the hash by which the sets with a token are counted. A count decides how many candidates there are, never which links are found.
OFTEN_BITS, OFTEN_PARTS = 20, 64
#: Keys that a task holds before it writes them, and that a partition gets.
HELD_KEYS, PARTITION_KEYS = 1_000_000, 1_000_000
#: Hash attempts of a set that leaves too many groups empty.
SALTS = 4
#: Tokens that so many documents of a task, and of the corpus, have count as common; no more than MOST_COMMON of them, the
#: most frequent. Which tokens these are decides how many candidates there are, never which links are found.
COMMON_IN_TASK, COMMON, MOST_COMMON = 4, 24, 65536
#: Counts beyond this do not matter when the fullest groups are chosen.
FULLEST = 6

_ODD = np.random.default_rng(20240202).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- token sets -----------------------------------------------------------------


def token_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): the sorted distinct shingle hashes of every text one after another, and where each text's begin, with the end."""
    words, first = word_hashes(texts, SPACES)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = first[doc + 1] - np.arange(len(words)) if len(words) else np.empty(0, np.int64)
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        part = words[k:] * _ODD[k]
        total[: len(part)] += np.where(left[: len(part)] > k, part, np.uint64(0))
    take = (left >= width) | ((counts[doc] < width) & (np.arange(len(words)) == first[doc]))
    tokens = mix(total[take] + np.minimum(left[take], width).astype(np.uint64))
    doc = doc[take]
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    if len(tokens):
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])]
        tokens, doc = tokens[new], doc[new]
    return tokens, np.searchsorted(doc, np.arange(len(counts) + 1))


@functools.lru_cache(maxsize=64)
def _bands(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, most, groups) of the size bands up to top: a linked pair's smaller set has a size in [low, next low), both have at most high, and they differ by at most ``most`` tokens."""
    lows = [1]
    while lows[-1] <= top:
        lows.append(max(lows[-1] + 1, lows[-1] * 7 // 5))
    last = np.array(lows[1:]) - 1
    high = last * den // num
    most = (last + high) * (den - num) // (den + num)
    return np.array(lows[:-1]), high, most, np.where(most == 0, 1, most + 2 + most * 2 // 5)


def group_keys(tokens: np.ndarray, first: np.ndarray, num: int, den: int, seed: int = 0, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text): the candidate keys of every non-empty set, and the number of its text.

    Of its groups a set names the fullest, down to the largest count that more than ``most`` groups have. Of two linked
    sets, take the one that stops at the larger count: one of its named groups is the same in the other set, which
    names it too. So no link is missed, and groups of one or two tokens are rarely keys.

    Without the tokens in ``common`` (sorted) two sets differ in no more, so the same holds; keys then skip passages that
    many documents share. A set that has too few groups left names all of them and is also taken whole.
    """
    sizes = np.diff(first)
    if not len(tokens):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low, high, most, groups = _bands(num, den, 1 << int(sizes.max()).bit_length())
    band = np.searchsorted(low, sizes, "right") - 1
    rare = np.ones(len(tokens), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
    keys, texts = [], []
    for back in range(len(low)):  # the set's own band, and those below from which a link can reach it
        at = np.flatnonzero((sizes > 0) & (band - back >= 0))
        at = at[sizes[at] <= high[band[at] - back]]
        if not len(at):
            break
        for salt in range(SALTS):
            if not len(at):
                break
            own = band[at] - back
            m = groups[own]
            base = np.r_[0, np.cumsum(m)]
            n = sizes[at]
            pick = np.repeat(first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            of = np.repeat(np.arange(len(at)), n)
            if salt < SALTS // 2:
                pick, of = pick[rare[pick]], of[rare[pick]]
            h = mix(tokens[pick] ^ (_ODD[20 + salt] + np.uint64(seed) * _ODD[34]))
            slot = base[of] + (((h >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            content = np.zeros(base[-1], np.uint64)
            np.add.at(content, slot, mix(h ^ _ODD[30]))
            counts = np.bincount(slot, minlength=base[-1])
            owner = np.repeat(np.arange(len(at)), m)
            least = np.zeros(len(at), np.int64)
            for count in range(1, FULLEST + 1):
                least[np.bincount(owner, counts >= count, minlength=len(at)) > most[own]] = count
            full = (counts >= np.maximum(least, 1)[owner])
            name = (own[owner] * 8 + salt).astype(np.uint64) * _ODD[31] + (np.arange(base[-1]) - base[owner]).astype(np.uint64) * _ODD[32]
            keys.append(mix(content[full] + name[full]))
            texts.append(at[owner[full]])
            # with too few full groups, all could differ from the other's: such sets also meet by another hash, at last all together
            weak = least == 0
            if salt == SALTS - 1 and weak.any():
                keys.append(mix(own[weak].astype(np.uint64) * _ODD[33]))
                texts.append(at[weak])
            at = at[weak]
    return np.concatenate(keys), np.concatenate(texts)


def often_slots(tokens: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Where each token of a group, whose hash is salt, is counted."""
    return (mix(tokens ^ salt) >> np.uint64(64 - OFTEN_BITS)).astype(np.int64)


def rare_keys(tokens: np.ndarray, first: np.ndarray, num: int, den: int, often: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text): the rarest tokens of every set, by the counts ``often``, and the number of its text; salt has the hash of each text's group.

    A linked set of n tokens has n * num / den or more of them in common with the other one. So of its rarest tokens, one more than those
    that may lack there, one is common; the rarest common one is among the rarest of both, as all sets have one order.
    """
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, often[often_slots(tokens, salt[owner])], owner))
    take = np.arange(len(tokens)) - first[owner] <= (sizes - -(-sizes * num // den))[owner]
    return tokens[order][take], owner[take]


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, a, b): every key once with its smallest id, and distinct edges from the other ids to it."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    centre = ids[begin][np.cumsum(new) - 1] if len(keys) else ids
    edge = ids != centre
    pairs = np.unique(np.stack([ids[edge], centre[edge]], 1), axis=0) if edge.any() else np.empty((0, 2), np.int64)
    return keys[begin], ids[begin], pairs[:, 0], pairs[:, 1]


# --- the join inside a candidate group --------------------------------------------


class PointTree:
    """An R-tree of count vectors, packed by size and first coordinates. A node has the maxima of the coordinates below it, and
    the smallest and largest size; ``levels`` go from the leaves' nodes to the root."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.order = np.lexsort((counts[:, 1], counts[:, 0], sizes))
        self.counts, self.sizes, self.fan = counts[self.order], sizes[self.order], fan
        most, least, largest = self.counts, self.sizes, self.sizes
        self.levels = []
        while len(most) > 1 or not self.levels:
            cuts = np.arange(0, len(most), fan)
            most, least, largest = np.maximum.reduceat(most, cuts, axis=0), least[cuts], np.maximum.reduceat(largest, cuts)
            self.levels.append((most, least, largest))
        #: Points and nodes whose bound was computed.
        self.met = 0

    def near(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points that may link with this one: sizes do not exclude it, and the sum of coordinate minima reaches the overlap that a link needs."""
        at = np.zeros(1, np.int64)
        for most, least, largest in reversed(self.levels):
            at = at[(at < len(most))]
            at = at[(least[at] * num <= size * den) & (largest[at] * den >= size * num)]
            self.met += len(at)
            bound = np.minimum(most[at], point).sum(1)
            at = at[bound * (num + den) >= num * (size + least[at])]
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
        at = at[at < len(self.sizes)]
        self.met += len(at)
        bound = np.minimum(self.counts[at], point).sum(1)
        return self.order[at[bound * (num + den) >= num * (size + self.sizes[at])]]


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join_sets(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets (sorted, distinct tokens, none empty), enough to connect what links connect. known: sets that are connected already."""
    n = len(sets)
    parent = list(range(n))
    if known is not None and known.any():
        hub = int(np.flatnonzero(known)[0])
        for i in np.flatnonzero(known).tolist():
            parent[i] = hub
    sizes = np.array([len(s) for s in sets])
    links: list[tuple[int, int]] = []

    def linked(overlap, i, j):
        return overlap * (num + den) >= num * (sizes[i] + sizes[j])

    if n == 2 and (find(parent, 0) == find(parent, 1) or not linked(sizes.min(), 0, 1)):
        return []
    dims = int(min(512, max(16, 1 << (int(sizes.max()) // 4).bit_length())))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    group = (mix(flat ^ _ODD[40]) >> np.uint64(48)).astype(np.int64) % dims
    counts = np.bincount(owner * dims + group, minlength=n * dims).reshape(n, dims).astype(np.int32)
    if n == 2:  # two points need no tree, only its bound
        bound = int(np.minimum(counts[0], counts[1]).sum())
        return [(0, 1)] if linked(bound, 0, 1) and linked(len(np.intersect1d(*sets, assume_unique=True)), 0, 1) else []
    tree = PointTree(counts, sizes)
    _, word, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[word] > 1
    column = np.full(len(often), -1)
    column[often > 1] = np.arange((often > 1).sum())
    begin = np.r_[0, np.cumsum(sizes)]
    row_words = [column[word[begin[i] : begin[i + 1]]][shared[begin[i] : begin[i + 1]]] for i in range(n)]
    mark = np.zeros(int((often > 1).sum()) + 1, bool)
    for i in range(n):
        near = tree.near(counts[i], sizes[i], num, den)
        near = near[near > i]
        root = find(parent, i)
        near = np.array([j for j in near.tolist() if find(parent, j) != root], np.int64)
        if not len(near):
            continue
        mark[row_words[i]] = True
        lengths = np.array([len(row_words[j]) for j in near])
        hits = mark[np.concatenate([row_words[j] for j in near])] if lengths.sum() else np.empty(0, bool)
        overlap = np.bincount(np.repeat(np.arange(len(near)), lengths), hits, minlength=len(near))
        mark[row_words[i]] = False
        for j in near[linked(overlap, i, near)].tolist():
            a, b = find(parent, i), find(parent, j)
            if a != b:
                parent[b] = a
                links.append((i, j))
    return links


# --- the job -------------------------------------------------------------------------


def _planes(numbers: np.ndarray, skip: int = 0) -> bytes:
    """64-bit numbers byte place by byte place, highest first, without the ``skip`` lowest: sorted keys and small ids pack well so."""
    return numbers.view(np.uint8).reshape(-1, 8)[:, skip:][:, ::-1].T.tobytes()


def _from_planes(data: bytes, kind, skip: int = 0) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8 - skip, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, skip:] = planes[::-1].T
    return out.view(kind).ravel()


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, key_a, key_b: the size and the fingerprint of every document's token set. Rows with a null n hold a token
    (key_a) that documents of one task share, and in how many (key_b)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64())])

    def run(batches):
        seen, held = [], 0

        def shared():
            tokens, often = np.unique(np.concatenate(seen), return_counts=True)
            take = often >= COMMON_IN_TASK
            none = pa.nulls(int(take.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(tokens[take].view(np.int64)), pa.array(often[take], pa.int64())], schema=schema)

        for batch in batches:
            for part in chunks(batch, 1):
                tokens, first = token_sets(part.column(1), width)
                sizes = np.diff(first)
                prints = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
                for k, out in enumerate(prints):
                    full = np.flatnonzero(sizes)
                    if len(full):
                        out[full] = np.add.reduceat(mix(tokens ^ _ODD[50 + k]), first[full])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64))], schema=schema)
                seen.append(tokens)
                held += len(tokens)
                if held >= 2 * HELD_KEYS:
                    yield shared()
                    seen, held = [], 0
        if held:
            yield shared()

    return stored(map_arrow(docs, run, "doc_id long, n long, key_a long, key_b long"), "ngram-prints")


def _common_tokens(prints: DataFrame) -> np.ndarray:
    """The common tokens, sorted: MOST_COMMON numbers at most."""
    counts = prints.where("n is null").groupBy("key_a").agg(F.sum("key_b").alias("documents")).where(F.col("documents") >= COMMON)
    top = counts.orderBy(F.desc("documents"), "key_a").limit(MOST_COMMON).select("key_a").collect()
    return np.sort(np.array([r["key_a"] for r in top], np.int64).view(np.uint64))


def _often(docs: DataFrame, width: int) -> np.ndarray:
    """How many sets of docs(doc_id, text, group) have each token, counted by group and hash: 2**OFTEN_BITS numbers."""
    size = 2**OFTEN_BITS // OFTEN_PARTS

    def count(batches):
        often = np.zeros(2**OFTEN_BITS, np.int64)
        for batch in batches:
            for part in chunks(batch, 1):
                tokens, first = token_sets(part.column(1), width)
                salt = mix(part.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
                often += np.bincount(often_slots(tokens, np.repeat(salt, np.diff(first))), minlength=len(often))
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(OFTEN_PARTS), pa.int32()), pa.array([_planes(x) for x in often.reshape(-1, size)], pa.binary())], names=["part", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + _from_planes(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    often = np.zeros((OFTEN_PARTS, size), np.int64)
    for r in map_arrow(map_arrow(docs, count, schema).repartition("part"), total, schema).collect():  # 8 MB in all
        often[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return often.ravel()


def _shared_keys(docs: DataFrame, width: int, buckets: int, keys_of, known: np.ndarray) -> DataFrame:
    """Edges (a, b) between ids of docs(doc_id, text, group) whose sets share a candidate key and whose groups are the same.

    keys_of(tokens, first, known, salt) gives the keys, and of which text each is; salt has the hash of each text's group.
    A task folds the keys that it holds to one id each and passes edges for the others on; keys then meet by bucket.
    """
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def spread(batches):
        keys, ids, held = [], [], 0

        def flush():
            k, i, a, b = stars(np.concatenate(keys), np.concatenate(ids))
            a, b = forest(a, b)
            # keys name the smallest id of what is connected here already, so a group of copies sends few ids on
            at = np.minimum(np.searchsorted(a, i), max(len(a) - 1, 0))
            if len(a):
                i = np.where(a[at] == i, b[at], i)
            # edges travel as keys of their own: one that both ends have
            edge = mix(mix(a.view(np.uint64)) ^ b.view(np.uint64) * _ODD[60])
            k, i = np.concatenate([k, edge, edge]), np.concatenate([i, a, b])
            bucket = (((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, k, i = bucket[order], k[order], i[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(k) else np.empty(0, np.int64)
            ends = np.r_[cut[1:], len(k)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([_planes(k[x:y], 1) for x, y in zip(cut, ends, strict=False)], pa.binary()), pa.array([_planes(i[x:y]) for x, y in zip(cut, ends, strict=False)], pa.binary())], schema=schema)

        for batch in batches:
            for part in chunks(batch, 1):
                tokens, first = token_sets(part.column(1), width)
                salt = mix(part.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
                own, text = keys_of(tokens, first, sent.value, salt)
                own = own ^ salt[text]
                named = part.column(0).is_valid().to_numpy(zero_copy_only=False)[text]
                keys.append(own[named])
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False)[text[named]])
                held += len(keys[-1])
                if held >= HELD_KEYS:
                    yield flush()
                    keys, ids, held = [], [], 0
        if held:
            yield flush()

    def meet(batches):
        keys, ids = [], []
        for batch in batches:
            keys += [_from_planes(x, np.uint64, 1) for x in batch.column(1).to_pylist()]
            ids += [_from_planes(x, np.int64) for x in batch.column(2).to_pylist()]
        if keys:
            _, _, a, b = stars(np.concatenate(keys), np.concatenate(ids))
            yield _edges(*forest(a, b))

    return map_arrow(map_arrow(docs, spread, "bucket int, keys binary, ids binary").repartition(buckets, "bucket"), meet, "a long, b long")


def _by_group(rows: DataFrame, name: str, run_group, width: int = 0) -> DataFrame:
    """run_group(ids, sets, known) -> [(i, j)] for every value of ``unit`` in rows(unit, id, tokens, known); edges (a, b) of ids.

    With a width, tokens are texts yet, which travel smaller than token sets.
    """

    def run(batches):
        unit, held = None, []

        def close():
            if len(held) < 2:
                return []
            if width:
                flat, first = token_sets(pa.array([h[1] for h in held], pa.string()), width)
                sets = [flat[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
            else:
                sets = [np.frombuffer(h[1], np.uint64) for h in held]
            links = run_group([h[0] for h in held], sets, np.array([h[2] for h in held], bool))
            return [(held[i][0], held[j][0]) for i, j in links]

        for batch in batches:
            out = []
            for u, i, tokens, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    out += close()
                    unit, held = u, []
                held.append((i, tokens, known))
            if out:
                yield _edges([x[0] for x in out], [x[1] for x in out])
        if out := close():
            yield _edges([x[0] for x in out], [x[1] for x in out])

    return stored(map_arrow(rows.select("unit", "id", "tokens", "known").repartition("unit").sortWithinPartitions("unit", "id"), run, "a long, b long"), name)


def _overlap_with(sets: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """sets(group, id, tokens) with ``similarity`` to other(group, tokens): Jaccard, and ``overlap``, ``size`` and ``other_size``."""
    pairs = sets.join(other.select("group", F.col("tokens").alias("other_tokens")), "group", how).select("group", "id", "tokens", F.coalesce("other_tokens", F.lit(b"")).alias("other_tokens"))

    def run(batches):
        for batch in batches:
            out = []
            for group, i, tokens, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(tokens, np.uint64), np.frombuffer(theirs, np.uint64)
                overlap = len(np.intersect1d(a, b, assume_unique=True))
                out.append((group, i, tokens, overlap, len(a), len(b), overlap / max(1, len(a) + len(b) - overlap)))
            kinds = [("group", pa.int64()), ("id", pa.int64()), ("tokens", pa.binary()), ("overlap", pa.int64()), ("size", pa.int64()), ("other_size", pa.int64()), ("similarity", pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    return map_arrow(pairs, run, "group long, id long, tokens binary, overlap long, size long, other_size long, similarity double")


def _large_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the groups in sets(group, members, id, tokens) that are too large for a task.

    The tokens that most of a small sample share stand for the centre; the set nearest to them is the hub (ties: smallest id), or the
    first one where a group of few but large sets has no sample.
    Sets that link with the hub are one component. The others meet all sets of the group, block by block, in rounds.
    """
    sample = sets.where(F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / 64)) == 0)

    def centre(batches):
        for batch in batches:
            out = []
            for group, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, often = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in many]), return_counts=True)
                out.append((group, tokens[often * 2 > len(many)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["group", "tokens"])

    centres = map_arrow(sample.groupBy("group").agg(F.collect_list("tokens").alias("many")), centre, "group long, tokens binary")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / (MEET_BLOCKS * BLOCK), F.sum("size") / (UNIT_TOKENS / 2)))
    hubs = stored(_overlap_with(sets, centres, "left").groupBy("group").agg(F.max_by("id", F.struct("similarity", -F.col("id"))).alias("hub"), blocks.alias("blocks")), "ngram-hubs")
    hub_tokens = sets.join(hubs, (sets["group"] == hubs["group"]) & (sets["id"] == hubs["hub"])).select(sets["group"], "tokens").dropDuplicates(["group"])
    tested = _overlap_with(sets, hub_tokens).withColumn("known", F.col("overlap") * (num + den) >= num * (F.col("size") + F.col("other_size")))
    tested = stored(tested.join(hubs, "group").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).select("group", "id", "tokens", "known", "hub", "block"), "ngram-tested")
    links = stored(tested.where(F.col("known") & (F.col("id") != F.col("hub"))).select(F.col("id").alias("a"), F.col("hub").alias("b")), "ngram-hub-links")
    rest = tested.where(~F.col("known"))
    pairs = rest.select("group", F.col("block").alias("rest_block")).distinct().join(tested.select("group", "block").distinct(), "group")
    pairs = stored(pairs.select("group", "rest_block", "block", F.xxhash64("group", "rest_block", "block").alias("unit")), "ngram-block-pairs")
    # as many rounds as keep what is sent at once in proportion to the sets, whatever the number of pairs
    rounds = -(-pairs.count() // max(MEET_PAIRS, tested.select("group", "block").distinct().count() // 2))
    for k in range(rounds):
        meet = F.broadcast(pairs.where(F.pmod("unit", F.lit(rounds)) == k))
        left = rest.withColumnRenamed("block", "rest_block").join(meet, ["group", "rest_block"]).select("unit", "id", "tokens", "known")
        # rest and rest of two blocks meet where the first of them is the rest
        right = tested.join(meet, ["group", "block"]).where(F.col("known") | (F.col("block") > F.col("rest_block"))).select("unit", "id", "tokens", "known")
        links = links.unionByName(_by_group(left.unionByName(right), "ngram-block-links", lambda ids, sets, known: join_sets(sets, num, den, known)))
    discard(tested, hubs, pairs)
    return links


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; sets link when their Jaccard similarity is num / den or more.

    A text with fewer words than width is one shingle; null text and text without words are empty sets, linked with nothing.
    A null id links with nothing and has a null component. Rows are compared one by one: where an id repeats, with the same text or
    another, each of its rows has the component of its own text, named by the smallest id in it. Other columns are ignored; an empty
    table gives an empty result. Very long texts are taken whole. Ids that repeat or are no integers are numbered first, row by row.
    """
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if not isinstance(docs.schema[id_col].dataType, IntegralType) or not ids.isEmpty():
        given = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "ngram-named")
        own = _near_duplicates(given.select(F.when(F.col("id").isNotNull(), F.col("__row")).alias("doc_id"), "text"), width, num, den)
        found = stored(own.where("doc_id is not null").join(given.select("__row", "id"), F.col("doc_id") == F.col("__row")).select("id", "n_shingles", "component_id"), "ngram-members")
        least = found.groupBy("component_id").agg(F.min("id").alias("least"))
        nameless = own.where("doc_id is null").select(F.lit(None).cast(given.schema["id"].dataType).alias("doc_id"), "n_shingles", F.lit(None).cast(given.schema["id"].dataType).alias("component_id"))
        return found.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id")).unionAll(nameless)
    return _near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width, num, den)


def _near_duplicates(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """near_duplicates of docs(doc_id, text) whose ids are integers and no two are the same; null ids may be many."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (20 * PARTITION_KEYS)))
    prints = _prints(rows, width)
    own, common = prints.where("n is not null"), _common_tokens(prints)
    keys = ["key_a", "key_b", "n"]

    def hashed(seed: int):
        return lambda tokens, first, known, salt: group_keys(tokens, first, num, den, seed, known)

    def rare(tokens, first, known, salt):
        return rare_keys(tokens, first, num, den, known, salt)

    groups = connected_components(_shared_keys(rows.withColumn("group", F.lit(0).cast("long")), width, buckets, hashed(0), common), "ngram-groups").withColumnRenamed("component", "group")
    # one point for each distinct set; equal sets have equal keys, so they are always in one group
    points = stored(own.join(groups, own["doc_id"] == groups["id"]).groupBy(*keys).agg(F.min("doc_id").alias("id"), F.min("group").alias("group")), "ngram-points")

    def several(members: DataFrame) -> DataFrame:
        """group, members, id, n of the groups with several; members counts for more where the sets are large, so that BLOCK holds for both."""
        weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") * BLOCK / UNIT_TOKENS))
        counts = members.groupBy("group").agg(weight.cast("long").alias("members"), F.count(F.lit(1)).alias("m")).where("m > 1")
        return members.select("group", "id", "n").join(counts, "group").select("group", "members", "id", "n")

    wanted = stored(several(points), "ngram-wanted")
    found = flagged(rows, "doc_id", wanted, "id", "__may").where("__may").drop("__may")
    texts = stored(found.join(wanted, found["doc_id"] == wanted["id"]).select("group", "members", "id", "text", "n"), "ngram-texts")

    def links_of(members: DataFrame, name: str) -> DataFrame:
        fits = members.where(F.col("members") <= BLOCK)
        return _by_group(fits.select(F.col("group").alias("unit"), "id", F.col("text").alias("tokens"), F.lit(False).alias("known")), name, lambda ids, sets, known: join_sets(sets, num, den), width)

    def tokens(batches):
        for batch in batches:
            for part in chunks(batch, 3):
                flat, first = token_sets(part.column(3), width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([flat[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["group", "members", "id", "tokens"])

    links = links_of(texts, "ngram-links")
    # common passages can chain unlike sets; those that link share keys under every hash, and rare tokens
    for name, keys_of, known in (("ngram-split", hashed(1), lambda rows: common), ("ngram-rare", rare, lambda rows: _often(rows, width))):
        large = texts.where(F.col("members") > BLOCK)
        if not large.limit(1).count():
            break
        again = large.select(F.col("id").alias("doc_id"), "text", "group")
        split = several(connected_components(_shared_keys(again, width, buckets, keys_of, known(again)), name).withColumnRenamed("component", "group").join(large.select("id", "n"), "id"))
        parts = stored(split.join(large.select("id", "text"), "id").select("group", "members", "id", "text", "n"), f"{name}-parts")
        discard(texts)
        texts = parts
        links = links.unionByName(links_of(texts, f"{name}-links"))
    large = texts.where(F.col("members") > BLOCK)
    if large.limit(1).count():
        sets = stored(map_arrow(large.select("group", "members", "id", "text"), tokens, "group long, members long, id long, tokens binary"), "ngram-sets")
        links = links.unionByName(_large_links(sets, num, den))
        discard(sets)
    final = connected_components(links, "ngram-final").withColumnRenamed("id", "point")
    discard(texts, wanted)
    named = points.join(final, points["id"] == final["point"], "left").select(*keys, F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.join(named, keys, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


@own_names
def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, of those with its smallest id; all columns stay.

    Rows are compared one by one, so an id may repeat. Rows without an id or without words link with nothing and stay.
    Only rows that a bitmap of those to drop flags are shuffled.
    """
    rows, key = keyed(docs, id_col, "ngram-rows")
    named = _near_duplicates(rows.where(F.col(id_col).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), width, num, den).where("component_id is not null").select(F.col("doc_id").alias("key"), "component_id")
    if key == id_col:
        gone = named.where("key <> component_id").select("key")
    else:
        members = stored(named.join(rows.select(F.col(key).alias("key"), F.col(id_col).alias("id")), "key"), "ngram-members")
        kept = members.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("least")).select(F.col("least.key").alias("key"))
        gone = members.select("key").join(kept, "key", "left_anti")
    return without(rows, key, stored(gone.select(F.col("key").alias(key)), "ngram-gone")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + least(len(w), 4)], ' ') || ':' || least(len(w), 4) AS g
  FROM d, LATERAL (SELECT unnest(range(len(w) - least(len(w), 4) + 1)) AS p) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * o >= 85 * (na.n + nb.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
