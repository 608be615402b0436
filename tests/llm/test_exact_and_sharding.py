import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shelfspark.llm import exact_dedup, sharding

PAIRS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, " "), (8, "\n\n"), (4, "x" * 50_000 + " y"), (6, "x" * 50_000 + "\u000b\u000cy"), (10, "a b"), (11, "A b")]


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return {(i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def test_exact_groups_equal_brute_force(make):
    got = exact_dedup.exact_groups(make(*PAIRS))
    assert {tuple(r)[:5] for r in got.collect()} == brute(PAIRS)


def test_directory_splits_overfull_buckets(spark, make):
    keys = spark.range(500).select(F.xxhash64("id").alias("h"))
    slots, depth = exact_dedup.build_directory(keys, capacity=16)
    rows = slots.collect()
    assert depth > 3 and len(rows) == 2**depth == len({r["slot"] for r in rows})
    counts = Counter(r["bucket"] for r in keys.join(slots, F.shiftrightunsigned("h", 64 - depth) == F.col("slot")).collect())
    assert max(counts.values()) <= 16 and sum(counts.values()) == 500
    assert {tuple(r)[:5] for r in exact_dedup.exact_groups(make(*PAIRS), capacity=1).collect()} == brute(PAIRS)


def test_colliding_keys_chain_and_compare_bytes(make):
    pairs = [*PAIRS, *((100 + i, f"text {i % 9}") for i in range(40))]
    got = exact_dedup.exact_groups(make(*pairs), capacity=1, key=lambda norm: (F.length(norm) % 3).cast("long")).collect()
    assert {tuple(r)[:5] for r in got} == brute(pairs)
    chains = defaultdict(set)
    for r in got:
        chains[r["bucket"], len(r["text_sha256"])].add((r["chain_pos"], r["text_sha256"]))
    assert max(map(len, chains.values())) > 3 and len({r["bucket"] for r in got}) == 1  # leading bits are all zero
    index = exact_dedup.exact_groups(make(*pairs), capacity=4).select("bucket", "local_depth", "text_sha256", "chain_pos").distinct().collect()
    assert len({r["bucket"] for r in index}) > 1 and {r["chain_pos"] for r in index} == {1} and len(index) == len(brute(pairs) and {t for *_, t in brute(pairs)})


def test_a_directory_that_misses_a_bucket_loses_its_documents(make):
    docs = make(*PAIRS)
    rows = docs.select("doc_id", exact_dedup.normalised(F.col("text")).alias("norm")).withColumn("h", exact_dedup.default_key(F.col("norm")))
    slots, depth = exact_dedup.build_directory(rows, capacity=1)
    some = slots.where(F.col("bucket") > slots.agg(F.min("bucket")).first()[0])
    assert 0 < exact_dedup.build_index(rows, some, depth).count() < exact_dedup.build_index(rows, slots, depth).count()


def test_empty_repeated_and_null_ids(make):
    assert exact_dedup.exact_groups(make()).count() == 0
    got = exact_dedup.exact_groups(make((1, "a"), (1, "a"), (None, "a"), (None, "b"))).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    left = exact_dedup.drop_copies(make(*PAIRS))
    assert left.columns == make().columns and {r["doc_id"] for r in left.collect()} == {k[1] for k in brute(PAIRS)}


def test_one_row_of_each_text_stays(make):
    left = exact_dedup.drop_copies(make((1, "a"), (1, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "a"), (None, "d"), (None, "d"), (None, None))).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in left) == sorted(map(str, [(1, "a"), (2, "b"), (3, "c"), (None, "d"), (None, None)]))


def test_shards_follow_the_key_law(make):
    pairs = [(i, "t" * (i % 7)) for i in range(600)] + [(None, None), (5, "again")]
    got = sharding.assign_shards(make(*pairs), [1.0] * 24, [1.0] * 25).collect()
    assert len(got) == len(pairs)
    by_key = defaultdict(set)
    for r in got:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(len(v) == 1 for v in by_key.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {(i, t or "") for i, t in pairs}
    assert all(any(r["doc_id"] == i and r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t.encode()) for i, t in texts) for r in got)
    moved = sum(r["shard"] != r["grown_shard"] for r in got)
    assert 5 < moved < 60
    assert sharding.assign_shards(make(), [1.0], [1.0, 1.0]).count() == 0


def test_rows_that_are_many_times_the_same(make, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    pairs = [(None, None)] * 100 + [(7, "same")] * 90 + [(7, "other")] * 20 + [(i, "t") for i in range(300)]
    got = sharding.assign_shards(make(*pairs), [1.0] * 3, [1.0] * 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"], r["size"]))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t or "") + 8) for i, t in pairs)
    assert all([s for s, *_ in sorted(v, key=lambda x: x[0])] == list(range(len(v))) for v in slots.values())
    assert [i for _, i, n in sorted(slots[next(r["shard"] for r in got if r["doc_id"] == 7)], key=lambda x: x[0])][-110:].count(7) >= 109


def test_weights_share_the_records(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.assign_shards(docs, [1.0, 3.0, 0.0], [1.0, 3.0, 1.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 2.5 < n[1] / n[0] < 3.5
