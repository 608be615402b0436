import base64
import hashlib
import io
import random
import re
import time
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import components, ngram_join, url_filter, warc_zip
from shelfspark.llm.components import connected_components

# --- n-gram Jaccard join ----------------------------------------------------------------


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(pairs, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in pairs]
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, groups, size, words, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    pairs = []
    for _ in range(groups):
        own = [r.choice(vocabulary) for _ in range(r.choice(words))]
        for _ in range(size):
            copy = list(own)
            for _ in range(r.randrange(edits)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(2)] = [r.choice(vocabulary)]
            pairs.append((len(pairs), " ".join(copy) + (" " + passage if r.random() < 0.3 else "")))
    return pairs


@pytest.mark.parametrize("width, num, den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_components_equal_brute_force(make, width, num, den):
    pairs = near_copies(1, 25, 4, [1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 45, 150], 5)
    pairs += [(1000, None), (1001, ""), (1002, " \t"), (1003, pairs[5][1]), (1004, pairs[5][1].upper()), (1005, "one"), (1006, "ONE"), (1007, "a b c d e f"), (1008, "a b c d e f g")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(make(*pairs), width, num, den).collect()}
    assert got == brute_components(pairs, width, num, den)


@pytest.mark.parametrize("name, most", [("BLOCK", 8), ("UNIT_TOKENS", 500), ("UNIT_TOKENS", 20)])
def test_groups_beyond_one_task(make, monkeypatch, name, most):
    monkeypatch.setattr(ngram_join, name, most)
    pairs = near_copies(4, 2, 45, [60], 7) + [(1000 + i, t) for i, t in near_copies(5, 20, 3, [10, 30], 3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(make(*pairs), 4, 85, 100).collect()}
    assert got == brute_components(pairs, 4, 85, 100)


@pytest.mark.parametrize("alike", [False, True])
def test_rows_sent_for_a_large_group(make, monkeypatch, alike):
    """What tasks get at once stays in proportion to the group: of unlike texts with a common passage, and of near copies that one set does not link."""
    for name, most in (("BLOCK", 8), ("MOST_COMMON", 0), ("MEET_BLOCKS", 1), ("MEET_PAIRS", 1)):
        monkeypatch.setattr(ngram_join, name, most, raising=False)
    r = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(30))
    pairs = near_copies(7, 1, 150, [60], 9) if alike else [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + " " + passage) for k in range(150)]
    sent, by_group = [], ngram_join._by_group
    monkeypatch.setattr(ngram_join, "_by_group", lambda rows, *rest: sent.append(rows.count()) or by_group(rows, *rest))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(make(*pairs)).collect()}
    assert got == brute_components(pairs, 5, 4, 5)
    assert max(sent) <= 4 * len(pairs)
    assert alike or sum(sent) <= len(pairs)


def test_repeats_nulls_and_no_rows(make):
    rows = ngram_join.near_duplicates(make((3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")), 4, 85, 100).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows) == [(-1, 2, -1), (2, 2, 2), (3, 2, 2), (3, 2, 2)]
    # (1, a) and (1, b) are different documents: 2 and 3 are each one's own copy
    two = ngram_join.near_duplicates(make((1, "a b c d e"), (5, "p q r s t"), (4, "p q r s t"), (5, "v w x y z"), (6, "v w x y z"), (3, "a b c d e")), 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in two) == [(1, 1), (3, 1), (4, 4), (5, 4), (5, 5), (6, 5)]
    assert ngram_join.near_duplicates(make()).count() == 0
    kept = ngram_join.drop_near_copies(make((3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None)))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 9] and kept.columns == make().columns


def test_one_row_of_each_component_stays(make):
    one, near, other = "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "r s t u v w x"
    left = ngram_join.drop_near_copies(make((4, one), (4, one), (3, near), (5, other), (3, other), (3, None), (3, None), (None, other))).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in left) == sorted(map(str, [(3, near), (3, other), (3, None), (3, None), (None, other)]))


def test_every_link_shares_a_key():
    r = random.Random(8)
    for num, den in ((85, 100), (4, 5)):
        for n in (5, 6, 7, 10, 14, 30, 90, 300):
            tokens = np.array(sorted(r.getrandbits(63) for _ in range(n)), np.uint64)
            for _ in range(40):
                drop = r.randrange(n // 5 + 1)
                other = {*tokens.tolist()} - {*r.sample(tokens.tolist(), drop)} | {r.getrandbits(63) for _ in range(r.randrange(n // 5 + 1))}
                both = len(other & {*tokens.tolist()})
                if den * both < num * (len(other) + n - both):
                    continue
                flat = np.concatenate([tokens, np.array(sorted(other), np.uint64)])
                for share in (0, 0.5, 0.9, 1):
                    common = np.unique(r.sample(flat.tolist(), int(share * len(flat)))).astype(np.uint64)
                    keys, text = ngram_join.group_keys(flat, np.array([0, n, len(flat)]), num, den, 0, common)
                    assert {*keys[text == 0].tolist()} & {*keys[text == 1].tolist()}


def test_every_link_shares_a_rare_token():
    r = random.Random(9)
    for num, den in ((85, 100), (4, 5), (1, 2)):
        for n in (1, 2, 5, 6, 7, 10, 30, 90):
            for _ in range(40):
                tokens = {r.getrandbits(64) for _ in range(n)}
                other = tokens - {*r.sample(sorted(tokens), r.randrange(n // 4 + 1))} | {r.getrandbits(64) for _ in range(r.randrange(n // 4 + 1))}
                if den * len(tokens & other) < num * len(tokens | other):
                    continue
                flat = np.array(sorted(tokens) + sorted(other), np.uint64)
                often = np.array([r.randrange(4) for _ in range(64)]).repeat(2**ngram_join.OFTEN_BITS // 64)
                keys, text = ngram_join.rare_keys(flat, np.array([0, n, len(flat)]), num, den, often, np.full(2, 5, np.uint64))
                assert {*keys[text == 0].tolist()} & {*keys[text == 1].tolist()}
                assert len(keys) <= (den - num) * len(flat) // den + 2


def test_tree_bound_never_loses_a_pair():
    r = np.random.default_rng(3)
    counts = r.poisson(2, (200, 16)).astype(np.int32)
    counts[100:] = np.maximum(counts[:100] + r.integers(-1, 2, (100, 16)), 0)
    sizes = counts.sum(1)
    for fan in (2, 3, 16, 300):
        tree = ngram_join.PointTree(counts, sizes, fan)
        assert len(tree.levels) == {2: 8, 3: 5, 16: 2, 300: 1}[fan]
        for i in range(200):
            bound = np.minimum(counts, counts[i]).sum(1)
            assert set(tree.near(counts[i], sizes[i], 4, 5).tolist()) == set(np.flatnonzero(bound * 9 >= 4 * (sizes + sizes[i])).tolist())
        assert tree.met < 200 * 200 * 2


def test_ids_of_any_type(spark):
    rows = [("b", "a b c d e f g"), ("a", "A B C D E F G"), ("c", "other words that stand here"), (None, "a b c d e f g"), ("d", None), ("b", "x y z")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 4, 85, 100).collect()
    assert sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"] or "") for r in got) == [("", 4, ""), ("a", 4, "a"), ("b", 1, "b"), ("b", 4, "a"), ("c", 2, "c"), ("d", 0, "d")]


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_components_of_a_long_path(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)] + [(200 + i, 150) for i in range(40)] + [(150, 140)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges, "path").collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 101, 102)} == {100} and all(got[200 + i] == 140 for i in range(40))
    assert connected_components(edges.limit(0), "none").count() == 0


# --- WARC in ZIP ---------------------------------------------------------------------------

PAGES = [(4, "http://a/x", "<p>é</p>"), (2, "http://b/ \n", "<p>é</p>"), (7, None, None), (9, "u", ""), (5, "http://c", "z" * 300_000), (6, "http://d", "WARC/1.1\r\n\r\n"), (2, "again", "<p>é</p>"), (None, "n", "only")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as archive", "'x' as sha")
    got = warc_zip.read_records(warc_zip.write_archives(pages)).collect()
    assert len(got) == len(PAGES)
    first = {"<p>é</p>": 2, "": 7, "z" * 300_000: 5, "WARC/1.1\r\n\r\n": 6, "only": None}
    for page_id, _, html in PAGES:
        html = html or ""
        for r in (r for r in got if r["page_id"] == page_id):
            assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
            if page_id == first[html]:
                assert (r["record_type"], r["refers_to"], bytes(r["payload"]), r["digest_ok"]) == ("response", None, html.encode(), True)
            else:
                assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first[html], None)
    assert warc_zip.read_records(warc_zip.write_archives(pages.limit(0))).count() == 0


def test_small_ranges_and_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 300)
    writer = warc_zip.ArchiveWriter(f"file://{tmp_path}/w", archive_bytes=1000)
    for i in range(40):
        writer.add(i, warc_zip.warc_record(i, "u", b"x" * i * 30, "D", None))
    writer.close()
    assert len(writer.done) > 1 and not list((tmp_path / "w").glob("*.part"))
    archives = spark.createDataFrame([(a,) for a, _, _ in writer.done], "archive string")
    assert warc_zip.find_ranges(archives, 300).count() > len(writer.done)
    assert sorted(r["page_id"] for r in warc_zip.read_records(archives, payload=False).collect()) == list(range(40))


def test_foreign_archives_without_index_and_zip64(spark, tmp_path):
    records = b"".join(warc_zip._gzip(warc_zip.warc_record(i, "u", b"p%d" % i, "D", None)) for i in range(5))
    plain = b"".join(warc_zip.warc_record(10 + i, "u", b"q%d" % i, "D", None) for i in range(3))
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("data/a.warc.gz", records)
        z.writestr("data/b.warc", plain)
        z.writestr("readme.txt", "no")
        z.writestr(zipfile.ZipInfo("data/c.warc"), plain, zipfile.ZIP_DEFLATED)
    path.write_bytes(b"prefix bytes" + path.read_bytes())
    got = warc_zip.read_records(spark.createDataFrame([(str(path),)], "archive string"), payload=False).collect()
    assert sorted(r["page_id"] for r in got) == [0, 1, 2, 3, 4, 10, 11, 12]


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for n in range(3):
            with z.open(zipfile.ZipInfo(f"m{n}.warc"), "w", force_zip64=True) as member:
                member.write(b"%d" % n * 50)
    data = out.getvalue()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    members = warc_zip.central_directory(io.BytesIO(data), len(data))
    assert [(m["name"], m["size"]) for m in members] == [(f"m{n}.warc", 50) for n in range(3)]
    for n, m in enumerate(members):
        assert warc_zip.read_at(io.BytesIO(data), warc_zip.member_start(io.BytesIO(data), m), m["size"]) == b"%d" % n * 50
    with pytest.raises(ValueError):
        warc_zip.central_directory(io.BytesIO(b"no zip"), 6)


def hand_made(directory_at: int, front: bytes, members: list[tuple[bytes, bytes]], zip64: bool, comment: bytes) -> bytes:
    """A ZIP archive, byte by byte, with stored members."""
    import struct

    body, entries = b"", b""
    for name, data in members:
        at, crc = len(body), zlib.crc32(data)
        body += struct.pack("<I5H3I2H", 0x04034B50, 45, 0, 0, 0, 0, crc, len(data), len(data), len(name), 0) + name + data
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at) if zip64 else b""
        size, where = (0xFFFFFFFF, 0xFFFFFFFF) if zip64 else (len(data), at)
        entries += struct.pack("<I6H3I5H2I", 0x02014B50, 45, 45, 0, 0, 0, 0, crc, size, size, len(name), len(extra), 0, 0, 0, 0, where) + name + extra
    body += b"?" * directory_at
    start, out = len(body), body + entries
    if zip64:
        out += struct.pack("<IQ2H2I4Q", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(entries), start) + struct.pack("<IIQI", 0x07064B50, 0, len(out), 1)
    many, length, place = (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if zip64 else (len(members), len(entries), start)
    return front + out + struct.pack("<I4H2IH", 0x06054B50, 0, 0, many, many, length, place, len(comment)) + comment


ANY_RECORDS = [
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n",
    b"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Target-URI: http://x/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Refers-To: <urn:uuid:3>\r\nContent-Type: application/http\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Block-Digest: sha256:77\r\nContent-Length: 4\r\n\r\nW\r\n\r\n\r\n",
    b"WARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n",
]


@pytest.mark.parametrize("zip64, front, comment", [(False, b"", b""), (True, b"", b""), (True, b"#!/bin/sh\n" * 9, b""), (False, b"front", b"about PK\x05\x06 and more than twenty-two bytes"), (True, b"x", b"PK\x05\x06")])
def test_any_records_in_hand_made_archives(spark, tmp_path, monkeypatch, zip64, front, comment):
    monkeypatch.setattr(warc_zip, "PIECE_BYTES", 13)
    packed = [warc_zip._gzip(r) for r in ANY_RECORDS]
    places = [sum(map(len, packed[:k])) for k in range(5)]
    lines = b"!header\n" + b"".join(b'x,y)/ 2024 {"offset": "%d", "length": "%d", "filename": "a.warc.gz"}\n' % (places[k], len(packed[k])) for k in (3, 1))
    members = [(b"archive/a.warc.gz", b"".join(packed)), (b"indexes/index.cdxj", lines), (b"archive/b.warc", b"".join(ANY_RECORDS)), (b"archive/c.warc.gz", packed[1] + b"no gzip"), (b"d.warc", b"")]
    path = tmp_path / "x.zip"
    path.write_bytes(hand_made(3, front, members, zip64, comment))
    archives = spark.createDataFrame([(str(path),)], "archive string")
    got = sorted(((r["record_type"], r["record_id"], r["refers_to_id"], r["page_id"], r["payload_bytes"], r["payload"] and bytes(r["payload"]), r["digest_ok"]) for r in warc_zip.read_records(archives).collect()), key=repr)
    one = [("warcinfo", "<urn:uuid:1-2>", None, None, 9, b"software:", None), ("response", "<urn:uuid:3>", None, None, 3, b"abc", None), ("revisit", "<urn:uuid:4>", "<urn:uuid:3>", None, None, None, None), ("resource", "<urn:page:5>", None, 5, 4, b"W\r\n\r", None), (None, None, None, None, 3, b"xyz", None)]
    found = [g for g in got if g[0] != "unreadable"]
    assert found == sorted([*one, *one, one[1]], key=repr)
    assert len(got) - len(found) <= 1


def test_ranges_cover_members():
    assert list(warc_zip.ranges_of([], 10, 4)) == [(0, [10])] and list(warc_zip.ranges_of([], 0, 4)) == []
    assert list(warc_zip.ranges_of([(4, 2), (0, 3), (4, 2), (5, 9), (90, 5)], 10, 4)) == [(0, [3, 1]), (4, [2, 4])]
    assert sum(len(x) for _, x in warc_zip.ranges_of([(k, 1) for k in range(200_000)], 200_000, 1000)) == 200_000


def test_warc_query_equals_its_sql(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame([*[p for p in PAGES if p[0] is not None and p[1] != "again"], (11, "x", "only")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.sql(warc_zip.ORACLE_SQL)
    got = warc_zip.query(spark, str(tmp_path)).select(*wanted.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted.fetchall()))


# --- URL lists ---------------------------------------------------------------------------------


def brute_rules(captures, entries):
    logs = defaultdict(dict)
    for name, key, action, at in entries:
        if None not in (name, key, at) and action in ("add", "remove"):
            logs[name, key][at] = max(action, logs[name, key].get(at, ""))
    out = []
    for cid, url, at in captures:
        m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").strip().lower())
        hits = set()
        if m and at is not None and m[1].rstrip("."):
            host = m[1].rstrip(".")
            path = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", url.strip())[1].strip("/")
            labels, parts = host.split("."), re.split("/+", path) if path else []
            keys = {"d:" + ".".join(labels[i:]) for i in range(len(labels))} | {"p:" + host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))}
            for (name, key), log in logs.items():
                before = [t for t in log if t <= at]
                if key in keys and before and log[max(before)] == "add":
                    hits.add(f"{name}/{key}")
        out.append((cid, bool(hits), len(hits), ",".join(sorted(hits))))
    return sorted(out, key=repr)


def test_url_lists_equal_brute_force(spark):
    r = random.Random(6)
    day = 86400
    urls = ["http://A.b.c/x/y?q", "https://u@b.c:80/x", "ftp://c./", "no url", "", None, "http://b.c//x//y", "HTTP://a.B.c/X", "http:///p"]
    keys = ["d:c", "d:b.c", "d:a.b.c", "p:b.c/x", "p:a.b.c/x/y", "p:b.c/x/y", "d:z", None]
    captures = [(i, r.choice(urls), r.choice([None, *range(0, 60 * day, day // 2)])) for i in range(300)] + [(1, urls[0], 5 * day)]
    entries = [(r.choice(["l1", "l2", None]), r.choice(keys), r.choice(["add", "remove", "note"]), r.choice([None, *range(0, 60 * day, day)])) for _ in range(200)]
    entries += entries[:5]
    c = spark.createDataFrame(captures, "capture_id long, url string, fetched long").selectExpr("*", "'k' as key", "1 as bucket", "2 as rules", "'h' as host")
    e = spark.createDataFrame(entries, "list_name string, key string, action string, effective long")
    got = url_filter.evaluate(c, e).collect()
    assert sorted(((x["capture_id"], x["blocked"], x["n_rules"], x["rules"]) for x in got), key=repr) == brute_rules(captures, entries)
    assert url_filter.evaluate(c.limit(0), e).count() == 0
    assert not any(x["blocked"] for x in url_filter.evaluate(c, e.limit(0)).collect())


def test_intervals_are_covered_once_however_long(spark):
    r = random.Random(1)
    pairs = [(a, a + r.choice([-1, 0, 1, 15, 16, 17, 40, 500, 5000])) for a in (r.randrange(-50, 900) for _ in range(200))]
    pairs += [(-(10**13), 10**13), (7, 7 + 16**9)]
    for row in spark.createDataFrame(pairs, "a long, b long").withColumn("x", url_filter.cover(F.col("a"), F.col("b"))).collect():
        spans = sorted((x["bucket"] * 16 ** x["level"], (x["bucket"] + 1) * 16 ** x["level"] - 1) for x in row["x"])
        assert all(end + 1 == begin for (_, end), (begin, _) in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (row["a"], row["b"]) if spans else row["b"] < row["a"]
        assert len(spans) <= 32 * 12


def test_times_of_any_size_and_long_paths(spark):
    """A wrong time makes no ranges, and a path of many segments is hashed in one pass."""
    day = 86400
    long_path = "http://h.org/" + "/".join("abc"[i % 3] for i in range(100_000))
    times = [0, 10 * day, 10 * day * 1000, 10 * day * 10**6, 2**62, -(2**62), 2**63 - 1]
    captures = [(i, "http://a.b/x", t) for i, t in enumerate(times)] + [(100, long_path, 10 * day), (101, long_path + "/d", 10 * day), (102, "http://" + "a." * 4000 + "org/", day)]
    entries = [("l", "d:b", "add", day), ("m", "p:a.b/x", "add", -(2**62)), ("m", "p:a.b/x", "remove", 2**62), ("n", "p:" + long_path[7:], "add", 0), ("n", "p:h.org/a/b", "add", 0), ("n", "p:h.org/a/bc", "add", 0), ("o", "d:a.org", "add", 0), ("o", "d:a", "add", 0)]
    c = spark.createDataFrame(captures, "capture_id long, url string, fetched long")
    e = spark.createDataFrame(entries, "list_name string, key string, action string, effective long")
    begun = time.time()
    got = sorted(((x["capture_id"], x["blocked"], x["n_rules"], x["rules"]) for x in url_filter.evaluate(c, e).collect()), key=repr)
    assert time.time() - begun < 60
    small = [x for x in captures if x[0] < 100]
    assert [x for x in got if x[0] < 100] == brute_rules(small, [x for x in entries if len(x[1]) < 100])
    assert [x[:3] for x in got if x[0] >= 100] == [(100, True, 2), (101, True, 2), (102, True, 1)]


def test_records_with_long_headers_and_broken_archives(spark, tmp_path):
    r = random.Random(4)
    url = "http://h.org/" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3_000_000))
    pages = spark.createDataFrame([(1, url, "<p>one"), (2, "http://h.org/", "<p>two"), (3, url, "<p>one")], "page_id long, url string, html string")
    manifest = warc_zip.write_archives(pages, f"file://{tmp_path}/warc")
    rows = {x["page_id"]: x for x in warc_zip.read_records(manifest).collect()}
    assert {i: x["record_type"] for i, x in rows.items()} == {1: "response", 2: "response", 3: "revisit"} and rows[1]["url"] == url and rows[1]["digest_ok"]
    assert bytes(rows[1]["payload"]) == b"<p>one" and rows[3]["refers_to"] == 1
    (tmp_path / "no.zip").write_bytes(b"no archive")
    whole = open(manifest.first()["archive"].removeprefix("file://"), "rb").read()
    (tmp_path / "cut.zip").write_bytes(whole[:-30])
    bad = spark.createDataFrame([(f"file://{tmp_path}/no.zip",), (f"file://{tmp_path}/cut.zip",)], "archive string")
    both = warc_zip.read_records(manifest.select("archive").unionAll(bad), payload=False).collect()
    assert sorted(x["record_type"] for x in both) == ["response", "response", "revisit", "unreadable", "unreadable"]
    assert {x["archive"] for x in both if x["record_type"] == "unreadable"} == {b[0] for b in bad.collect()}


def test_ipv6_hosts_and_old_entries(spark):
    c = spark.createDataFrame([(1, "http://[::1]:80/a", 4 * 10**8), (2, "http://u@[2001:DB8::7]/", 4 * 10**8), (3, "http://[::2/a", 4 * 10**8)], "capture_id long, url string, fetched long")
    e = spark.createDataFrame([("l", "d:[::1]", "add", 10), ("l", "p:[::1]/a", "add", 3 * 10**8), ("l", "d:[2001:db8::7]", "add", 5 * 10**8)], "list_name string, key string, action string, effective long")
    assert {r["capture_id"]: r["rules"] for r in url_filter.evaluate(c, e).collect()} == {1: "l/d:[::1],l/p:[::1]/a", 2: "", 3: ""}


def test_entries_with_several_slashes_match(spark):
    c = spark.createDataFrame([(1, "http://h.org/a//b/c", 50), (2, "http://h.org/a/b", 50), (3, "http://h.org/ab", 50)], "capture_id long, url string, fetched long")
    e = spark.createDataFrame([("l", "p:h.org/a//b/", "add", 10)], "list_name string, key string, action string, effective long")
    got = {r["capture_id"]: (r["blocked"], r["rules"]) for r in url_filter.evaluate(c, e).collect()}
    assert got == {1: (True, "l/p:h.org/a/b"), 2: (True, "l/p:h.org/a/b"), 3: (False, "")}


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline
    from shelfspark.llm import quality_cnn

    r = random.Random(12)
    words = ["the", "house", "was", "under", "green", "trees", "by", "river", "old", "stone", "wall", "near", "town"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    bad = lambda n: " ".join(w + r.choice(["%%%", "###"]) for w in text(n).split())
    pairs = [(i, text(60) if i % 4 else bad(60)) for i in range(160)]
    pairs += [(200, pairs[1][1]), (201, pairs[2][1].replace(" ", "  ")), (202, pairs[3][1] + " extra")]
    leak = text(14)
    pairs += [(203, text(30) + " " + leak + " " + text(30)), (204, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {row["doc_id"] for row in quality_cnn.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = [(i, t) for i, t in pairs if i in good]
    norm = defaultdict(list)
    for i, t in left:
        norm[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    left = [(i, t) for i, t in left if i in {min(v) for v in norm.values()}]
    comps = brute_components(left, 5, 4, 5)
    left = [(i, t) for i, t in left if comps[i][1] == i and leak not in (t or "")]
    got = {row["doc_id"]: row for row in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in left} and not {200, 201, 202, 203} & set(got)
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and len(got[i]["ids"]) == got[i]["n_tokens"] for i, t in left)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(stage(spark, docs, str(tmp_path)).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])
