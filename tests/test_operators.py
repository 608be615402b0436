import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import access, accounts, audit, library, ownership, progress
from shelfspark.operators.running import running_total
from shelfspark.streaming import events as streams
from shelfspark.streaming import limiter

T0 = dt.datetime(2024, 1, 1)


def files(spark, *names):
    return spark.createDataFrame([n if isinstance(n, tuple) else (n, 1, 1000) for n in names], schemas.FILES)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_volumes_and_queue(spark):
    f = files(spark, "Series A/v01.cbz", "Series A/v02.cbz", "Series A/v02.ocr.gz", "Series A/v02.webp", "Series A/v01.nocover", "Group/Series C/v03.cbz", ".hid/v.cbz", "root.cbz", "Series B/only.ocr.gz", "Series E/renamed.cbz", "Series E/old.ocr.gz", "Series E/old.webp", "Series U/X.CBZ")
    volumes = library.attach_sidecars(f)
    assert pairs(volumes, "series", "name", "has_cbz") == [("Group/Series C", "v03", True), ("Series A", "v01", True), ("Series A", "v02", True), ("Series E", "renamed", True), ("Series U", "X", False)]
    assert pairs(library.needs_sidecar(volumes), "name") == [("renamed",), ("v01",), ("v03",)]
    assert library.pending_thumbnails(volumes).first()[0] == 2
    assert pairs(library.orphan_sidecars(f), "rel_path") == [("Series B/only.ocr.gz",), ("Series E/old.ocr.gz",), ("Series E/old.webp",)]
    assert library.series_detail(volumes, "Series A").first()["cover"] == "Series A/v02.webp"
    document = {r["series"]: r["document"] for r in library.export_catalog(volumes).collect()}
    assert document["Series A"] == '{"name":"Series A","cover":"Series A/v02.webp","volumes":[{"name":"v01"},{"name":"v02","cover":"Series A/v02.webp"}]}'
    plan = volumes._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_fifo_and_walk_order(spark):
    f = files(spark, ("D/v02.cbz", 1, 1000), ("D/v01.cbz", 1, 2000), ("D/a/v.cbz", 1, 1000), ("D-b/v.cbz", 1, 5))
    queue = library.pending_queue(library.attach_sidecars(f))
    assert pairs(queue.where("library = 'D'"), "position", "series", "name") == [(1, "D", "v02"), (2, "D/a", "v"), (3, "D", "v01")]
    ordered = library.catalog_order(library.volume_count(library.attach_sidecars(f))).collect()
    assert [r["series"] for r in ordered] == ["D", "D/a", "D-b"]


def test_processable_and_counts(spark):
    f = files(spark, "a.CBR", "b.txt", "d/p.JPG", "d/e/q.png", "x.rar")
    assert pairs(library.processable(f), "path", "kind") == [("a.CBR", "file"), ("d", "directory"), ("d/e", "directory"), ("x.rar", "file")]
    members = spark.createDataFrame([("a", "1.jpg"), ("a", "x/2.TIFF"), ("a", "n.txt"), ("b", "0.png")], "rel_path string, member string")
    archives = spark.createDataFrame([("a",), ("b",), ("c",)], "rel_path string")
    assert pairs(library.image_counts(archives, members), "rel_path", "images") == [("a", 2), ("b", 1), ("c", 0)]
    assert pairs(library.cover_member(members), "rel_path", "cover_member") == [("a", "1.jpg"), ("b", "0.png")]


def test_folder_contents_is_an_equi_join(spark):
    f = files(spark, "a/b/v.cbz", "a/c.cbz", "ab/v.cbz", "a/b/v.ocr")
    folders = spark.createDataFrame([("/a/",), ("a/b",), ("zz",)], "directory string")
    out = library.folder_contents(f, folders)
    assert pairs(out, "directory", "rel_path") == [("a", "a/b/v.cbz"), ("a", "a/c.cbz"), ("a/b", "a/b/v.cbz")]
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _names_by_loop(incoming, existing):
    taken, wanted = set(existing), {}
    for i, name in sorted(incoming):
        stem, dot, ext = name.rpartition(".") if "." in name[1:] and not name.endswith(".") else (name, "", "")
        new, n = name, 0
        while new in taken:
            n += 1
            new = f"{stem}_{n}{dot}{ext}"
        taken.add(new)
        wanted[i] = new
    return wanted


@pytest.mark.parametrize("seed, family_rows", [(0, 10**5), (1, 10**5), (2, 0), (3, 0), (4, 6), (5, 25)])
def test_unique_names_against_a_loop(spark, seed, family_rows):
    r = random.Random(seed)
    old = ["..", "_1.cbz", "a.cbz", "a_1.cbz", "a_2.cbz", "a_4.cbz", "b", "b_1", "a_01.cbz", "a_1_1.cbz", ".c_1"]
    new = ["a.cbz", "a.cbz", "a.cbz", "a.cbz", "b", "c.x.cbz", "a_1.cbz", "a_2.cbz", "a_3.cbz", "a_1_1.cbz", "a_1_2.cbz", "b_2", ".c", "d.", "d._1", "x_1.a_2", "x.a_2", "..", ".._1", "d_1.", "_1.cbz", ".cbz", ".cbz_1", "s/t.u/v", "s/t.u/v_1"]
    existing = r.sample(old, 3)
    incoming = [(i, r.choice(new)) for i in range(70)]
    r.shuffle(incoming)
    got = library.unique_names(spark.createDataFrame(incoming, "id int, name string"), spark.createDataFrame([(e,) for e in existing + existing], "name string"), family_rows)
    rows = got.collect()
    assert {x["id"]: x["stored_name"] for x in rows} == _names_by_loop(incoming, existing)
    assert len({x["stored_name"] for x in rows} | set(existing)) == len(rows) + len(existing)


def test_unique_names_meet_incoming_names(spark):
    name = lambda *n: spark.createDataFrame(list(enumerate(n)), "id int, name string")
    none = spark.createDataFrame([], "name string")
    assert pairs(library.unique_names(name("a.cbz", "a.cbz", "a_1.cbz"), none), "id", "stored_name") == [(0, "a.cbz"), (1, "a_1.cbz"), (2, "a_1_1.cbz")]
    assert pairs(library.unique_names(name("a_1.cbz", "a.cbz", "a.cbz"), none), "id", "stored_name") == [(0, "a_1.cbz"), (1, "a.cbz"), (2, "a_2.cbz")]
    assert library.unique_names(name("a").limit(0), none).count() == 0


def test_a_large_series_has_pages(spark):
    rows = [("s", f"v{n:02}", True, False, False, f"s/v{n:02}.webp" if n in (5, 8) else None) for n in range(11)] + [("t", "v", True, False, False, None)]
    volumes = spark.createDataFrame(rows, "series string, name string, has_cbz boolean, has_sidecar boolean, has_sidecar_gz boolean, cover string").repartition(5)
    out = sorted((r["series"], r["page"], r["cover"], [v["name"] for v in r["volumes"]]) for r in library.series_rollup(volumes, 4).collect())
    names = [f"v{n:02}" for n in range(11)]
    assert out == [("s", 0, "s/v05.webp", names[:4]), ("s", 1, "s/v05.webp", names[4:8]), ("s", 2, "s/v05.webp", names[8:]), ("t", 0, None, ["v"])]
    assert library.series_rollup(volumes.limit(0), 4).count() == 0


def test_running_total_of_a_group_over_many_blocks(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 50 = 1, 'few', 'many')) as k", "(id * 7919) % 3000 as at", "id % 4 as w")
    out = running_total(rows.repartition(7), ["k"], ["at"], F.col("w"), "test", "total")
    wanted, sums = {}, {}
    for x in sorted(rows.collect(), key=lambda x: x["at"]):
        sums[x["k"]] = wanted[x["at"]] = sums.get(x["k"], 0) + x["w"]
    assert {x["at"]: x["total"] for x in out.collect()} == wanted


def test_listing_and_preferred_sidecar(spark):
    f = files(spark, "b/v.cbz", "a/x.cbz", "z.txt")
    own = spark.createDataFrame([("ann", "volume-data.json"), ("bob", "profiles.json"), ("ann", "other")], "username string, filename string")
    assert pairs(library.merged_listing(f, own, "ann"), "rank", "name") == [(0, "volume-data.json"), (1, "a"), (1, "b"), (1, "z.txt")]
    assert pairs(library.merged_listing(f, own, None), "rank", "name") == [(1, "a"), (1, "b"), (1, "z.txt")]
    c = spark.createDataFrame([("k", "s/b.ocr.gz", False, True), ("k", "a.ocr", True, True), ("k", "b.ocr.gz", True, False), ("m", "x.ocr", False, False)], "volume_key string, path string, is_root boolean, valid boolean")
    assert pairs(library.preferred_sidecar(c), "volume_key", "path") == [("k", "a.ocr")]


def users(spark, *rows):
    return spark.createDataFrame([(i, n, r, s, None, T0, T0) for i, (n, r, s) in enumerate(rows)], schemas.USERS)


def test_invites(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    day = dt.timedelta(days=1)
    inv = spark.createDataFrame([(1, "a", "editor", None, T0, T0 + day, None, None), (2, "b", "editor", None, T0, T0 - day, None, None), (3, "c", "editor", None, T0, T0 + day, "ann", T0), (4, "d", "editor", None, T0, T0 - day, "ann", T0), (5, "e", "editor", None, T0, T0, None, None), (6, "f", "editor", None, T0, T0 - dt.timedelta(hours=0.0), None, None)], schemas.INVITES)
    assert pairs(inv.select("id", accounts.invite_status(now).alias("s")), "id", "s") == [(1, "valid"), (2, "expired"), (3, "used"), (4, "used"), (5, "valid"), (6, "valid")]
    assert pairs(accounts.active_invites(inv, now), "id") == [(1,)]
    assert pairs(accounts.active_invites(inv, now + F.expr("INTERVAL '1' HOUR"), "reference_text"), "id") == [(1,), (5,), (6,)]
    assert pairs(accounts.cleanup_invites(inv, now), "id") == [(1,), (3,), (4,), (5,), (6,)]
    uses = spark.createDataFrame([("a", "z", 2), ("a", "y", 1), ("b", "x", 1), ("c", "x", 1)], "code string, username string, use_id int")
    assert pairs(accounts.use_invites(inv, uses, now).where("used_by is not null"), "id", "used_by") == [(1, "y"), (3, "ann"), (4, "ann")]
    asked = spark.createDataFrame([(1, "n", "writer", "x", "7d"), (2, "o", "king", "x", "7d"), (3, "p", "admin", "x", "7 days")], "id long, code string, role string, invited_by string, duration string")
    made = accounts.create_invites(asked, now).collect()
    assert [(r["role"], r["expires_at"]) for r in made] == [("uploader", T0 + 7 * day)]
    assert pairs(accounts.rejected_invites(asked), "id", "reason") == [(2, "role"), (3, "duration")]


def test_users(spark):
    now = F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz")
    u = users(spark, ("ann", "admin", "active"), ("bob", "writer", "pending"), ("cat", "king", "deleted"))
    changes = spark.createDataFrame([("ann", "role", "king"), ("bob", "approve", None), ("cat", "delete", None)], "username string, change string, value string")
    assert pairs(accounts.update_users(u, changes, now), "username", "role", "status", "changed") == [("ann", "admin", "active", False), ("bob", "writer", "active", True), ("cat", "king", "deleted", False)]
    new = spark.createDataFrame([(9, "ann", "editor", "active"), (10, "new", "writer", "active"), (11, "new", "editor", "active"), (12, "x", "editor", "active"), (13, "king", "king", "active")], "id long, username string, role string, status string")
    added, rejected = accounts.create_users(u, new, now)
    assert pairs(added, "id", "role") == [(10, "uploader")] and pairs(rejected, "id", "reason")[0] == (9, "Username already exists") and rejected.count() == 4
    granted = accounts.permissions(u, accounts.permission_matrix(spark))
    assert {r["username"]: len(r["permissions"]) for r in granted.collect()} == {"ann": 6, "bob": 0, "cat": 0}
    assert accounts.has_admin(u.limit(0)).first()[0] is False


@pytest.mark.parametrize("mode, codes", [("disabled", [403] * 6), ("self", [201, 409, 400, 400, 409, 201]), ("approval", [201, 409, 400, 400, 409, 201]), ("invite", [400, 400, 400, 400, 409, 201])])
def test_registration(spark, mode, codes):
    inv = spark.createDataFrame([(1, "good", "editor", None, T0, T0 + dt.timedelta(days=1), None, None)], schemas.INVITES)
    asked = spark.createDataFrame([(0, "new", 9, ""), (1, "ann", 9, None), (2, "x", 9, "good"), (3, "fine", 3, "good"), (4, "ann", 9, "good"), (5, " other ", 9, "good")], "request_id long, username string, password_length int, invite_code string")
    got = accounts.register(asked, users(spark, ("ann", "admin", "active")), inv, mode, F.lit(T0).cast("timestamp_ntz")).orderBy("request_id").collect()
    assert [r["status_code"] for r in got] == codes
    if mode == "invite":
        assert (got[5]["role"], got[5]["status"], got[5]["username"]) == ("editor", "active", "other")


def uploads(spark, *rows):
    return spark.createDataFrame([(k, u, T0, u, T0) for k, u in rows], schemas.UPLOADS)


def test_ownership(spark):
    now = F.lit(T0 + dt.timedelta(days=9)).cast("timestamp_ntz")
    up = uploads(spark, ("S/v1.cbz", "alice"), ("S/v2.cbz", "bob"), ("S_x/v.cbz", "cat"), ("sax/v.cbz", "dan"))
    asks = spark.createDataFrame([("/reader/S/v1.cbz", "alice"), ("/reader/S/v1.ocr.gz", "alice"), ("/reader/S/v1.webp", "bob"), ("/reader/S", "alice"), ("/reader/", "alice"), ("/other/S/v1.cbz", "alice")], "path string, username string")
    assert [r["may_delete"] for r in ownership.can_delete(asks, up).orderBy("path", "username").collect()] == [False, False, False, True, True, False]
    events = spark.createDataFrame([("S/v1.ocr", "eve", T0 - dt.timedelta(days=1)), ("N/n.cbz", "eve", T0), ("N/n.webp", "fay", T0 + dt.timedelta(days=1)), ("x.txt", "eve", T0)], "path string, username string, ts timestamp_ntz")
    after = {r["volume_key"]: r for r in ownership.apply_uploads(up, events).collect()}
    assert (after["S/v1.cbz"]["uploader_username"], after["S/v1.cbz"]["last_modified_by"]) == ("alice", "eve")
    assert (after["N/n.cbz"]["uploader_username"], after["N/n.cbz"]["last_modified_by"]) == ("eve", "fay") and len(after) == 5
    prefixes = spark.createDataFrame([("S_x",), ("",), ("/S/",)], "prefix string")
    assert pairs(ownership.forget_prefix(up, prefixes), "volume_key") == [("sax/v.cbz",)]
    assert pairs(ownership.forget_prefix(up, prefixes, "like"), "volume_key") == []
    assert pairs(ownership.forget_prefix(up, prefixes.where("prefix <> 'S_x'").union(spark.createDataFrame([("SAX",)], "prefix string")), "like"), "volume_key") == [("S_x/v.cbz",)]
    renames = spark.createDataFrame([("S/v1.cbz", "S/v2.cbz"), ("no.cbz", "S/v9.cbz"), ("S_x/v.cbz", "S_x/v.txt")], "old_path string, new_path string")
    assert pairs(ownership.rename_uploads(up, renames, now), "volume_key", "uploader_username") == [("S/v2.cbz", "alice"), ("S_x/v.cbz", "cat"), ("sax/v.cbz", "dan")]
    assert pairs(ownership.rename_folder(up, "S", "T/U", now), "volume_key", "uploader_username")[-3:] == [("T/U/v1.cbz", "alice"), ("T/U/v2.cbz", "bob"), ("sax/v.cbz", "dan")]
    left = ownership.delete_volumes(files(spark, "S/a.cbz", "S/a.ocr", "S/a.ocr.gz", "S/a.webp", "S/a.nocover", "S/b.cbz", "S/b.ocr"), spark.createDataFrame([("S/a.cbz",), ("S/b.ocr",)], "rel_path string"))
    assert pairs(left, "rel_path") == [("S/b.cbz",)]


def test_authorization_table(spark):
    roles = ["registered", "uploader", "inviter", "editor", "admin"]
    u = users(spark, *[(r, r, "active") for r in roles])
    up = uploads(spark, ("S/own.cbz", "uploader"))
    cases = [("PUT", "/reader/S/x.cbz"), ("DELETE", "/reader/S/own.cbz"), ("DELETE", "/reader/S/other.cbz"), ("PUT", "/reader/profiles.json"), ("GET", "/_admin/api/users"), ("GET", "/_admin/api/invites"), ("GET", "/_admin/x.js"), ("PUT", "/other"), ("MOVE", "/reader/S/x.cbz"), ("PROPPATCH", "/reader/profiles.json"), ("BREW", "/")]
    rows = [(k * 10 + j, m, p, None if j == 0 else roles[j - 1], "anonymous" if j == 0 else "ok") for k, (m, p) in enumerate(cases) for j in range(6)]
    rows += [(900, "OPTIONS", "/", None, "failed"), (901, "GET", "/", None, "failed"), (902, "GET", "/", None, "blocked"), (903, "GET", "/reader/S/x.cbz", None, "anonymous"), (904, "PROPFIND", "/", None, "anonymous"), (905, "GET", "/reader", None, "anonymous"), (906, "GET", "/x", None, "anonymous")]
    got = access.authorize(spark.createDataFrame(rows, schemas.REQUESTS), u, up, accounts.permission_matrix(spark), browse=False, download=False)
    code = {r["request_id"]: r["status_code"] for r in got.collect()}
    table = [[code[k * 10 + j] for j in range(6)] for k in range(len(cases))]
    assert table == [
        [401, 403, 200, 200, 200, 200],
        [401, 403, 200, 200, 200, 200],
        [401, 403, 403, 200, 200, 200],
        [401, 200, 200, 200, 200, 200],
        [401, 403, 403, 403, 403, 200],
        [401, 403, 403, 200, 403, 200],
        [200, 200, 200, 200, 200, 200],
        [403, 403, 403, 403, 403, 403],
        [401, 403, 403, 200, 200, 200],
        [401, 403, 403, 200, 200, 200],
        [200, 200, 200, 200, 200, 200],
    ]
    assert [code[i] for i in range(900, 907)] == [200, 401, 429, 401, 401, 401, 200]


def test_origins(spark):
    asks = spark.createDataFrame([(1, "https://a.b"), (2, "http://l:80"), (3, "http://l:x"), (4, "http://l"), (5, None), (6, "https://z.b")], "id int, origin string")
    patterns = spark.createDataFrame([("https://a.b",), ("http://l:*",), ("https://*.b",)], "pattern string")
    out = access.match_origin(asks, patterns)
    assert pairs(out, "id") == [(1,), (2,)] and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_limiter_replay(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(i, "k", at(i), "failure") for i in range(11)] + [(20, "k", at(100), "success"), (21, "k", at(915), "success"), (22, "k", at(916), "failure"), (30, "other", at(1), "failure")]
    got = {r["attempt_id"]: (r["allowed"], r["retry_after"]) for r in access.replay_limiter(spark.createDataFrame(rows, "attempt_id long, key string, ts timestamp, outcome string")).collect()}
    assert all(got[i] == (True, 0) for i in range(10)) and got[10] == (False, 900) and got[20] == (False, 811) and got[21] == (True, 0) and got[22] == (True, 0) and got[30] == (True, 0)
    edge = spark.createDataFrame([(1, "k", at(0), "failure"), (2, "k", at(300), "failure"), (3, "k", at(301), "x")], "attempt_id long, key string, ts timestamp, outcome string")
    assert pairs(access.failures_in_window(edge, 300), "attempt_id", "failures") == [(1, 1), (2, 2), (3, 1)]


def test_limiter_against_a_loop(spark):
    r = random.Random(11)
    for most, window, block in ((3, 300, 100), (1, 50, 400), (10, 300, 900), (0, 10, 20)):
        rows, wanted, state = [], {}, {}
        for i in range(400):
            key, at, outcome = r.choice(["a", "b", None]), 7 * i + r.randrange(3), r.choice(["failure", "failure", "failure", "success", "x", None][: r.choice([3, 6])])
            rows.append((i, key, T0 + dt.timedelta(seconds=at), outcome))
            kept, until = state.get(key, ([], -1))
            kept = kept if until > at else [f for f in kept if f >= at - window]
            if until > at:
                wanted[i] = (False, until - at + 1)
            elif len(kept) >= most:
                wanted[i], kept, until = (False, block), [], at + block
            else:
                wanted[i] = (True, 0)
                kept = kept + [at] if outcome == "failure" else [] if outcome == "success" else kept
            state[key] = (kept, until)
        got = access.replay_limiter(spark.createDataFrame(rows, "attempt_id long, key string, ts timestamp, outcome string"), most, window, block)
        assert {x["attempt_id"]: (x["allowed"], x["retry_after"]) for x in got.collect()} == wanted


def test_registrations_against_a_loop(spark):
    r = random.Random(12)
    day = dt.timedelta(days=1)
    codes = [f"c{i}" for i in range(12)]
    inv = spark.createDataFrame([(i, c, "editor", None, T0, T0 + day, None, None) for i, c in enumerate(codes)], schemas.INVITES)
    asked = [(i, r.choice(["ann", "new1", "new2", "new3", "new4", "x"]), r.choice([3, 9, 9, 9]), r.choice([*codes, "bad", ""])) for i in range(60)] + [(100, "anna", 9, "c0"), (101, "bert", 9, "c0")]
    taken, used, wanted = {"ann"}, set(), {}
    for i, name, length, code in asked:
        if len(name) < 3 or length < 8 or code not in codes or code in used:
            wanted[i] = 400
        elif name in taken:
            wanted[i] = 409
        else:
            wanted[i] = 201
            taken.add(name)
            used.add(code)
    rows = spark.createDataFrame(asked, "request_id long, username string, password_length int, invite_code string")
    got = accounts.register(rows, users(spark, ("ann", "admin", "active")), inv, "invite", F.lit(T0).cast("timestamp_ntz"))
    assert {x["request_id"]: x["status_code"] for x in got.collect()} == wanted
    probe = spark.createDataFrame([(1, "anna", 9, "X"), (2, "bert", 9, "X"), (3, "bert", 9, "Y")], "request_id long, username string, password_length int, invite_code string")
    two = spark.createDataFrame([(1, "X", "editor", None, T0, T0 + day, None, None), (2, "Y", "editor", None, T0, T0 + day, None, None)], schemas.INVITES)
    assert [x["status_code"] for x in accounts.register(probe, users(spark), two, "invite", F.lit(T0).cast("timestamp_ntz")).orderBy("request_id").collect()] == [201, 400, 201]


def test_sidecar_endings_of_a_deployment(spark):
    up = uploads(spark, ("S/v1.cbz", "alice"))
    asks = spark.createDataFrame([("/reader/S/v1.txt.gz", "alice"), ("/reader/S/v1.ocr", "alice")], "path string, username string")
    assert [r["may_delete"] for r in ownership.can_delete(asks, up, sidecar=".txt").orderBy("path").collect()] == [False, True]
    events = spark.createDataFrame([("N/n.txt", "eve", T0), ("N/m.ocr", "eve", T0)], "path string, username string, ts timestamp_ntz")
    assert pairs(ownership.apply_uploads(up, events, ".txt"), "volume_key") == [("N/n.cbz",), ("S/v1.cbz",)]
    assert ownership.forget_uploads(up, spark.createDataFrame([("S/v1.txt",)], "path string"), ".txt").count() == 0


def test_audit(spark):
    rows = [(i, "ann" if i else None, "edit", "library", "/reader/x" if i % 2 else None, "bob" if i == 2 else None, "d" * 130 if i == 1 else None, T0 + dt.timedelta(days=i)) for i in range(40)]
    log = spark.createDataFrame(rows, schemas.AUDIT)
    assert [r["id"] for r in audit.recent_audit(log, 3).collect()] == [39, 38, 37] and audit.recent_audit(log, 0).count() == 1
    assert audit.prune_audit(log, F.lit(T0 + dt.timedelta(days=35)).cast("timestamp_ntz")).count() == 35
    shown = {r["id"]: r for r in audit.audit_display(log).collect()}
    assert shown[0]["actor"] == "-" and shown[0]["target"] == "-" and shown[2]["target"] == "bob" and len(shown[1]["details"]) == 120
    changes = spark.createDataFrame([(1, "a", "write", "S/v.cbz", None, True, T0), (2, "a", "invite_used", "code", "b", None, T0)], "id long, actor string, change string, path string, username string, existed boolean, ts timestamp_ntz")
    assert pairs(audit.audit_from_changes(changes), "id", "action", "target_type") == [(1, "edit", "library"), (2, "invite_used", "invite")]


def test_current_progress_against_a_loop(spark):
    r = random.Random(7)
    rows, states = [], {}
    for i in range(120):
        job = r.choice("abc")
        fields = {k: r.choice([None, "1", "2"]) for k in r.sample(["x", "y"], r.randrange(3))} | {"status": r.choice(["running", "running", "done"])}
        rows.append((job, T0 + dt.timedelta(seconds=i // 2), i, fields))
        state = states.setdefault(job, {})
        if "started" not in state:
            state["started"], state["fields"] = rows[-1][1], {}
        state["fields"].update(fields)
        if fields["status"] == "done":
            states[job] = {}
    got = progress.current_progress(spark.createDataFrame(rows, "job string, ts timestamp_ntz, id int, fields map<string,string>"))
    assert {x["job"]: (x["started_at"], x["fields"]) for x in got.collect()} == {j: (s["started"], s["fields"]) for j, s in states.items() if s}


def test_stalled_jobs(spark):
    polls = [(1, float(t), 5, 10, False) for t in range(0, 800, 100)] + [(2, float(t), 10, 10, True) for t in range(0, 1100, 100)] + [(3, float(t), t // 100, 100, False) for t in range(0, 4000, 100)] + [(4, float(t), 10, 10, False) for t in range(0, 500, 100)]
    df = spark.createDataFrame(polls, "job long, at double, done long, total long, valid_sidecar boolean")
    assert pairs(progress.stalled_jobs(df), "job", "verdict") == [(1, "idle"), (2, "idle"), (3, "hard"), (4, "running")]
    assert pairs(progress.stalled_jobs(df, idle=5000), "job", "verdict") == [(1, "running"), (2, "finalized"), (3, "hard"), (4, "running")]


def test_names_that_hang_on_each_other(spark):
    chain = ["a"] + ["a" + "_1" * n for n in range(1, 40)] + ["a"] * 3 + ["a_1"] * 2
    incoming = [(i, n) for i, n in enumerate(chain + chain[::-1] + [None])]
    got = {r["id"]: r["stored_name"] for r in library.unique_names(spark.createDataFrame(incoming, "id int, name string"), spark.createDataFrame([("a",), (None,)], "name string")).collect()}
    assert got.pop(len(incoming) - 1) is None and got == _names_by_loop(incoming[:-1], ["a"])
    plan = library._named_in_order(spark.createDataFrame([("f", "n", 1, True)], "family string, name string, id int, asks boolean"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def _accepted_by_loop(rows):
    names, codes, out = set(), set(), []
    for i, name, code in sorted(rows):
        if name not in names and code not in codes:
            names.add(name)
            codes.add(code)
            out.append(i)
    return out


@pytest.mark.parametrize("queue_rows", [3, 40, 10**5])
def test_requests_are_accepted_in_order(spark, queue_rows):
    r = random.Random(queue_rows)
    rows = [(i, f"n{r.randrange(40)}", f"c{r.randrange(30)}") for i in range(150)]
    got = accounts._accepted(spark.createDataFrame(rows, "request_id int, username string, invite_code string"), queue_rows)
    assert [i for (i,) in pairs(got, "request_id")] == _accepted_by_loop(rows)


def test_a_chain_of_requests_takes_one_round(spark):
    chain = [(i, f"n{(i + 1) // 2}", f"c{i // 2}") for i in range(10_000)]  # each shares a name or an invite with the next
    frame = spark.createDataFrame(chain, "request_id int, username string, invite_code string").repartition(5)
    found = accounts._accepted(frame)
    assert [i for (i,) in pairs(found, "request_id")] == _accepted_by_loop(chain)
    assert "Union" not in found._jdf.queryExecution().analyzed().toString()  # accepted in one go
    assert [i for (i,) in pairs(accounts._accepted(frame, 4000), "request_id")] == _accepted_by_loop(chain)


@pytest.mark.parametrize("key_rows", [0, 150, 10**5])
def test_one_key_with_all_rows(spark, key_rows):
    """Windows over one key run over range blocks and give what a loop gives."""
    r = random.Random(8)
    at = sorted(r.randrange(40_000) for _ in range(900))
    rows = [(i, "k" if i % 9 else None, T0 + dt.timedelta(seconds=t), r.choice(["failure", "failure", "", "success"])) for i, t in enumerate(at)]
    attempts = spark.createDataFrame(rows, "attempt_id long, key string, ts timestamp_ntz, outcome string").repartition(4)
    counts = {(x["attempt_id"]): x["failures"] for x in access.failures_in_window(attempts.unionAll(attempts.where("attempt_id = 5")), 300).collect()}
    again = rows[5][3] == "failure"
    for i, key, ts, _ in rows:
        near = [x for x in rows if x[1] == key and ts - dt.timedelta(seconds=300) <= x[2] <= ts and x[3] == "failure"]
        assert counts[i] == len(near) + (again and rows[5] in near)
    got = {x["attempt_id"]: (x["allowed"], x["retry_after"]) for x in access.replay_limiter(attempts, 4, 300, 120, key_rows).collect()}
    for key in ("k", None):
        own = [x for x in rows if x[1] == key]
        made, _, _ = limiter.answers([((ts - dt.datetime(1970, 1, 1)).total_seconds(), o) for _, _, ts, o in own], [], 0.0, 4, 300, 120)
        assert [got[x[0]] for x in own] == made
    assert not all(a for a, _ in got.values())
    periods = []
    own = [x[2] for x in rows if x[1] == "k"]
    for a, b in zip([None, *own], own):
        if a is None or (b - a).total_seconds() >= 60:
            periods.append([b, 0])
        periods[-1] = [b, periods[-1][1] + 1]
    quiet = streams.debounced_refresh(attempts.where("key is not null").select(F.col("key").alias("library"), "ts"), 60)
    assert pairs(quiet, "refreshed_at", "events") == [(b + dt.timedelta(seconds=60), n) for b, n in periods]
    for df in (access.failures_in_window(attempts, 300), quiet):
        windows = [w for w in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in w and "__block" not in w]
        assert not windows


def test_patterns_meet_keys_by_their_literal_front(spark):
    keys = [f"{a}/{b}/v{n}.cbz" for a in ("Ab", "a_", "x%y", "B") for b in ("c", "cd", "C_d") for n in range(3)] + ["top.cbz"]
    up = uploads(spark, *((k, "u") for k in keys))
    for patterns in (["a_"], ["a%/c"], ["%"], ["_b/C_"], ["x\\%y/c"], ["ab/c", "b/%d"], ["zzz_", "%/%/%/%"], ["a_/c_d/v_.cbz%"]):
        match = lambda key, p: re.fullmatch("".join({"%": "(?s:.*)", "_": "(?s:.)"}.get(t, re.escape(t[-1])) for t in re.findall(r"\\.|.", p.lower() + "/%")), key.lower())
        left = ownership.forget_prefix(up, spark.createDataFrame([(p,) for p in patterns], "prefix string"), "like")
        assert pairs(left, "volume_key") == sorted((k,) for k in keys if not any(match(k, p) for p in patterns)), patterns
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString() and "Cross" not in plan
