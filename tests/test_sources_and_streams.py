import datetime as dt
import gzip
import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import access, library, progress
from shelfspark.sources import files, records
from shelfspark.sources import tree as tree_module
from shelfspark.streaming import events as streams

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "Trigun").mkdir()
    (root / "users/ann").mkdir(parents=True)
    with zipfile.ZipFile(root / "Trigun/Trigun 01.cbz", "w") as z:
        for n in (1, 2, 3):
            z.writestr(f"page_{n:03}.jpg", b"x" * n)
        z.writestr("info.txt", b"")
    (root / "Trigun/bad.cbz").write_bytes(b"no zip")
    (root / "Trigun/Trigun 01.ocr").write_text('{"title": "wrong", "n": NaN}')
    (root / "Trigun/v02.ocr.gz").write_bytes(gzip.compress(b'["x"]'))
    (root / "Trigun/v03.ocr.gz").write_bytes(b"not-gzip")
    (root / "Trigun/v04.ocr").write_text("{bad")
    (root / "users/ann/profiles.json").write_text("{}")
    (root / "users/ann/other.json").write_text("{}")
    return root


def test_scans(spark, tree, tmp_path):
    found = files.scan_files(spark, str(tree))
    assert ("Trigun/Trigun 01.ocr", 28) in pairs(found, "rel_path", "size") and found.count() == 8
    assert pairs(files.scan_user_files(spark, f"{tree}/users"), "username", "filename") == [("ann", "profiles.json")]
    found.write.parquet(f"{tmp_path}/m")
    assert files.read_manifest(spark, f"{tmp_path}/m").schema == schemas.FILES
    assert files.scan_existing(found, found.where("rel_path like '%.ocr'")).count() == 6


def test_written_files_are_whole_or_absent(spark, tmp_path):
    rows = spark.createDataFrame([("a b/x%1.txt", bytearray(b"one")), ("a b/c/empty", bytearray(b"")), ("top", bytearray(b"\x00\xff"))], "rel_path string, content binary")
    for _ in range(2):
        files.write_files(rows, str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"a b/x%1.txt": b"one", "a b/c/empty": b"", "top": b"\x00\xff"}
    files.write_files(rows.limit(0), f"{tmp_path}/none")


def test_archives(spark, tree):
    members = files.read_archive_members(spark, str(tree))
    assert len(pairs(members, "member")) == 4
    assert pairs(library.image_counts(files.scan_files(spark, str(tree)).where("rel_path like '%.cbz'"), members), "rel_path", "images") == [("Trigun/Trigun 01.cbz", 3), ("Trigun/bad.cbz", 0)]
    assert pairs(library.cover_member(members), "cover_member") == [("page_001.jpg",)]
    assert pairs(files.valid_archives(spark, str(tree)), "rel_path", "valid") == [("Trigun/Trigun 01.cbz", True), ("Trigun/bad.cbz", False)]


def test_sidecars(spark, tree):
    read = files.read_sidecars(spark, str(tree))
    assert pairs(read, "rel_path", "bytes_ok") == [("Trigun/Trigun 01.ocr", True), ("Trigun/v02.ocr.gz", True), ("Trigun/v03.ocr.gz", False), ("Trigun/v04.ocr", True)]
    checked = files.check_sidecars(read)
    assert [v for _, v in pairs(checked, "rel_path", "valid")] == [True, True, False, False]
    assert library.corrupt_count(checked, F.col("valid")).first()[0] == 2
    normal = {r["rel_path"]: r["json"] for r in files.normalize_sidecars(read).collect()}
    first = json.loads(normal["Trigun/Trigun 01.ocr"])
    assert (first["title"], first["volume"], first["title_uuid"]) == ("Trigun", "Trigun 01", "ea4b53cf-5e69-5290-8881-20eab80a41c5")
    assert normal["Trigun/v02.ocr.gz"] == '["x"]' and normal["Trigun/v04.ocr"] == "{bad"


def test_records(spark, tmp_path):
    texts = ['{"active":true,"series":"C","volume":"v01","percent":42,"eta_seconds":180}', '{"active":false}', "[1]", "{bad", None, '{"series":"x"}', '{"active":true}']
    got = records.read_progress(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "job int, json string"))
    assert pairs(got, "job", "percent", "done_pages", "status") == [(0, 42, 0, "running"), (6, 0, 0, "running")]
    lines = ["[REQUEST] [w-1] GET /a -> b -> 200 (0.123s)", "[REQUEST] [w] PUT /x -> EXCEPTION (1.000s): ValueError: bad: thing", "noise", "[REQUEST] [w] GET / -> ??? (0.001s)"]
    parsed = records.parse_request_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["path"], r["code"], r["elapsed"], r["exception"], r["message"]) for r in parsed] == [("/a -> b", 200, 0.123, None, None), ("/x", None, 1.0, "ValueError", "bad: thing"), ("/", None, 0.001, None, None)]
    log = spark.createDataFrame([(1, "a", "edit", None, None, None, "{}", dt.datetime(2024, 1, 2))], schemas.AUDIT)
    records.write_audit(log, f"{tmp_path}/audit")
    records.write_audit(log, f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").where("dt = date'2024-01-02'").count() == 2


# --- streams against their batch forms ---------------------------------------------------


def run_stream(spark, rows, schema, build, tmp_path, parts=4, mode="append"):
    """The rows of a streaming query fed in ordered parts, one batch each."""
    source = tmp_path / "in"
    for n in range(parts):
        part = rows[n * len(rows) // parts : (n + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/{n:03}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = []
    query = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return out


def test_settled_files_stream(spark, tmp_path):
    r = random.Random(3)
    at = sorted(r.sample(range(3000), 90))
    rows = [(r.choice("abcdef"), r.choice(["created", "modified", "modified", "deleted"]), T0 + dt.timedelta(seconds=s)) for s in at]
    rows += [("zz", "modified", T0 + dt.timedelta(seconds=10_000 + i)) for i in range(4)]
    got = run_stream(spark, rows, schemas.FILE_EVENTS, lambda s: streams.settled_files_stream(s, 60), tmp_path)
    batch = streams.settled_files(spark.createDataFrame(rows, schemas.FILE_EVENTS), 60)
    assert sorted((x["path"], x["settled_at"]) for x in got) == pairs(batch, "path", "settled_at") and got


def test_settled_files_stream_keeps_microseconds(spark, tmp_path):
    at = lambda us: T0 + dt.timedelta(microseconds=us)
    rows = [("a", "created", at(999_600)), ("b", "created", at(999_900)), ("b", "modified", at(61_000_100)), ("b", "deleted", at(62_000_000)), ("c", "modified", at(2_000_200)), ("c", "created", at(2_000_700)), ("c", "deleted", at(2_000_600))]
    rows += [("d", "created", at(3_000_900)), ("d", "modified", at(63_000_100)), ("d", "deleted", at(64_000_000))]
    rows = sorted(rows, key=lambda r: r[2]) + [("zz", "modified", T0 + dt.timedelta(seconds=10_000 + i)) for i in range(4)]
    got = run_stream(spark, rows, schemas.FILE_EVENTS, lambda s: streams.settled_files_stream(s, 60), tmp_path)
    batch = streams.settled_files(spark.createDataFrame(rows, schemas.FILE_EVENTS), 60)
    assert sorted((x["path"], x["settled_at"]) for x in got) == pairs(batch, "path", "settled_at")
    assert [x for x, _ in pairs(batch, "path", "settled_at")] == ["a", "b", "c"]


def test_limiter_stream(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), T0 + dt.timedelta(seconds=7 * i), r.choice(["failure", "failure", "failure", "success"])) for i in range(120)]
    schema = "attempt_id long, key string, ts timestamp, outcome string"
    got = run_stream(spark, rows, schema, lambda s: streams.login_limiter_stream(s, 3, 300, 100), tmp_path)
    batch = access.replay_limiter(spark.createDataFrame(rows, schema), 3, 300, 100)
    assert sorted((x["attempt_id"], x["allowed"], x["retry_after"]) for x in got) == pairs(batch, "attempt_id", "allowed", "retry_after")
    assert not all(x["allowed"] for x in got)


def test_debounce_and_first_event_streams(spark, tmp_path):
    rows = [("l%d" % (i % 2), T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 30, 31, 34, 39, 100, 101])] + [("end", T0 + dt.timedelta(days=2))]
    schema = "library string, ts timestamp"
    (tmp_path / "a").mkdir()
    got = run_stream(spark, rows, schema, lambda s: streams.debounced_refresh_stream(s, 5, "1 second"), tmp_path / "a")
    batch = streams.debounced_refresh(spark.createDataFrame(rows, schema), 5).where("library <> 'end'")
    assert sorted((x["library"], x["refreshed_at"], x["events"]) for x in got if x["library"] != "end") == pairs(batch, "library", "refreshed_at", "events")
    events = [("p%d" % (i % 3), "created", T0 + dt.timedelta(seconds=i)) for i in range(20)]
    once = run_stream(spark, events, schemas.FILE_EVENTS, streams.once_per_path, tmp_path)
    assert sorted(x["path"] for x in once) == ["p0", "p1", "p2"]


def test_job_streams(spark, tmp_path):
    polls = sorted([(1, float(t), 5, 10, False) for t in range(0, 800, 100)] + [(2, float(t), 10, 10, True) for t in range(0, 1100, 100)] + [(3, float(t), t // 100, 100, False) for t in range(0, 4000, 100)], key=lambda x: x[1])
    schema = "job long, at double, done long, total long, valid_sidecar boolean"
    (tmp_path / "a").mkdir()
    got = run_stream(spark, polls, schema, streams.stalled_jobs_stream, tmp_path / "a")
    batch = progress.stalled_jobs(spark.createDataFrame(polls, schema)).where("verdict <> 'running'")
    assert sorted((x["job"], x["verdict"], x["at"]) for x in got) == pairs(batch, "job", "verdict", "at")
    updates = [(i % 3, float(i), i * 10) for i in range(12)]
    latest = run_stream(spark, updates, "job int, ts double, percent int", streams.latest_progress_stream, tmp_path, mode="update")
    assert {x["job"]: x["percent"] for x in latest} == {0: 90, 1: 100, 2: 110}


def test_silent_jobs_get_a_verdict(spark, tmp_path):
    at = lambda t: dt.datetime.fromtimestamp(t, dt.timezone.utc)
    polls = [(1, 10.0, 5, 10, False, at(10)), (2, 20.0, 10, 10, True, at(20)), (4, 30.0, 1, 10, False, at(30))]
    polls += [(3, float(t), t // 100, 100, False, at(t)) for t in range(100, 6000, 100)] + [(4, 400.0, 2, 10, False, at(400))]
    polls.sort(key=lambda x: x[1])
    got = run_stream(spark, polls, "job long, at double, done long, total long, valid_sidecar boolean, ts timestamp", lambda s: streams.stalled_jobs_stream(s, watermark="0 seconds"), tmp_path, parts=30)
    found = {x["job"]: (x["verdict"], x["at"]) for x in got}
    assert len(got) == 4 and {j: v for j, (v, _) in found.items()} == {1: "idle", 2: "idle", 3: "hard", 4: "idle"}
    assert found[1][1] == pytest.approx(610, abs=0.01) and found[2][1] == pytest.approx(620, abs=0.01) and found[4][1] == pytest.approx(1000, abs=0.01)


def test_stream_sinks(spark, tmp_path):
    spark.createDataFrame([(1, "a", "edit", None, None, None, "{}", dt.datetime(2024, 1, 2))], schemas.AUDIT).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schemas.AUDIT).parquet(f"{tmp_path}/log")
    records.stream_audit(stream, f"{tmp_path}/audit", f"{tmp_path}/c1").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 1
    spark.createDataFrame([(1, True, 5.0), (2, True, 1.0), (2, False, 2.0)], "job int, active boolean, updated_at double").write.parquet(f"{tmp_path}/p")
    states = spark.readStream.schema("job int, active boolean, updated_at double").parquet(f"{tmp_path}/p")
    records.write_progress(states, f"{tmp_path}/now", f"{tmp_path}/c2").awaitTermination(120)
    now = lambda: pairs(records.read_snapshot(spark, f"{tmp_path}/now", states.schema), "job", "updated_at")
    assert now() == [(1, 5.0)]
    for rows, wanted in (([(3, True, 6.0)], [(1, 5.0), (3, 6.0)]), ([(1, False, 7.0), (3, True, 2.0)], [(3, 6.0)]), ([(3, False, 9.0)], []), ([(4, True, 10.0)], [(4, 10.0)])):
        spark.createDataFrame(rows, states.schema).write.mode("append").parquet(f"{tmp_path}/p")
        records.write_progress(states, f"{tmp_path}/now", f"{tmp_path}/c2").awaitTermination(120)
        assert now() == wanted
    assert len(records.versions(spark, f"{tmp_path}/now")) == 2
    for day in (3, 20, 40, 5):  # the last one comes late
        spark.createDataFrame([(day, "a", "edit", None, None, None, "{}", dt.datetime(2024, 1, 1) + dt.timedelta(days=day))], schemas.AUDIT).write.mode("append").parquet(f"{tmp_path}/log")
        records.stream_audit(stream, f"{tmp_path}/kept", f"{tmp_path}/c3", keep_days=30, clock=lambda: dt.datetime(2024, 2, 10, tzinfo=dt.UTC)).awaitTermination(120)
    assert pairs(records.read_audit(spark, f"{tmp_path}/kept", schemas.AUDIT), "id") == [(20,), (40,)]
    with open(tmp_path / "e.json", "w") as f:
        f.write('{"path":"a.cbz","kind":"created","ts":"2024-01-01T00:00:00Z"}\n')
    (tmp_path / "ev").mkdir()
    (tmp_path / "e.json").rename(tmp_path / "ev/e.json")
    query = files.stream_files(spark, f"{tmp_path}/ev").writeStream.format("memory").queryName("seen_files").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen_files").count() == 1


def test_a_stamp_from_the_future_deletes_nothing(spark, tmp_path):
    row = lambda i, at: (i, "a", "edit", None, None, None, "{}", at)
    (tmp_path / "log").mkdir()
    stream = spark.readStream.schema(schemas.AUDIT).parquet(f"{tmp_path}/log")
    clock, kept = [dt.datetime(2024, 1, 20, tzinfo=dt.UTC)], f"{tmp_path}/kept"
    days = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)

    def add(*rows):
        spark.createDataFrame(list(rows), schemas.AUDIT).write.mode("append").parquet(f"{tmp_path}/log")
        records.stream_audit(stream, kept, f"{tmp_path}/c", keep_days=30, clock=lambda: clock[0]).awaitTermination(120)
        return [i for (i,) in pairs(records.read_audit(spark, kept, schemas.AUDIT), "id")]

    assert add(*(row(i, days(i)) for i in range(5)), row(99, dt.datetime(2999, 1, 1)), row(98, None)) == [0, 1, 2, 3, 4, 98, 99]
    clock[0] = dt.datetime(2024, 2, 4, tzinfo=dt.UTC)
    assert add(row(30, days(30)), row(-3, days(-3))) == [4, 30, 98, 99]  # -3 is late and already too old
    clock[0] = dt.datetime(2024, 1, 5, tzinfo=dt.UTC)  # a clock that goes back brings nothing back
    assert add(row(31, days(3))) == [4, 30, 98, 99]
    clock[0] = dt.datetime(2024, 2, 25, tzinfo=dt.UTC)
    assert add(row(40, days(40))) == [30, 40, 98]  # the wrong stamp left with the day it came
    add(row(41, days(41)))
    names = sorted(p.name for p in (tmp_path / "kept").iterdir() if p.name.startswith("dt="))
    assert "dt=2024-01-05" not in names and len(names) == 4  # deleted once no version reads them


def test_a_finished_job_stays_finished(spark, tmp_path):
    schema = "job int, active boolean, updated_at double"
    (tmp_path / "p").mkdir()
    states, now = spark.readStream.schema(schema).parquet(f"{tmp_path}/p"), [1000.0]

    def add(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(f"{tmp_path}/p")
        records.write_progress(states, f"{tmp_path}/now", f"{tmp_path}/c", keep_finished=60, clock=lambda: now[0]).awaitTermination(120)
        return pairs(records.read_snapshot(spark, f"{tmp_path}/now", states.schema), "job", "updated_at")

    assert add((1, False, 10.0), (2, True, 4.0)) == [(2, 4.0)]
    assert add((1, True, 5.0)) == [(2, 4.0)]  # late
    assert add((1, False, 10.0), (1, True, 10.0)) == [(2, 4.0)]
    now[0] += 61
    assert add((2, True, 5.0)) == [(2, 5.0)]  # the tombstone of 1 is gone, counted from when it was first seen finished
    assert add((1, True, 5.0), (2, False, 6.0)) == [(1, 5.0)]
    assert add((2, True, 7.0)) == [(1, 5.0), (2, 7.0)]  # begun again


def test_a_tree_of_any_names_is_listed(spark, tmp_path):
    root = tmp_path / "t"
    for rel in ("_a.cbz", ".b", "_u/_v/c d%1.cbz", ".git/x", "s/.h/y", "s/e/f/g/h/i.ocr"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(rel)
    (root / "s/loop").symlink_to(root)
    (root / "s/gone").symlink_to(root / "nothing")
    (root / "empty").mkdir()
    found = files.scan_files(spark, str(root))
    assert pairs(found, "rel_path", "size") == sorted((r, len(r)) for r in ("_a.cbz", ".b", "_u/_v/c d%1.cbz", "s/e/f/g/h/i.ocr"))
    assert found.schema == schemas.FILES
    assert files.scan_files(spark, f"{tmp_path}/none").count() == 0
    many = tmp_path / "many"
    for n in range(150):  # more folders than a task lists below one
        (many / f"a/{n}/b").mkdir(parents=True)
        (many / f"a/{n}/b/x").write_text("")
    assert files.scan_files(spark, f"file://{many}").count() == 150


def test_a_tree_is_watched(spark, tmp_path):
    root, home = tmp_path / "t", f"{tmp_path}/home"
    write = lambda rel, text="x": ((root / rel).parent.mkdir(parents=True, exist_ok=True), (root / rel).write_text(text))
    for rel in ("s/v1.cbz", "s/v2.cbz", "s/v3.cbz", "_w.cbz"):
        write(rel)
    poll = lambda: tree_module.poll_tree(spark, str(root), home)
    seen = lambda n: {(r["path"], r["kind"], r["from_path"]) for r in spark.read.schema("path string, kind string, from_path string, ts timestamp").json(f"{home}/events/{n}").collect()}
    assert poll() == 0 and seen(0) == set()
    write("s/v1.cbz", "other")
    (root / "s/v2.cbz").rename(root / "moved.cbz")
    (root / "s/v3.cbz").unlink()
    for rel in ("new/_n.cbz", ".hidden", "s/.h/x.cbz"):
        write(rel)
    assert poll() == 1
    assert seen(1) == {("s/v1.cbz", "modified", None), ("moved.cbz", "moved", "s/v2.cbz"), ("s/v3.cbz", "deleted", None), ("new/_n.cbz", "created", None)}
    assert poll() == 2 and seen(2) == set()
    write("late.cbz")
    tree_module.list_tree(spark, str(root)).where("rel_path not like '%.hidden'").write.parquet(f"{home}/listing/version=3")  # a poll that died before its events
    assert poll() == 4 and seen(3) == {("late.cbz", "created", None)} and seen(4) == set() and tree_module.polls(spark, home) == [0, 1, 2, 3, 4]
    query = files.stream_files(spark, f"{home}/events").writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("watched").where("ts is not null").count() == 5
    first = tree_module.poll_tree(spark, str(root), f"{tmp_path}/other", existing=True)
    assert spark.read.json(f"{tmp_path}/other/events/{first}").where("kind = 'created'").count() == 5


def test_a_watch_is_a_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    query = tree_module.watch_tree(spark, f"{tmp_path}/t", f"{tmp_path}/home", seconds=0.2)
    assert files.stream_files(spark, f"{tmp_path}/home/events").isStreaming
    try:
        wait = lambda done: next((True for _ in range(300) if done() or time.sleep(0.2)), False)
        assert wait(lambda: len(tree_module.polls(spark, f"{tmp_path}/home")) > 0)
        (tmp_path / "t/a.cbz").write_text("x")
        found = lambda: [n for n in tree_module.polls(spark, f"{tmp_path}/home") if spark.read.schema("path string").json(f"{tmp_path}/home/events/{n}").where("path = 'a.cbz'").count()]
        assert wait(found) and len(found()) == 1
    finally:
        query.stop()


def test_moves_without_identity_need_to_be_clear(spark):
    schema = "rel_path string, size long, mtime_us long, file_id string"
    old = spark.createDataFrame([("a", 5, 1, None), ("b", 7, 2, None), ("c", 7, 2, None)], schema)
    new = spark.createDataFrame([("x", 5, 1, None), ("y", 7, 2, None), ("z", 7, 3, None)], schema)
    assert pairs(tree_module.changes(old, new).na.fill(""), "path", "kind", "from_path") == [("b", "deleted", ""), ("c", "deleted", ""), ("x", "moved", "a"), ("y", "created", ""), ("z", "created", "")]


def test_settled_paths_are_forgotten(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(f"p{i}", "created", at(i * 10)) for i in range(60)]
    rows += [("p0", "modified", at(100)), ("p0", "created", at(101)), ("q", "deleted", at(5)), ("q", "modified", at(6)), ("p1", "created", at(500))] + [("end", "modified", at(5000 + i)) for i in range(24)]
    rows.sort(key=lambda r: r[2])
    got = run_stream(spark, rows, schemas.FILE_EVENTS, lambda s: streams.settled_files_stream(s, 60, forget=120), tmp_path, parts=12)
    settled = sorted((x["path"], x["settled_at"] - T0.timestamp()) for x in got)
    # p0 settles at 60 and not again within 120 seconds; p1 settles at 70, is forgotten at 190 and settles anew
    assert settled == sorted([(f"p{i}", i * 10 + 60.0) for i in range(60)] + [("p1", 560.0)])
    assert spark.read.format("statestore").load(f"{tmp_path}/state", stateVarName="state").count() == 0


def test_members_of_one_archive_are_dealt_out(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for n, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
        with zipfile.ZipFile(root / f"m{n}.cbz", "w", method) as z:
            for k in range(60):
                z.writestr(f"é{k}.jpg" if k % 2 else f"{k}.jpg", bytes([k]) * 1000)
    whole = (root / "m0.cbz").read_bytes()
    (root / "cut.cbz").write_bytes(whole[:-5])
    for name, at in (("data.cbz", 40), ("head.cbz", 1), ("name.cbz", 31)):
        broken = bytearray(whole)
        broken[at] ^= 1
        (root / name).write_bytes(broken)
    secret = bytearray(whole)
    where = whole.index(b"PK\x01\x02")
    secret[where + 8] |= 1
    (root / "secret.cbz").write_bytes(secret)
    with zipfile.ZipFile(root / "empty.cbz", "w"):
        pass
    found = dict(pairs(files.valid_archives(spark, str(root)), "rel_path", "valid"))

    def plain(path):
        try:
            return zipfile.ZipFile(path).testzip() is None
        except (zipfile.BadZipFile, RuntimeError):
            return False

    assert found == {p.name: plain(p) for p in root.iterdir()} and found["m3.cbz"] and not found["secret.cbz"]
    assert files.read_archive_members(spark, str(root)).where("rel_path = 'm1.cbz'").count() == 60
    tasks = files._directories(files._placed(spark, str(root), "m0.cbz")).repartition(4).withColumn("task", F.spark_partition_id())
    assert tasks.select("task").distinct().count() == 4
