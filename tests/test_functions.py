import itertools
import uuid
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from shelfspark import layout
from shelfspark.functions import paths, scalars


def values(spark, texts, column, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_volume_keys(spark):
    given = ["/S/v 01.cbz", "S/v01.CBZ", "S/v01.ocr", "S/v01.OCR.GZ", "S/v01.webp/", "S/v01.nocover", "S/v01.txt", "", "/", None, "a.ocr.gz.ocr"]
    assert values(spark, given, paths.volume_key) == ["S/v 01.cbz", "S/v01.CBZ", "S/v01.cbz", "S/v01.cbz", "S/v01.cbz", "S/v01.cbz", None, None, None, None, "a.ocr.gz.cbz"]


def test_names_and_titles(spark):
    assert values(spark, ["Trigun/Trigun 01.cbz", "v.cbz", " /v.cbz", "a/b/.cbz", "a/b/c.d.cbz"], paths.series_title) == ["Trigun", "v", "v", "b", "b"]
    assert values(spark, ["a.b.cbz", ".cbz", "a", "a."], paths.stem_of) == ["a.b", ".cbz", "a", "a."]
    assert values(spark, ["a/.b/c", ".a/b", "a/.b", "a/b"], paths.is_hidden) == [True, True, False, False]


def test_virtual_paths(spark):
    given = ["/", "/reader", "/reader/", "/reader/volume-data.json", "/reader/S/v.cbz", "/inbox", "/inbox/x", "/inboxes", "reader/profiles.json"]
    assert values(spark, given, paths.path_type) == ["root", "reader_root", "reader_root", "progress", "library", "inbox", "inbox", "unknown", "progress"]
    physical = lambda c: paths.to_physical(c, F.lit("ann"))
    assert values(spark, given, physical) == [None, None, None, "users/ann/volume-data.json", "library/S/v.cbz", "inbox", "inbox/x", None, "users/ann/profiles.json"]
    assert values(spark, ["/reader/../x", "/reader/a/../../x", "/reader/a/../b"], physical) == [None, None, "library/a/../b"]
    assert values(spark, ["/reader/profiles.json"], lambda c: paths.to_physical(c, F.lit(None).cast("string"))) == [None]
    assert values(spark, ["", "library", "library/S/v.cbz", "inbox/x", "users/ann/profiles.json", "users/ann/other", "etc"], paths.to_virtual) == ["/", "/reader", "/reader/S/v.cbz", "/inbox/x", "/reader/profiles.json", None, None]


def test_containment_against_a_walk(spark):
    def walk(path):
        depth = 0
        for part in path.split("/"):
            depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
            if depth < 0:
                return False
        return not path.startswith("/")

    given = ["/".join(p) for n in range(1, 5) for p in itertools.product(["a", "..", ".", ""], repeat=n)]
    assert values(spark, given, paths.is_contained) == [walk(p) for p in given]


def test_encoders(spark):
    given = ["a b/ü~*'()!", "100%+é/x", "", "日本/v_1-2.cbz"]
    assert values(spark, given, paths.quote_path) == [quote(t, safe="/") for t in given]
    assert values(spark, given, paths.encode_component) == [quote(t, safe="!~*'()") for t in given]


def test_headers_and_addresses(spark):
    given = [None, "Bearer x", "Basic YW5uOnB3", "Basic YW5u", "Basic /zo=", "Basic YW5uOmE6Yg==", "Basic Y", "basic YW5uOnB3"]
    got = values(spark, given, lambda c: F.to_json(paths.auth_header(c)))
    states = ['{"state":"anonymous"}'] * 2 + ['{"state":"basic","username":"ann"}'] + ['{"state":"malformed"}'] * 2 + ['{"state":"basic","username":"ann"}', '{"state":"malformed"}', '{"state":"anonymous"}']
    assert got == states
    assert values(spark, ["127.0.0.1", "127.255.0.9", "127.0.0.256", "127.0.0.01", "::1", "0:0:0:0:0:0:0:1", "::2", "x", None], paths.is_loopback) == [True, True, False, False, True, True, False, False, False]
    assert values(spark, ["a.json.gz", "v.OCR.gz", "v.CBZ", "x.tar.gz", "x.jpeg", ".cbz", "x"], paths.content_type) == ["application/gzip", "application/gzip", "application/vnd.comicbook+zip", "application/gzip", "image/jpeg", "application/octet-stream", "application/octet-stream"]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (scalars.format_reading_time, [0, 59, 60, 3599, 3600, 86399, 86400, 200000], ["0s", "59s", "1m", "59m", "1h 0m", "23h 59m", "1d 0h", "2d 7h"]),
        (scalars.format_eta_clock, [-5, 0, 61, 3661], ["0:0:00", "0:0:00", "0:1:01", "1:1:01"]),
        (scalars.format_eta_short, [None, 5, 65, 3700], ["", "5s", "1m 5s", "1h 1m"]),
        (scalars.format_count, [0, 999, 1000, 1234, 12_000, 1_000_000, 2_340_000], ["0", "999", "1K", "1.2K", "12K", "1M", "2.3M"]),
        (scalars.format_bytes, [0, 1, 1023, 1024, 1536, 1024**2, 5 * 1024**4, 5000 * 1024**4], ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "5 TB", "5000 TB"]),
        (scalars.format_uptime, [0, 61, 3661, 90061], ["0m", "1m", "1h 1m", "1d 1h 1m"]),
    ],
)
def test_formats(spark, function, given, wanted):
    assert values(spark, given, function, "long") == wanted


def test_texts_and_validation(spark):
    assert values(spark, [None, "", "abcdef", "abcdefg"], lambda c: scalars.truncate_text(c, 6)) == ["", "", "abcdef", "abc..."]
    assert values(spark, ["<a href='x'>&\"", None], scalars.escape_html) == ["&lt;a href=&#039;x&#039;&gt;&amp;&quot;", ""]
    assert values(spark, ["1h", "7D", "2w", "", "7", "d", "-1h", "0h", "x1h", "1m", None, "999999999w"], scalars.duration_seconds) == [3600, 604800, 1209600, None, None, None, None, None, None, None, None, 999999999 * 604800]
    assert values(spark, ["ab", "abc", "a b c", "a" * 33, "ok_-9", "abc\n", None], lambda c: scalars.username_error(c).isNull()) == [False, True, False, False, True, False, False]
    assert values(spark, [None, "", "short", "x" * 8, "x" * 129], scalars.password_error) == ["Password is required", "Password is required", "Password must be at least 8 characters", None, "Password must be at most 128 characters"]
    assert values(spark, ["writer", "editor", "king", None], scalars.normalize_role) == ["uploader", "editor", None, None]
    assert values(spark, ["", None, "k"], scalars.mask_secret) == ["", None, "****"]


def test_progress_metrics(spark):
    rows = spark.createDataFrame([(195, 195, 120.0), (97, 195, 60.0), (0, 10, 5.0), (5, 0, 1.0), (29, 100, 0.0), (299, 300, 1.0)], "d long, t long, e double")
    got = [tuple(r["m"]) for r in rows.select(scalars.progress_metrics(F.col("d"), F.col("t"), F.col("e")).alias("m")).collect()]
    assert got == [(100, 0, "finalizing"), (49, 60, "running"), (0, None, "running"), (None, None, "running"), (28, 0, "running"), (99, 0, "running")]


def test_title_uuid_is_version_five(spark):
    names = ["Trigun", "チーズスイートホーム", "", "a b"]
    assert values(spark, names, scalars.title_uuid) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert values(spark, ["Trigun"], scalars.title_uuid) == ["ea4b53cf-5e69-5290-8881-20eab80a41c5"]


def test_roles_are_complete():
    assert set(layout.PERMISSIONS) == set(layout.ROLES)
