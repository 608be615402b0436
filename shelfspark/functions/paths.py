"""Path columns: library keys, virtual and physical paths, routes, links."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import layout


def stripped(path: Column) -> Column:
    return F.trim(path, F.lit("/"))


def rooted(path: Column) -> Column:
    """The path with one leading slash and none at its end."""
    return F.concat(F.lit("/"), stripped(path))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(name: Column) -> Column:
    """The name without its last suffix; a leading or closing dot begins no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def is_hidden(path: Column) -> Column:
    """Whether a directory of the path starts with a dot; file names do not count."""
    return F.concat(F.lit("/"), path).rlike(r"/[.][^/]*/")


def series_of(path: Column) -> Column:
    """The relative directory, empty for a file in the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def volume_of(path: Column) -> Column:
    """The file name without its volume ending, in any case; null for other files."""
    name = name_of(path)
    return F.when(F.lower(name).endswith(layout.VOLUME), F.substring(name, F.lit(1), F.length(name) - len(layout.VOLUME)))


def volume_key(path: Column, sidecar: str = layout.SIDECAR) -> Column:
    """Key of a volume or of a file that belongs to one; null for other paths. The stem keeps its case, and a volume its ending."""
    clean = stripped(path)
    ends = "|".join(e.replace(".", r"\.") for e in sorted(layout.sidecars(sidecar), key=len, reverse=True))
    side = rf"(?i)({ends})\z"
    return F.when(clean.rlike(r"(?i)\.cbz\z"), clean).when(clean.rlike(side), F.regexp_replace(clean, side, layout.VOLUME))


def series_title(path: Column) -> Column:
    """Parent folder of a file, or its stem where that is the root or blank."""
    parts = F.split(path, "/")
    parent = F.trim(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))
    return F.coalesce(F.nullif(parent, F.lit("")), stem_of(name_of(path)))


def path_type(path: Column, root: str = layout.READER_ROOT) -> Column:
    clean = rooted(path)
    inner = F.substring(clean, len(root) + 3, 2**31 - 1)
    return (
        F.when(clean == "/", "root")
        .when(clean == f"/{root}", "reader_root")
        .when(clean.startswith(f"/{root}/"), F.when(inner.isin(*layout.PER_USER_FILES), "progress").otherwise("library"))
        .when((clean == f"/{layout.INBOX}") | clean.startswith(f"/{layout.INBOX}/"), "inbox")
        .otherwise("unknown")
    )


def is_contained(path: Column) -> Column:
    """Whether a relative path stays below its base at every step; absolute paths do not. Links are not followed."""
    step = lambda part: F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)
    fold = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda acc, part: F.struct((acc["depth"] + step(part)).alias("depth"), F.least(acc["least"], acc["depth"] + step(part)).alias("least")),
    )
    return ~path.startswith("/") & (fold["least"] >= 0)


def to_physical(path: Column, username: Column, root: str = layout.READER_ROOT) -> Column:
    """Storage path of a virtual path; null for virtual folders, unknown paths, escapes, and user files without a user."""
    clean = rooted(path)
    inner = F.substring(clean, len(root) + 3, 2**31 - 1)
    box = F.ltrim(F.substring(clean, len(layout.INBOX) + 2, 2**31 - 1), F.lit("/"))
    kind = path_type(path, root)
    return (
        F.when((kind == "progress") & (F.coalesce(username, F.lit("")) != ""), F.concat(F.lit("users/"), username, F.lit("/"), inner))
        .when((kind == "library") & is_contained(inner), F.concat(F.lit("library/"), inner))
        .when((kind == "inbox") & (box == ""), layout.INBOX)
        .when((kind == "inbox") & is_contained(box), F.concat(F.lit(f"{layout.INBOX}/"), box))
    )


def to_virtual(path: Column, root: str = layout.READER_ROOT) -> Column:
    """Virtual path of a storage path; null where there is none."""
    clean = stripped(path)
    parts = F.split(clean, "/")
    rest = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")
    head = F.get(parts, F.lit(0))
    return (
        F.when(clean == "", "/")
        .when((head == "library") & (F.size(parts) == 1), f"/{root}")
        .when(head == "library", F.concat(F.lit(f"/{root}/"), rest))
        .when(head == layout.INBOX, F.concat(F.lit("/"), clean))
        .when((head == "users") & (F.size(parts) >= 3) & F.get(parts, F.lit(2)).isin(*layout.PER_USER_FILES), F.concat(F.lit(f"/{root}/"), F.get(parts, F.lit(2))))
    )


def is_progress_file(path: Column, root: str = layout.READER_ROOT) -> Column:
    return path_type(path, root) == "progress"


def is_library_path(path: Column, root: str = layout.READER_ROOT) -> Column:
    return path_type(path, root) == "library"


def is_inbox_path(path: Column) -> Column:
    return (path == f"/{layout.INBOX}") | path.startswith(f"/{layout.INBOX}/")


def is_admin_path(path: Column) -> Column:
    return path.startswith("/_admin")


def is_invite_api_path(path: Column) -> Column:
    return (path == "/_admin/api/invites") | path.startswith("/_admin/api/invites/")


def is_browser(accept: Column, user_agent: Column) -> Column:
    """HTML in Accept means a browser; else the name of a file client means none; else a browser."""
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    return F.coalesce(accept, F.lit("")).contains("text/html") | ~reduce(or_, [agent.contains(c) for c in layout.DAV_CLIENTS])


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """First entry of X-Forwarded-For, else X-Real-IP, else the peer."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(F.get(F.split(forwarded, ","), F.lit(0))), given(real), remote)


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LOOPBACK = rf"^(127(\.{_OCTET}){{3}}|((0{{1,4}}:){{7}}|(0{{1,4}}(:0{{1,4}}){{0,5}})?::(0{{1,4}}:){{0,5}})0{{0,3}}1)\z"


def is_loopback(ip: Column) -> Column:
    """127.0.0.0/8 or a form of ::1; false for anything else, null included."""
    return F.coalesce(ip.rlike(LOOPBACK), F.lit(False))


def auth_header(header: Column) -> Column:
    """struct(state, username): anonymous without a Basic header, malformed if it cannot be read, else basic. The password is never returned."""
    code = F.regexp_replace(F.substring(header, 7, 2**31 - 1), "[^A-Za-z0-9+/=]", "")
    text = F.try_validate_utf8(F.try_to_binary(code, F.lit("base64")).cast("string"))
    basic = F.coalesce(header.startswith("Basic "), F.lit(False))
    readable = text.isNotNull() & text.contains(":")
    return F.struct(
        F.when(~basic, "anonymous").when(readable, "basic").otherwise("malformed").alias("state"),
        F.when(basic & readable, F.substring_index(text, ":", 1)).alias("username"),
    )


def content_type(path: Column, sidecar: str = layout.SIDECAR) -> Column:
    name = F.lower(name_of(path))
    table = F.create_map(*[F.lit(x) for pair in layout.CONTENT_TYPES.items() for x in pair])
    return F.when(name.endswith(".json.gz") | name.endswith(f"{sidecar}.gz"), "application/gzip").otherwise(F.coalesce(F.try_element_at(table, suffix_of(name)), F.lit("application/octet-stream")))


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def quote_path(path: Column) -> Column:
    """Percent-encoding that keeps letters, digits, ``_.-~`` and slashes."""
    return _replaced(F.url_encode(path), {"+": "%20", "%7E": "~", "*": "%2A", "%2F": "/"})


def encode_component(text: Column) -> Column:
    """Percent-encoding of one URL component, which also keeps ``!~*'()``."""
    return _replaced(F.url_encode(text), {"+": "%20", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"})


def reader_link(series: Column, volume: Column, cover: Column, reader_url: str, origin: str, root: str = layout.READER_ROOT) -> Column:
    """Link that opens a volume in the reader; a cover is added where there is one."""
    archive = F.concat(F.lit(f"{origin}/{root}/"), encode_component(series), F.lit("/"), encode_component(volume), F.lit(layout.VOLUME))
    return F.concat(F.lit(f"{reader_url}/#/upload?cbz="), F.url_encode(archive), F.when(F.coalesce(cover, F.lit("")) != "", F.concat(F.lit("&cover="), F.url_encode(cover))).otherwise(""))
