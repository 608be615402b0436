"""Scalar columns: formats, durations, progress figures, validation, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import layout


def _text(c: Column) -> Column:
    return c.cast("string")


def _div(a: Column, n: int) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.floor(a / n)


def format_reading_time(seconds: Column) -> Column:
    """Ns, Nm, Nh Nm or Nd Nh."""
    m, h = _div(seconds, 60), _div(seconds, 3600)
    return (
        F.when(seconds < 60, F.concat(_text(seconds), F.lit("s")))
        .when(m < 60, F.concat(_text(m), F.lit("m")))
        .when(h < 24, F.concat(_text(h), F.lit("h "), _text(m % 60), F.lit("m")))
        .otherwise(F.concat(_text(_div(seconds, 86400)), F.lit("d "), _text(h % 24), F.lit("h")))
    )


def format_eta_clock(seconds: Column) -> Column:
    """h:m:ss with plain minutes; below zero counts as zero."""
    s = F.greatest(F.lit(0), F.floor(seconds))
    return F.concat(_text(_div(s, 3600)), F.lit(":"), _text(_div(s % 3600, 60)), F.lit(":"), F.lpad(_text(s % 60), 2, "0"))


def format_eta_short(seconds: Column) -> Column:
    """Ns, Nm Ns or Nh Nm; null gives an empty text."""
    m = _div(seconds, 60)
    return (
        F.when(seconds.isNull(), "")
        .when(seconds < 60, F.concat(_text(seconds), F.lit("s")))
        .when(m < 60, F.concat(_text(m), F.lit("m "), _text(seconds % 60), F.lit("s")))
        .otherwise(F.concat(_text(_div(m, 60)), F.lit("h "), _text(m % 60), F.lit("m")))
    )


def format_count(n: Column) -> Column:
    """Whole numbers from a thousand as K or M with one decimal, halves up, without a closing .0."""
    tenths = lambda unit: F.floor((n + unit // 20) / (unit // 10))
    short = lambda t, end: F.concat(_text(_div(t, 10)), F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), _text(t % 10))), F.lit(end))
    return F.when(n >= 1_000_000, short(tenths(1_000_000), "M")).when(n >= 1000, short(tenths(1000), "K")).otherwise(_text(n))


def format_bytes(n: Column) -> Column:
    """Powers of 1024 up to TB with one decimal, without a closing .0; zero is 0 B."""
    power = reduce(lambda c, i: c.when(n >= 1024**i, i), range(4, 0, -1), F.when(F.lit(False), 0)).otherwise(0)
    value = F.regexp_replace(F.format_string("%.1f", F.round(n / F.pow(F.lit(1024.0), power), 1)), r"\.0\z", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(value, F.lit(" "), F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power)))


def format_uptime(seconds: Column) -> Column:
    """Nd Nh Nm without leading zero units."""
    d, h, m = _div(seconds, 86400), _div(seconds % 86400, 3600), _div(seconds % 3600, 60)
    minutes = F.concat(_text(m), F.lit("m"))
    hours = F.concat(_text(h), F.lit("h "), minutes)
    return F.when(d > 0, F.concat(_text(d), F.lit("d "), hours)).when(h > 0, hours).otherwise(minutes)


def truncate_text(text: Column, n: int) -> Column:
    """At most n code points, the last three dots where cut; null and empty give an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, max(n - 3, 0)), F.lit("...")))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(text, F.lit("")))


def duration_seconds(text: Column) -> Column:
    """Seconds of a positive whole number with h, d or w in either case; null for anything else."""
    number = F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*\+?([0-9]{1,9})\s*[hdwHDW]\z", 1), F.lit("")), F.lit("999999999")).cast("long")
    unit = F.lower(F.right(text, F.lit(1)))
    return F.when(number > 0, number * F.when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800))


def progress_metrics(done: Column, total: Column, elapsed: Column) -> Column:
    """struct(percent, eta_seconds, status) of a job; without a total only its status is known."""
    percent = F.least(F.lit(99).cast("long"), ((done.cast("double") / total) * 100).cast("long"))
    rate = done.cast("double") / F.greatest(elapsed.cast("double"), F.lit(1e-6))
    eta = F.when(done > 0, ((total - done) / rate).cast("long"))
    known, done_all = total > 0, (total > 0) & (done >= total)
    return F.struct(
        F.when(done_all, F.lit(100).cast("long")).when(known, percent).alias("percent"),
        F.when(done_all, F.lit(0).cast("long")).when(known, eta).alias("eta_seconds"),
        F.when(done_all, "finalizing").otherwise("running").alias("status"),
    )


def live_eta(eta: Column, updated_at: Column, now: Column) -> Column:
    """Seconds left now; null without an estimate or with a negative one."""
    return F.when(eta >= 0, F.greatest(F.lit(0), eta - F.greatest(F.lit(0), F.floor(now - updated_at))))


def title_uuid(name: Column) -> Column:
    """Version 5 UUID of the name in the DNS namespace (6ba7b810-9dad-11d1-80b4-00c04fd430c8)."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.get(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def etag(mtime: Column, size: Column) -> Column:
    """Modification time with six decimals, and the size where there is one."""
    stamp = F.format_string("%.6f", mtime.cast("double"))
    return F.when(size.isNull(), stamp).otherwise(F.concat(stamp, F.lit("-"), _text(size)))


def mask_secret(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise("****")


# The texts of refusals.
NAME_MISSING = "Username is required"
NAME_WRONG = "Username must be 3-32 characters and contain only letters, numbers, underscores, and hyphens"
PASSWORD_MISSING = "Password is required"
PASSWORD_SHORT = "Password must be at least 8 characters"
PASSWORD_LONG = "Password must be at most 128 characters"


def username_error(name: Column) -> Column:
    """Why a user name is refused; null if it is fine."""
    return F.when(F.coalesce(name, F.lit("")) == "", NAME_MISSING).when(~name.rlike(r"^[a-zA-Z0-9_-]{3,32}\z"), NAME_WRONG)


def password_error(password: Column) -> Column:
    n = F.char_length(password)
    return F.when(F.coalesce(password, F.lit("")) == "", PASSWORD_MISSING).when(n < 8, PASSWORD_SHORT).when(n > 128, PASSWORD_LONG)


def normalize_role(role: Column) -> Column:
    """The role under its present name; null if it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in layout.ROLE_ALIASES.items() for x in pair])
    now = F.coalesce(F.try_element_at(table, role), role)
    return F.when(now.isin(*layout.ROLES), now)


def matches(text: Column, query: str) -> Column:
    """Trimmed, case-insensitive substring; an empty query holds for every row."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.coalesce(F.lower(text).contains(q), F.lit(False))


def freshness(age: Column, ttl: float = 120, stale: float = 86400) -> Column:
    return F.when(age < ttl, "fresh").when(age < stale, "stale").otherwise("expired")
