"""Personal data: patterns propose spans, checksums and ranges confirm them, context words adjust the score.

Email, ip, card and phone spans are always reported when their check passes; IBANs
(length of the country, mod 97) and identity numbers (areas and groups that are given
out, and only with a context word) are added to them. Every
kind is searched leftmost and without overlap in the whole text; the searches
look only at places that hold the kind's fixed character, and are linear in the text.
Offsets are code points, the end exclusive. Map-only: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import table
from shelfspark.shipping import map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "identity")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Each country with the characters that its length leaves, in groups of four that a space may separate."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n - 4, []).append(country)
    one = [f"(?:{'|'.join(who)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, who in sorted(by_length.items())]
    return rf"\b(?:{'|'.join(one)})\b"


IBAN_PATTERN, IDENTITY_PATTERN = _iban_pattern(), "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_IBAN, _IDENTITY = re.compile(IBAN_PATTERN, re.ASCII), re.compile(f"(?<![0-9-]){IDENTITY_PATTERN}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: Score of a confirmed span, what a context word adds, and the words (fixed values).
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "identity": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, LEAST_SCORE = 0.3, 48, 0.5
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "cards", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "identity": ("ssn", "social security", "identity", "id number"),
}
CONTEXT_PATTERNS = {kind: r"\b(?:" + "|".join(words) + r")\b" for kind, words in CONTEXT.items()}
_CONTEXT = {kind: re.compile(pattern, re.IGNORECASE | re.ASCII) for kind, pattern in CONTEXT_PATTERNS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def given_out(number: str) -> bool:
    """Whether an identity number can exist: areas 000, 666 and 900 to 999, group 00 and serial 0000 are never given out."""
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, context) by start, then kind as in KINDS."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m.group().replace(" ", ""))]
        found += [("identity", *m.span()) for m in _IDENTITY.finditer(text) if given_out(m.group())]
    out = []
    for kind, a, b in found:
        near = bool(_CONTEXT[kind].search(text[max(0, a - CONTEXT_CHARS) : a]) or _CONTEXT[kind].search(text[b : b + CONTEXT_CHARS]))
        score = min(1.0, SCORES[kind] + CONTEXT_BONUS * near)
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            out.append((kind, a, b, score, near))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score, context, value>>, one row per row of docs.

    Null text counts as empty: no spans. Repeated and null ids stay as they are; other columns are ignored; an empty table
    gives an empty result. Spans of different kinds may overlap, and all are given; those that begin together are in the order
    of KINDS. Very long texts are taken whole, in time linear in their length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("context", pa.bool_()), ("value", pa.string())]

    def run(batches):
        for batch in batches:
            rows = [[(*s, text[s[1] : s[2]]) for s in spans_of(text)] for text in batch.column(1).to_pylist()]
            spans = pa.array([[dict(zip([f for f, _ in fields], s, strict=True)) for s in row] for row in rows], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double,context:boolean,value:string>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind in brackets; null text stays null, overlaps merge under the first kind."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for text in batch.column(at).to_pylist():
                parts, last = [], 0
                for kind, a, b, _, _ in spans_of(text) if text else ():
                    if a >= last:
                        parts += [text[last:a], f"[{kind}]"]
                    last = max(last, b)
                out.append("".join([*parts, text[last:]]) if text else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return map_arrow(docs, run, schema)


def of_kind(*kinds: str):
    return lambda s: s["kind"].isin(*kinds)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", of_kind(*BASE_KINDS))
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) ELSE CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) * 2 - CASE WHEN substr(d, length(d) - i + 1, 1) > '4' THEN 9 ELSE 0 END END))"
    moved = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    rest97 = f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CAST(CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, CAST(0 AS BIGINT))"
    near = "regexp_matches(substr(text, CAST(greatest(s - {n}, 0) AS BIGINT) + 1, CAST(s - greatest(s - {n}, 0) AS BIGINT)), '(?i){p}') OR regexp_matches(substr(text, e + 1, {n}), '(?i){p}')".format(n=CONTEXT_CHARS, p=CONTEXT_PATTERNS["identity"])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST(left('0' || ltrim(x, '0'), 4) AS INTEGER) <= 255))"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 12 AND 19 AND {luhn_sum} % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
        ("iban", IBAN_PATTERN, f"{rest97} = 1"),
        ("identity", IDENTITY_PATTERN, f"substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000' AND (s = 0 OR NOT regexp_matches(substr(text, s, 1), '[0-9-]')) AND NOT regexp_matches(substr(text, e + 1, 1), '[0-9-]') AND ({near})"),
    ]
    parts = [f"""
  SELECT doc_id, '{kind}' AS kind, {k} AS o, s, e FROM (SELECT *, CAST(s + length(m) AS BIGINT) AS e, {digits} AS d FROM (
    SELECT doc_id, text, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t WHERE regexp_matches(text, '{pattern}'))
  )) WHERE {check}""" for k, (kind, pattern, check) in enumerate(kinds)]
    label, base = "kind || ':' || s || ':' || e", f"kind IN ({', '.join(map(repr, BASE_KINDS))})"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(parts)}), a AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
    string_agg({label}, ',' ORDER BY s, o) FILTER ({base}) AS base, string_agg({label}, ',' ORDER BY s, o) AS spans
  FROM f GROUP BY doc_id
)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = _oracle()
