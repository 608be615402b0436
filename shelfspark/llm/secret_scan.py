"""Secret scans over a trigram inverted index, DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: the
strings that every match must contain, as an AND of ORs of trigram sets. The
index holds the posting lists (trigram, doc_id) of the trigrams that some query
names; it is written to the shared folder, in the order of the trigrams. A rule's
query selects its posting lists by trigram; documents that are on all lists of a
set satisfy it, and those that satisfy every clause are candidates of the rule.

Only texts of candidates are shuffled, to meet their rules; a bitmap of their ids
tells the others. A rule without mandatory trigrams has no query and scans every
text, candidate or not, where it is read.

Places come from the text between the matches: the pieces that split() leaves and
the matches themselves alternate, so running lengths give code point offsets.
The running sums are taken in blocks, so a text with many matches stays linear.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import flagged, stored, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1


#: Base rules first, then those that the scan adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
)
BASE_KINDS = ("assign", "access", "hex")
#: Strings that one part of a pattern may stand for before it counts as open.
MOST_STRINGS = 16

# --- from a pattern to a Boolean trigram query ---------------------------------


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses, each an OR of trigram sets (lower case), that hold for every text with a match. Empty: no mandatory trigrams."""
    clauses: list[list[frozenset[str]]] = []
    held = _walk(re._parser.parse(pattern), {""}, clauses)
    _close(held, clauses)
    return clauses


def _close(held: set[str], clauses: list) -> set[str]:
    if min(map(len, held)) >= 3:
        clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in held}, key=sorted))
    return {""}


def _strings(parsed) -> set[str] | None:
    """All strings that a part of a pattern matches, in lower case, or None if they are many."""
    out = {""}
    for op, arg in parsed:
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part = _strings(arg[3])
        elif op is sre.BRANCH:
            each = [_strings(b) for b in arg[1]]
            part = None if None in each else set().union(*each)
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            part = _strings(arg[2])
            part = part if part is None or arg[0] else part | {""}
        elif op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[1] <= 8:
            one = _strings(arg[2])
            part = {s * arg[0] for s in one} if one and len(one) == 1 else None
        else:
            part = None
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _walk(parsed, held: set[str], clauses: list) -> set[str]:
    for item in parsed:
        op, arg = item
        part = _strings([item])
        if part is not None and len(held) * len(part) <= MOST_STRINGS:
            held = {a + b for a in held for b in part}
            continue
        held = _close(held, clauses)
        if part is not None:
            held = part
        elif op is sre.SUBPATTERN:
            held = _close(_walk(arg[3], {""}, clauses), clauses)
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            _close(_walk(arg[2], {""}, clauses), clauses)
    return held


# --- the index -------------------------------------------------------------------


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of docs(doc_id, text), stored in the shared folder; trigrams in lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains("low", t))
    return stored(low.select(F.explode(present).alias("trigram"), "doc_id").sortWithinPartitions("trigram"), "secret-postings")


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(doc_id, rules): the rules whose Boolean query the posting lists satisfy.

    A query is rows (rule, clause, set, trigram), as many as the rules name. They select posting lists by trigram; a
    document that is on as many lists as a set has trigrams satisfies the set, one set satisfies its clause, and all
    clauses the rule.
    """
    spark = index.sparkSession
    asked = [(kind, c, k, len(grams), len(query), g) for kind, query in queries.items() for c, clause in enumerate(query) for k, grams in enumerate(clause) for g in sorted(grams)]
    wanted = spark.createDataFrame(asked, "rule string, clause int, alternative int, trigrams int, clauses int, trigram string")
    postings = index.join(F.broadcast(wanted), "trigram")  # the rules' own trigrams, whatever the corpus
    held = postings.groupBy("doc_id", "rule", "clauses", "clause", "alternative", "trigrams").agg(F.count_distinct("trigram").alias("n")).where("n = trigrams")
    fits = held.groupBy("doc_id", "rule", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return fits.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


# --- verification ------------------------------------------------------------------


#: Numbers of a block of a running sum.
_RUN = 128


def _running(numbers: Column, begin: Column) -> Column:
    """begin plus the running sums of a short array."""
    return F.slice(F.aggregate(numbers, F.array(begin), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(2), F.size(numbers))


def running_sums(numbers: Column) -> Column:
    """The running sums of an array<int>: within blocks, and over the blocks' totals, so that no long array is copied for each number.

    Values that are needed twice go through an array of one, whose lambda sees them evaluated.
    """
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / _RUN).cast("int")), lambda b: F.slice(x, b * _RUN + 1, F.lit(_RUN)))
    totals = lambda blocks: _running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n)), F.lit(0))
    summed = lambda blocks: F.flatten(F.zip_with(blocks, totals(blocks), lambda b, after: _running(b, after - F.aggregate(b, F.lit(0), lambda acc, n: acc + n))))
    blocks = F.element_at(F.transform(F.array(numbers), cut), 1)
    return F.element_at(F.transform(F.array(blocks), summed), 1)


def _starts(gaps: Column, matches: Column) -> Column:
    """The offset of each match: running lengths of gaps and matches. Lambdas see their own arguments only, so nothing is evaluated per match twice."""
    before = F.concat(F.array(F.lit("")), F.slice(matches, F.lit(1), F.size(matches) - 1))
    return running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), before, lambda g, m: F.length(g) + F.length(m)))


_NONE = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"


def _spans(rule: Rule, order: int, text: Column, may: Column) -> Column:
    """Spans of one rule: array<struct<start, order, kind, end, value>>."""
    pattern, none = F.lit(rule.pattern), F.array().cast(_NONE)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    made = F.zip_with(_starts(F.split(text, rule.pattern, -1), matches), matches, lambda s, m: F.struct(s.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")))
    if rule.least > 1:
        counted = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        made = F.filter(F.zip_with(made, counted, lambda x, m: F.when(F.length(m) >= rule.least, x)), lambda x: x.isNotNull())
    return F.when(may & text.rlike(rule.pattern), made).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, value>>, by start, then rule order; one row per row of docs.

    Null text counts as empty: no spans. Null and repeated ids stay as they are (ids that repeat share their candidate
    rules, and each text is verified); other columns are ignored; an empty table gives an empty result. Spans of different
    rules may overlap, and all are given. Very long texts are taken whole; the work grows with the text and its matches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({g for q in queries.values() for clause in q for grams in clause for g in grams})
    always = lambda r: F.lit(r.kind not in queries)
    text = F.col("text")

    def placed(found: DataFrame, may, of: list[tuple[int, Rule]]) -> DataFrame:
        each = [_spans(r, k, text, may(r)) for k, r in of] or [F.array().cast(_NONE)]
        return found.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))

    open_rules = [(k, r) for k, r in enumerate(rules) if r.kind not in queries]
    if queries:
        may = stored(candidates(build_index(rows, trigrams), queries), "secret-candidates").withColumnRenamed("doc_id", "__id")
        near = flagged(rows, "doc_id", may, "__id", "may")
        met = near.where("may").join(may, F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
        made = placed(near.where("not may"), always, open_rules).unionAll(placed(met, lambda r: F.array_contains("rules", r.kind) if r.kind in queries else F.lit(True), list(enumerate(rules))))
    else:
        made = placed(rows, always, open_rules)
    return made.select("doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(*kinds: str):
    return lambda s: s["kind"].isin(*kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", of_kind(*BASE_KINDS))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle(rules: tuple[Rule, ...]) -> str:
    parts = []
    for k, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, '{r.kind}' AS kind, {k} AS o, s, s + length(m) AS e FROM (
    SELECT doc_id, unnest(m) AS m, unnest(n) AS n, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS n, string_split_regex(text, '{pattern}') AS g FROM d WHERE regexp_matches(text, '{pattern}'))
  ) WHERE length(n) >= {r.least}""")
    label = "kind || ':' || s || ':' || e"
    base = f"kind IN ({', '.join(repr(k) for k in BASE_KINDS)})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(parts)}), a AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
    string_agg({label}, ',' ORDER BY s, o) FILTER ({base}) AS base, string_agg({label}, ',' ORDER BY s, o) AS spans
  FROM f GROUP BY doc_id
)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = _oracle(RULES)
