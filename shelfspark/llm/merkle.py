"""A Merkle manifest of a table: a tree for each language, one above them, and a proof for every row.

A leaf's place in its tree is its rank, written as digits of base 16: the last
digits name a node in a block of 256, the rest is the block. In a block the digits
are grouped away one after the other, each time nesting up to 16 children in their
parent as structs; the four binary levels of a digit are hashed there, and each child
takes its siblings. Blocks are dealt to tasks by (language, block), so a block is shuffled
once whatever the language. The roots of blocks are the leaves of the next tier, 256 times
smaller. On the way down a transform over the nested structs and one explode write the
proofs of a block; no node is joined with its children. Only what stands above a block
comes by an equi-join of one row a block, as a tree of any size cannot be one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.shared import discard, stored, table
from shelfspark.operators.running import running_total

#: Bits of a digit, and of a place in a block (two digits).
DIGIT = 4
BLOCK = 2 * DIGIT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(fields: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields, each as its length in bytes, a colon and its value, or ``-`` where null."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*written), 256)


def _depth(n: Column) -> Column:
    """Binary levels above n leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _runs(nodes: Column) -> Column:
    """The hashes of every two consecutive nodes; a last one alone gives its own hash."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))), 256))


def _climb(groups: DataFrame, base: int) -> DataFrame:
    """groups(kids sorted by digit) with ``h``, the hash after DIGIT more levels (fewer at the top of a tree), and in each kid
    ``sibs``: its sibling on each of these levels, null where its run has one node."""
    groups = groups.withColumn("__l0", F.transform("kids", lambda k: k["h"]))
    for j in range(DIGIT):
        groups = groups.withColumn(f"__l{j + 1}", F.when(F.col("depth") > base + j, _runs(F.col(f"__l{j}"))).otherwise(F.col(f"__l{j}")))
    levels = F.greatest(F.lit(0), F.least(F.lit(DIGIT), F.col("depth") - base)).cast("int")
    sibs = lambda i: F.slice(F.array(*[F.get(F.col(f"__l{j}"), F.shiftright(i, j).bitwiseXOR(F.lit(1))) for j in range(DIGIT)]), 1, levels)
    kids = F.transform("kids", lambda k, i: k.withField("sibs", sibs(i)))
    return groups.withColumn("kids", kids).withColumn("h", F.get(f"__l{DIGIT}", F.lit(0))).drop(*[f"__l{j}" for j in range(DIGIT + 1)])


def _roll(nodes: DataFrame, base: int) -> DataFrame:
    """nodes(tree, depth, at, h, body) to one row a block: tree, depth, at (of the block), h and kids, nested twice."""
    low = F.lit((1 << DIGIT) - 1)
    placed = nodes.withColumns({"block": F.shiftright("at", BLOCK), "d1": F.shiftright("at", DIGIT).bitwiseAND(low), "d0": F.col("at").bitwiseAND(low)})
    dealt = placed.repartition("tree", "block")  # both groupings below keep this partitioning
    fine = _climb(dealt.groupBy("tree", "depth", "block", "d1").agg(F.sort_array(F.collect_list(F.struct("d0", "h", "body"))).alias("kids")), base)
    coarse = _climb(fine.groupBy("tree", "depth", "block").agg(F.sort_array(F.collect_list(F.struct("d1", "h", "kids"))).alias("kids")), base + DIGIT)
    return coarse.select("tree", "depth", F.col("block").alias("at"), "h", "kids")


def _build(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of all trees, stored; the last has one row a tree, whose h is the root."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    tiers = [stored(_roll(nodes, 0), "merkle-tier")]
    while BLOCK * len(tiers) < deepest:
        tiers.append(stored(_roll(tiers[-1].select("tree", "depth", "at", "h", F.lit(None).cast("boolean").alias("body")), BLOCK * len(tiers)), "merkle-tier"))
    return tiers


def _emit(tiers: list[DataFrame], info: DataFrame) -> DataFrame:
    """tree, at, body, sibs and info's other columns for every leaf, from the top tier down; info has a row for each tree."""
    more = [c for c in info.columns if c != "tree"]
    above = info.select("tree", F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("sibs"), *more)
    for tier in reversed(tiers):
        up = above.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), F.col("sibs").alias("__sibs"), *more)
        rows = tier.join(up, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("at") == F.col("__at")))
        at = lambda a, b: F.shiftleft(F.col("at"), BLOCK) + F.shiftleft(a, DIGIT) + b
        each = F.flatten(F.transform("kids", lambda c: F.transform(c["kids"], lambda k: F.struct(at(c["d1"], k["d0"]).alias("at"), k["body"].alias("body"), F.concat(k["sibs"], c["sibs"], F.col("__sibs")).alias("sibs")))))
        above = rows.select("tree", F.explode(each).alias("k"), *more).select("tree", "k.at", "k.body", "k.sibs", *more)
    return above


def _ranked(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """rows with tree, at (rank from 0 in the tree) and depth of the tree."""
    at = running_total(rows, tree, order, F.lit(1), name, "__upto").withColumn("at", F.col("__upto") - 1).drop("__upto")
    if not tree:
        return at.withColumns({"tree": F.lit(0), "depth": F.lit(max(0, rows.count() - 1).bit_length())})
    key, sizes = tree[0], rows.groupBy(*tree).agg(_depth(F.count(F.lit(1))).alias("depth"))
    return at.withColumnRenamed(key, "tree").join(sizes.withColumnRenamed(key, "__of"), F.col("tree").eqNullSafe(F.col("__of"))).drop("__of")


def fold(start: Column, sibs: Column, at: Column) -> Column:
    """The root that a leaf and its siblings give; bit k of its place says on which side the sibling of level k is, null: alone."""
    step = lambda acc, s: F.sha2(F.when(s["h"].isNull(), acc).when(s["right"], F.concat(s["h"], acc)).otherwise(F.concat(acc, s["h"])), 256)
    each = F.transform(sibs, lambda h, k: F.struct(h.alias("h"), (F.floor(at / F.pow(F.lit(2.0), k)) % 2 == 1).alias("right")))
    return F.aggregate(each, start, step)


def prove(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, lang (the group), leaf, at, siblings (array, null where a run has one node), subroot, group_at,
    group_siblings, root, and the columns of keep, which are computed from the row.

    The group's leaves ascend by id (nulls first; rows that share an id by leaf), two consecutive nodes become their hash, a last
    one alone becomes its own hash, until one is left. The groups' roots, by group (null first, bytewise), likewise give root.
    Nulls in any field, in id and in group are values of their own. Empty tables give no rows. Other columns are ignored.
    """
    keep = keep or {}
    body = F.struct(F.col(id_col).alias("id"), *[c.alias(n) for n, c in keep.items()])
    leaves = stored(docs.select(F.col(group_col).alias("lang"), F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in fields]).alias("h"), body.alias("body")), "merkle-leaves")
    tiers = _build(_ranked(leaves, ["lang"], ["id", "h"], "merkle-ranks"))
    subroots = stored(tiers[-1].select("tree", "h"), "merkle-subroots")
    top = _build(_ranked(subroots.select(F.col("tree").alias("lang"), "h", F.col("tree").alias("body")), [], ["lang"], "merkle-groups"))
    root = top[-1].select("tree", F.col("h").alias("root"))
    groups = _emit(top, root).select(F.col("body").alias("tree"), F.col("at").alias("group_at"), F.col("sibs").alias("group_siblings"), "root")
    info = stored(groups.join(subroots.select(F.col("tree").alias("__of"), F.col("h").alias("subroot")), F.col("tree").eqNullSafe(F.col("__of"))).drop("__of"), "merkle-info")
    leaf = leaves_of(_emit(tiers, info), list(keep))
    discard(leaves, subroots, *top)  # the tiers are read by the result
    return leaf


def leaves_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(F.col("body.id").alias("doc_id"), F.col("tree").alias("lang"), "at", F.col("sibs").alias("siblings"), "subroot", "group_at", "group_siblings", "root", *[F.col("body")[n].alias(n) for n in keep])


def folded(rows: DataFrame, leaf: Column) -> Column:
    """The root for a row of prove, from this leaf and the siblings."""
    return fold(fold(leaf, F.col("siblings"), F.col("at")), F.col("group_siblings"), F.col("group_at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = leaf_hash([F.col(c) for c in FIELDS])
    changed = leaf_hash([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = prove(docs, keep={"leaf": leaf, "tampered": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)})
    proof = F.sha2(F.concat_ws("", "siblings", "group_siblings"), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(rows, F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


ORACLE_SQL = f"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t
), d AS (
  SELECT *, xor(list_reduce(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM documents, poly
), l AS (
  SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_field("CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END" if c == "n_chars" else c) for c in FIELDS)}) AS tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place
  FROM d
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), max((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), max((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, place // 2
), paths AS (
  SELECT l.doc_id, l.leaf, l.place, p.level, (l.place >> p.level) & 1 AS side, s.h FROM l
  JOIN nodes p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place >> p.level AND p.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = p.level AND s.place = xor(p.place, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.place, 1000 + p.level, (u.place >> p.level) & 1, s.h FROM l
  JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang
  JOIN tops p ON p.place = u.place >> p.level AND p.n > 1
  LEFT JOIN tops s ON s.level = p.level AND s.place = xor(p.place, 1)
), proofs AS (
  SELECT doc_id, leaf, place, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256, list(struct_pack(side := side, h := h) ORDER BY level) AS steps FROM paths GROUP BY doc_id, leaf, place
), folded AS (
  SELECT l.doc_id, l.leaf, u.subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(coalesce(steps, []), lambda acc, s: struct_pack(side := 0, h := sha256(CASE WHEN s.h IS NULL THEN acc.h WHEN s.side = 1 THEN s.h || acc.h ELSE acc.h || s.h END)), struct_pack(side := CAST(0 AS BIGINT), h := l.tampered)).h AS folded_root
  FROM l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proofs p ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf AND p.place = l.place
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
