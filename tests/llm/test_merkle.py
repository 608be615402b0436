import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, siblings int, at string, h string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def tree(leaves):
    """The levels of a tree, from its leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*run) for run in itertools.batched(levels[-1], 2)])
    return levels


def siblings(levels, at):
    return [dict(enumerate(level)).get(at >> k ^ 1) for k, level in enumerate(levels[:-1])]


def brute(rows):
    by_lang, first = {}, lambda v: (v is not None, v if v is not None else "")
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r)))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by_lang[g])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    return sorted(
        ((i if known else None, g, leaf, at, siblings(trees[g], at), trees[g][-1][0], siblings(top, n), top[-1][0]) for n, g in enumerate(langs) for at, (known, i, leaf) in enumerate(sorted(by_lang[g]))),
        key=lambda r: (first(r[1]), r[3]),
    )


def rows_of(spark, rows):
    got = merkle.prove(spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(3), keep={"leaf": merkle.leaf_hash([F.col(c) for c in merkle.FIELDS])})
    return got


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 300, 700])
def test_proofs_equal_brute_force(spark, n):
    rows = [(i * 3 if i % 50 else None, None if i % 7 == 0 else f"s{i % 4}", [None, "", "en", "en", "é", "de"][i % 6] if i < 290 else "en", None if i % 11 == 0 else i, None if i % 13 == 0 else "é" * (i % 5)) for i in range(n)]
    rows += rows[:20:7]  # repeated rows
    got = rows_of(spark, rows)
    key = lambda r: ((r["lang"] is not None, r["lang"] or ""), r["at"])
    found = [(r["doc_id"], r["lang"], r["leaf"], r["at"], r["siblings"], r["subroot"], r["group_siblings"], r["root"]) for r in sorted(got.collect(), key=key)]
    assert found == brute(rows)
    checked = got.select(merkle.folded(got, F.col("leaf")).alias("good"), merkle.folded(got, F.sha2(F.col("leaf"), 256)).alias("bad"), "root").collect()
    assert all(r["good"] == r["root"] != r["bad"] for r in checked)


def test_many_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGIT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = [(i, "s", "en" if i % 9 else "de", i, "x") for i in range(150)]  # eight levels in four tiers
    got = rows_of(spark, rows).collect()
    found = [(r["doc_id"], r["lang"], r["leaf"], r["at"], r["siblings"], r["subroot"], r["group_siblings"], r["root"]) for r in sorted(got, key=lambda r: (r["lang"], r["at"]))]
    assert found == brute(rows)


def test_a_block_is_shuffled_once_and_not_joined(spark):
    nodes = spark.range(600).select(F.concat(F.lit("e"), F.col("id") % 2).alias("tree"), (10 + F.col("id") % 1).cast("int").alias("depth"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.struct("id").alias("body"))
    plan = merkle._roll(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
