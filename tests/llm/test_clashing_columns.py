import pytest
from pyspark.sql import functions as F

from shelfspark.llm import byte_bpe, decontaminate, exact_dedup, merkle, ngram_join, token_files, whitening

#: Columns that operators make for themselves, or return.
NAMES = ["ids", "n_tokens", "starts", "n_shingles", "component_id", "group", "row", "ranges", "items", "keep_id", "h", "body", "at", "tree", "siblings", "found", "__may", "__slot", "__part", "__bit", "__bits", "__row", "__id", "__text", "__one", "__sha", "__copy"]
TEXTS = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "A b  c d e f g h"), (4, "zz yy and others here"), (5, None), (None, "a b c d e f g h")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.select("*", *[F.lit(f"{n}!").alias(n) for n in NAMES])


@pytest.mark.parametrize("stage, kept", [("exact", [1, 3, 4, 5]), ("near", [1, 4, 5, None]), ("bench", [1, 2, 3, 5, None])])
def test_dropping_stages_keep_all_columns(spark, docs, stage, kept):
    bench = spark.createDataFrame([(9, "zz yy")], "item_id long, text string").withColumn("first", F.lit(3)).withColumn("block", F.lit(4))
    made = {"exact": lambda: exact_dedup.drop_copies(docs), "near": lambda: ngram_join.drop_near_copies(docs), "bench": lambda: decontaminate.drop_contaminated(docs, bench)}[stage]()
    assert made.columns == docs.columns
    rows = made.collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i)) == kept
    assert all(r[n] == f"{n}!" for r in rows for n in NAMES)
    named = docs.select(F.col("doc_id").alias("__key"), F.col("text").alias("__value"), "__may")
    if stage == "exact":
        assert sorted((r["__key"] for r in exact_dedup.drop_copies(named, "__key", "__value").collect())) == kept


def test_operators_ignore_other_columns(spark, docs):
    bench = spark.createDataFrame([(9, "zz yy")], "item_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, None: None}
    assert {r["doc_id"]: len(r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, None: 0}
    found = {r["doc_id"]: r["n_tokens"] for r in byte_bpe.digests(docs, byte_bpe.public_spec()).collect()}
    assert found[5] == 0 and found[1] == found[2] == found[None] == 8
    files = token_files.read_files(token_files.write_files(token_files.encode(docs, token_files.public_spec(), end_id=1)))
    assert {r["doc_id"]: r["n_tokens"] for r in files.collect()}[5] == 1
    proofs = merkle.prove(docs.select("*", F.lit("en").alias("lang")), fields=["doc_id", "text"])
    assert proofs.select("root").distinct().count() == 1 and proofs.count() == 6
    vectors = spark.createDataFrame([(1, [1.0, 2.0], "x", 3), (2, [2.0, 5.0], "y", 4)], "vec_id long, embedding array<double>, n string, component int")
    assert whitening.whiten(vectors).count() == 4
