"""Exact dedup by an extendible-hash index, DataFrame functions only.

The 64-bit hash of the normalised text is the index key. A directory maps the
leading bits of the key to buckets; a bucket with more distinct keys than its
capacity is split on the next bit, which doubles the directory where the bucket
was already as deep as the directory. The final directory depends only on the
keys, so it is computed level by level from key counts, not key by key.

Every row goes through the directory to its bucket. There whole texts are
compared: texts with equal keys but different bytes are separate entries of one
chain. Owner tasks, each with a range of buckets and keys, number the chains and
write the index (bucket, depth, key, chain position, digest of the bytes, first id,
group size) to the shared folder. A document then looks its bucket and key up and
walks that chain to the entry with its bytes.

Copies never meet in one task: they are folded into one entry per text before
the shuffle, and the lookup is a plain equi-join that Spark splits when skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.shared import discard, flagged, own_names, stored, table

#: Deepest directory: at most 2**MAX_DEPTH slots, whatever the corpus, so that the directory may be broadcast.
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def build_directory(keys: DataFrame, capacity: int = 4096) -> tuple[DataFrame, int]:
    """Directory of the distinct keys in column ``h``: (slot, bucket, local_depth), and the global depth.

    ``capacity`` is the most distinct keys of a bucket; it grows with the number of keys beyond
    2**(MAX_DEPTH - 3) * capacity, which bounds the directory. No keys give one slot and one bucket.
    """
    spark = keys.sparkSession
    cells = stored(keys.select("h").distinct().groupBy(F.shiftrightunsigned("h", 64 - MAX_DEPTH).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "dedup-cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    capacity = max(capacity, -(-total // 2 ** (MAX_DEPTH - 3)))
    levels = cells.select("n", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(f"cell >> {MAX_DEPTH - d}").alias("prefix")) for d in range(MAX_DEPTH + 1)])).alias("at")).groupBy("at.depth", "at.prefix").agg(F.sum("n").alias("n"))
    split = levels.where((F.col("n") > capacity) & (F.col("depth") < MAX_DEPTH)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.expr("prefix * 2"), F.expr("prefix * 2 + 1"))).alias("prefix"))
    root = spark.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    over = levels.where(F.col("n") > capacity).select("depth", "prefix", F.lit(True).alias("over"))
    leaves = root.unionByName(split).join(over, ["depth", "prefix"], "left").where(F.col("over").isNull() | (F.col("depth") == MAX_DEPTH)).select("depth", "prefix")
    leaves = stored(leaves, "dedup-buckets")
    discard(cells)
    depth = leaves.agg(F.max("depth").alias("d")).first()["d"]
    first = F.expr(f"prefix * cast(pow(2, {depth} - depth) as bigint)")
    slots = leaves.select(F.explode(F.sequence(first, first + F.expr(f"cast(pow(2, {depth} - depth) as bigint)") - 1)).alias("slot"), first.alias("bucket"), F.col("depth").alias("local_depth"))
    return slots, depth


def default_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def build_index(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The stored index of rows(doc_id, norm, h): bucket, local_depth, h, chain_pos, sha, keep_id, group_size, in ranges of (bucket, h).

    One entry for each text of a key; the entries of a key are its chain, in the order of their first ids.
    """
    entries = in_bucket(rows, slots, depth).groupBy("bucket", "local_depth", "h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # without texts, and stored, for range partitioning reads its rows twice
    slim = stored(entries.select("bucket", "local_depth", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "dedup-entries")
    chained = slim.repartitionByRange("bucket", "h").withColumn("chain_pos", F.row_number().over(Window.partitionBy("bucket", "h").orderBy(F.col("keep_id").asc_nulls_last(), "sha")))
    made = stored(chained, "dedup-index")
    discard(slim)
    return made


def in_bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows(h) with bucket and local_depth, by the slot that the leading bits of h name. The directory has at most 2**MAX_DEPTH slots."""
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    return rows.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, also: Sequence[str] = (), key: Callable[[Column], Column] = default_key) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain_pos.

    Null text counts as empty, empty texts are copies of each other; a null id sorts last and is never kept
    while another id of its group exists. Rows that repeat an id with the same text count in group_size and
    get the same decision. Columns named in ``also`` come last, other ones are ignored; an empty table gives an empty result.
    Texts are compared whole, whatever their length. ``key`` gives the 64-bit key of a text; a poor one makes longer chains, not other groups.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), *also).withColumn("h", key(F.col("norm")))
    slim = stored(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), *also), "dedup-keys")
    slots, depth = build_directory(slim, capacity)
    index = build_index(rows.select("doc_id", "norm", "h"), slots, depth)
    found = in_bucket(slim, slots, depth).join(index.drop("local_depth"), ["bucket", "h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "local_depth", "chain_pos", *also)


@own_names
def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each text, of those with its smallest id; all columns stay. Rows are decided one by one, so an id may repeat or be null.

    Only rows that a bitmap of the copies' ids flags are shuffled; the others stay where they are. Of rows that
    repeat the smallest id with its text one is kept.
    """
    found = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256", "keep_id").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marks = stored(found.where(~own | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__text"), own.alias("__one")), "dedup-marks")
    near = flagged(docs, id_col, marks, "__id", "__may")
    met = near.where("__may").withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256)).join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__text")), "left")
    # of rows with a mark one for each text, all of those without
    left = met.where("__one is null or __one").withColumn("__copy", F.when(F.col("__one"), F.col("__sha")).otherwise(F.monotonically_increasing_id().cast("string"))).dropDuplicates(["__copy"])
    return near.where("not __may").select(*docs.columns).unionAll(left.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(norm) AS text_sha256, norm
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (norm)
"""
