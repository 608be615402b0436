"""Rendezvous hashing of stable record keys over weighted shards, DataFrame functions only.

Every (key, shard) pair has its own hash; a record goes to the shard with the
highest weighted score. When a shard is added, a record either stays or moves to
the new shard. Nothing is shuffled for that: shard and grown_shard are
expressions of the row. The law that holds is ``key``: the key and the shards decide.

Slots number the rows of a shard without gaps. Rows are numbered inside small
blocks of keys (bounded windows); the offsets of the blocks come from their counts.
Rows that are many times the same (id, size, CRC-32) come last in their shard and are
dealt into blocks of their own, so no window grows with a repeated or null id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.shared import stored, table

SHARDS = 24
#: Rows that a block of slots has on average; the number of blocks grows with the rows.
BLOCK_ROWS = 65536
#: At most so many equal rows are dealt apart, which bounds their list; a row is one of them if it is there more than BLOCK_ROWS times.
HOT_ROWS = 10_000


def _unit(key: Column, name: str) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(key:name)."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _highest(units: Column, weights: Sequence[float]) -> Column:
    """Shard with the highest -weight / ln(unit), ties to the larger number."""
    scores = [F.struct((F.lit(-float(w)) / F.log(units[j])).alias("score"), F.lit(j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*scores))["shard"]


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a string key: highest -weight / ln(unit hash), ties to the larger number."""
    return _highest(F.array(*[_unit(key, str(j)) for j in range(len(weights))]), weights)


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Null text has no bytes (size 8, CRC-32 of nothing); a null id is the empty key. Rows that repeat a key share
    its shard and have slots of their own. Other columns are ignored; an empty table gives an empty result. Texts are
    measured whole, whatever their length.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    same = ["doc_id", "size", "text_crc32"]
    made = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), F.array(*[_unit(key, str(j)) for j in range(max(len(weights), len(grown)))]).alias("units"))
    # a few numbers of each row: what is counted and what is numbered must be the same rows
    rows = stored(made.select(*same, "key", _highest(F.col("units"), weights).alias("shard"), _highest(F.col("units"), grown).alias("grown_shard"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    n = rows.count()
    blocks, many = max(1, -(-n // BLOCK_ROWS)), max(BLOCK_ROWS, n // HOT_ROWS)
    rows = rows.withColumn("block", F.pmod(F.conv(F.substring(F.md5(F.concat("key", F.lit("#"))), 1, 8), 16, 10).cast("long"), F.lit(blocks)))
    hot = rows.groupBy("shard", *same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many)
    first = F.sum("n").over(Window.partitionBy("shard").orderBy(*same).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    hot = stored(hot.select(*[F.col(c).alias(f"h_{c}") for c in same], first.alias("first"), F.ceil(F.col("n") / BLOCK_ROWS).alias("pieces")), "shard-hot")
    matched = rows.join(F.broadcast(hot), reduce(and_, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in same]), "left")
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(-1))
    # place of a window's rows: those of a hot row follow all others of the shard
    placed = matched.select(*same, "shard", "grown_shard", F.coalesce("first", F.lit(-1)).alias("first"), piece.alias("piece"), F.when(F.col("first").isNull(), F.col("block")).otherwise(F.lit(-1)).alias("block"))
    windows = ["shard", "first", "piece", "block"]
    counts = placed.groupBy(*windows).agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("first", "piece", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    at = F.row_number().over(Window.partitionBy(*windows).orderBy(*same))
    return placed.withColumn("at", at).join(counts.select(*windows, offset.alias("offset")), windows).select(*same, F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), "grown_shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def _oracle(shards: int) -> str:
    unit = "(CAST(CAST('0x' || substr(md5(key || ':' || j), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"
    return f"""
WITH poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size FROM documents
), s AS (
  SELECT d.doc_id, j, -1.0 / ln({unit}) AS score FROM d, range({shards + 1}) r(j)
), a AS (
  SELECT doc_id, CAST(arg_max(j, score) FILTER (j < {shards}) AS INTEGER) AS shard, CAST(arg_max(j, score) AS INTEGER) AS grown_shard FROM s GROUP BY doc_id
), b AS (
  SELECT d.doc_id, size, shard, grown_shard, CAST('0x' || substr(md5(key || '#'), 1, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) FROM d) AS block,
    CAST(xor(list_reduce(list_transform(range(strlen(text)), lambda i: CAST('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32
  FROM d JOIN a USING (doc_id), poly
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY hot, CASE WHEN NOT hot THEN block END, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, size, text_crc32) > (SELECT greatest({BLOCK_ROWS}, count(*) // {HOT_ROWS}) FROM d) AS hot FROM b)
"""


ORACLE_SQL = _oracle(SHARDS)
