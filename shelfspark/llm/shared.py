"""Row numbers, bitmaps and tables for the training-text operators; intermediate tables are those of the library."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfspark.shared import discard, shared_path, stored

__all__ = ["discard", "flagged", "keyed", "numbered", "own_names", "shared_path", "stored", "table", "without"]


def own_names(stage):
    """A stage whose columns that begin with two underscores, as the helper columns of operators do, have other names while it runs."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        other = {c: f"column {i} of docs" for i, c in enumerate(docs.columns) if c.startswith("__")}
        there = lambda value: other.get(value, value) if isinstance(value, str) else value
        out = stage(docs.withColumnsRenamed(other), *map(there, args), **{k: there(v) for k, v in named.items()})
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, stored, with a number of its own for every row in column ``__row``: ids may repeat or be null."""
    return stored(df.withColumn("__row", F.monotonically_increasing_id()), name)


def keyed(df: DataFrame, id_col: str, name: str) -> tuple[DataFrame, str]:
    """(rows, column) in which the column names every row: the id where it is an integer that no two rows share and none lacks, else
    the number of ``numbered``. What is decided by that column is the same either way; the first spares a copy of the texts."""
    if isinstance(df.schema[id_col].dataType, IntegralType):
        again = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
        if not again.limit(1).count():
            return df, id_col
    return numbered(df, name), "__row"


#: Slots of the bitmap of ``flagged``: 16 for each key, 2**20 at least and 2**29 (64 MB, about twice that as a hash table) at most.
LEAST_BITS, MOST_BITS = 20, 29


def flagged(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, flag: str) -> DataFrame:
    """rows with boolean column ``flag``: true where the key, null too, is among those of wanted, a stored table, and for a few others.

    A bitmap of hashed keys is broadcast; it spares rows that cannot match a shuffle. It has a size by the number of wanted rows, up
    to a bound: of other rows up to 6 % are flagged as long as wanted has no more than 3 * 10**7 keys, a third at 2 * 10**8.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * wanted.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    parts = wanted.select(slot(F.col(wanted_key)).alias("__slot")).groupBy(F.bitmap_bucket_number("__slot").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    at = rows.withColumn("__slot", slot(F.col(key))).withColumns({"__part": F.bitmap_bucket_number("__slot"), "__bit": F.bitmap_bit_position("__slot")})
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("__bit") % 8).cast("int")) != 0
    return at.join(F.broadcast(parts), "__part", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).select(*rows.columns, flag)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows but those whose key is in column ``key`` of gone, a stored table; only rows that the bitmap flags are shuffled."""
    near = flagged(rows, key, gone, key, "__may")
    return near.where("not __may").drop("__may").unionAll(near.where("__may").drop("__may").join(gone.select(key), key, "left_anti").select(*rows.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
