"""Running totals and earlier values over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.shared import discard, stored


class Blocks:
    """Rows cut by a range sort into blocks, so that a window over a group of any size runs in many tasks.

    The blocks are stored, for another sort might cut elsewhere. Windows run inside the blocks of a group; what comes before a
    block is made of one value a block and group, and as at most one group goes on from one block to the next, there are no more
    such values than blocks, and they are broadcast. Rows that agree in keys and order share a block; their order is any. Null
    keys are a group.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], name: str):
        self.columns, self.keys, self.order = rows.columns, keys, order
        self.rows = stored(rows.repartitionByRange(*keys, *order).withColumn("__block", F.spark_partition_id()), name)
        self.inside = Window.partitionBy(*keys, "__block").orderBy(*order)
        self.earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)

    def _carry(self, base: DataFrame, rows: DataFrame, of_block: Column, before: Column) -> DataFrame:
        """rows with __before: what ``before``, a window over the blocks of a group, makes of __value, which is of_block of each block of base."""
        values = base.groupBy(*self.keys, "__block").agg(of_block.alias("__value"), F.count(F.lit(1)).alias("n"))
        edges = values.withColumn("__before", before).where("__before is not null").select(*[F.col(k).alias(f"__of_{k}") for k in self.keys], F.col("__block").alias("__of_block"), "__before")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in self.keys], F.col("__block") == F.col("__of_block"))
        return rows.join(F.broadcast(edges), same, "left").drop(*[f"__of_{k}" for k in self.keys], "__of_block")

    def total(self, weight: Column, column: str, rows: DataFrame | None = None) -> DataFrame:
        """The rows, or those given of this class, with ``column``: the sum of weight over the rows of the group up to this one."""
        base = self.rows if rows is None else rows
        rows = base.withColumn("__inside", F.sum(weight.cast("long")).over(self.inside.rowsBetween(Window.unboundedPreceding, 0)))
        carried = self._carry(base, rows, F.sum(weight.cast("long")), F.sum("__value").over(self.earlier))
        return carried.withColumn(column, F.col("__inside") + F.coalesce("__before", F.lit(0))).drop("__inside", "__before")

    def last(self, value: Column, column: str, rows: DataFrame | None = None) -> DataFrame:
        """The rows with ``column``: the last value that is not null among the rows of the group before this one, else null."""
        base = self.rows if rows is None else rows
        rows = base.withColumn("__inside", F.last(value, ignorenulls=True).over(self.inside.rowsBetween(Window.unboundedPreceding, -1)))
        place = F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])
        carried = self._carry(base, rows, F.max_by(value, F.when(value.isNotNull(), place)), F.last("__value", ignorenulls=True).over(self.earlier))
        return carried.withColumn(column, F.coalesce("__inside", "__before")).drop("__inside", "__before")

    def discard(self) -> None:
        discard(self.rows)


def running_total(rows: DataFrame, keys: list[str], order: list[str], weight: Column, name: str, column: str) -> DataFrame:
    """rows with ``column``: the sum of weight over the rows of the same keys up to this one, in the order given (see Blocks)."""
    return Blocks(rows, keys, order, name).total(weight, column).select(*rows.columns, column)
