"""Global order without a single task: running sums, row numbers, slices and shards by ranges of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.sources.scratch import written

PART, BEFORE = "__part", "__before"


def running(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows that come before in the order.

    Rows are dealt out by ranges of the order and summed within them; the ranges' totals, one number a
    partition, are summed up in one small task and joined back.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that the ranges, which Spark draws by sampling, are the same for both reads.
    ranged = written(rows.withColumn("__value", value).repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))
    totals = ranged.groupBy(PART).agg(F.sum("__value").alias("__total"))
    ahead = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PART, F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias(BEFORE))
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("before", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    joined = inside.join(F.broadcast(offsets), PART)  # a row a shuffle partition
    return joined.withColumn("before", F.col("before") + F.col(BEFORE)).drop(PART, BEFORE, "__value")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``nth``, from 0, in the given order."""
    return running(rows, list(order), F.lit(1)).withColumnRenamed("before", "nth")


def sliced(rows: DataFrame, order: list[str], offset: int = 0, limit: int | None = None, cap: int | None = None) -> DataFrame:
    """Offset, then limit, then cap, in a stable order."""
    out = rows.orderBy(*order).offset(offset)
    for most in (limit, cap):
        out = out if most is None else out.limit(most)
    return out


def shard(rows: DataFrame, k: int, n: int, *order: str) -> DataFrame:
    """Every ``n``-th row from the ``k``-th on."""
    return numbered(rows, *order).where(F.col("nth") % n == k)
