"""Interval operators by windows: union of overlapping spans, and the best overlap of two sets of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(spans: DataFrame, *by: str) -> DataFrame:
    """Unions of overlapping ``start, end, label, source`` spans, per ``by``.

    A span takes over the label if it is longer than what was merged before it; the source is ``both`` if the
    parts differ.  Touching spans stay apart.
    """
    order = Window.partitionBy(*by).orderBy("start", "end", "label", "source")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("__new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*by, "__island").orderBy("start", "end", "label", "source")
    so_far = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)) - F.first("start").over(own)
    rows = rows.withColumn("__r", F.row_number().over(own)).withColumn("__takes", F.coalesce(F.col("end") - F.col("start") > so_far, F.lit(True)))
    got = rows.groupBy(*by, "__island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max_by(F.when(F.col("__takes"), F.col("label")), F.when(F.col("__takes"), F.col("__r"))).alias("label"),
        F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("both").alias("source"),
    )
    return got.drop("__island")


def best_overlap(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """For each left ``id, start, end`` the right one of the same ``by`` with most overlap (ties: the smallest id), and how many overlap.

    Left rows that nothing overlaps have nulls and a count of 0.
    """
    r = right.select(*by, F.col("id").alias("right_id"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    pairs = left.join(r, list(by)).withColumn("overlap", F.least("end", "__e") - F.greatest("start", "__s")).where("overlap > 0")
    best = pairs.groupBy(*by, "id").agg(F.count("*").alias("overlapping"), F.max_by(F.struct("right_id", "overlap"), F.struct(F.col("overlap"), -F.col("right_id"))).alias("__b"))
    got = left.join(best, [*by, "id"], "left")
    return got.select(*by, "id", F.col("__b.right_id").alias("right_id"), F.col("__b.overlap").alias("overlap"), F.coalesce("overlapping", F.lit(0)).alias("overlapping"))
