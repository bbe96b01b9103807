"""Operators on embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that ``silhouette`` takes at most: one sum vector of each is broadcast.
MAX_GROUPS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def silhouette(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Adds ``silhouette`` by cosine distance; rows without a group, a vector or a direction (zero length) are left out.

    The distances from a unit vector x to a group of n add up to n - x.S, where S is the group's sum, so no pairs
    are made.  A row alone in its group has 0, and so have all rows if there is one group.
    """
    e = F.transform(vector, lambda x: x.cast("double"))
    unit = rows.where(F.col(group).isNotNull()).withColumn("__e", e).withColumn("__len", F.sqrt(dot(F.col("__e"), F.col("__e")))).where("__len > 0")
    unit = unit.withColumn("__e", F.transform("__e", lambda x: F.try_divide(x, F.col("__len")))).drop("__len")
    places = unit.select(F.col(group).alias("g"), F.posexplode("__e").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = places.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"), F.max("n").alias("n"))
    if sums.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    every = F.broadcast(sums.agg(F.collect_list(F.struct("g", "s", "n")).alias("__groups")))
    far = F.transform("__groups", lambda t: F.struct((t["g"] == F.col(group)).alias("own"), (t["n"] - dot(F.col("__e"), t["s"])).alias("d"), t["n"].alias("n")))
    # A row's distance to itself is 0, so its own group has n - 1 others.
    own = F.filter(F.col("__far"), lambda t: t["own"])[0]
    near = F.array_min(F.transform(F.filter(F.col("__far"), lambda t: ~t["own"]), lambda t: t["d"] / t["n"]))
    found = unit.join(every).withColumn("__far", far)
    found = found.withColumn("__a", F.when(own["n"] > 1, own["d"] / (own["n"] - 1))).withColumn("__b", near)
    s = F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.when(F.col("__a").isNotNull(), F.greatest("__a", "__b"))), F.lit(0.0))
    return found.withColumn("silhouette", s).drop("__e", "__groups", "__far", "__a", "__b")
