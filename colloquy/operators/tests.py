"""Rank tests, multiplicity and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds ``rank``, ties averaged.

    Ranks are taken over distinct values, so a value that many rows share is one row of the sort.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy(value) if by else Window.partitionBy(F.lit(0)).orderBy(value)
    ranks = counts.withColumn("rank", F.sum("__c").over(w) - (F.col("__c") - 1) / 2).drop("__c")
    return rows.join(ranks, [*by, value])


def rank_sum(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Mann-Whitney U of a over b, the probability of a > b (ties half) and Cliff's delta."""
    both = ranked(rows.where(F.col(group).isin(a, b)), value)
    got = both.agg(F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("r"), F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"))
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    return got.select("n_a", "n_b", u.alias("u"), (u / (F.col("n_a") * F.col("n_b"))).alias("auc"), (2 * u / (F.col("n_a") * F.col("n_b")) - 1).alias("delta"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with the tie correction."""
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked(rows, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("groups"))
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    return total.join(ties).select("groups", "n", (h / (1 - F.col("ties") / (F.pow("n", F.lit(3)) - F.col("n")))).alias("h"))


def adjusted(rows: DataFrame, p: str, key: str, q: float = 0.1) -> DataFrame:
    """Holm's adjusted p, and whether Benjamini-Hochberg passes a row at ``q``."""
    up = Window.partitionBy(F.lit(0)).orderBy(p, key)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    r = rows.withColumn("i", F.row_number().over(up)).withColumn("m", n)
    r = r.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("m") - F.col("i") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))))
    last = F.max(F.when(F.col(p) <= F.col("i") / F.col("m") * q, F.col("i"))).over(Window.partitionBy(F.lit(0)))
    return r.withColumn("bh", F.col("i") <= F.coalesce(last, F.lit(0)))


def kappa(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Cohen's kappa; null if chance agreement is 1."""
    cells = rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    sides = cells.select(F.explode(F.array(F.struct(F.col(gold).cast("string").alias("l"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col(predicted).cast("string").alias("l"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("s")).select("s.*")
    chance = sides.groupBy("l").agg((F.sum("g") * F.sum("p")).alias("gp")).agg(F.sum("gp").alias("gp"))
    po, pe = F.col("hit") / F.col("total"), F.col("gp") / (F.col("total") * F.col("total"))
    return n.join(chance).select(F.col("total").alias("n"), po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - F.when(pe < 1, pe))).alias("kappa"))


def per_label(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every label in one aggregation."""
    side = lambda c, g: F.struct(F.col(c).alias("label"), F.lit(int(g)).alias("g"), F.lit(int(not g)).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("hit"))
    flat = rows.select(F.explode(F.array(side(gold, True), side(predicted, False))).alias("s")).select("s.*")
    got = flat.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum(F.col("g") * F.col("hit")).alias("hits"))
    precision, recall = F.try_divide("hits", "predicted"), F.try_divide("hits", "support")
    return got.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")))
