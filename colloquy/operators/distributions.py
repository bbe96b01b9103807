"""Label distributions, and distances and effects between them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.scalar import cohen_h, plog


def distribution(spans: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """``by, label, n, total, p``; spans without a label do not count."""
    total = F.sum("n").over(Window.partitionBy(*by))
    counted = spans.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(*by, label).agg(F.count("*").alias("n"))
    return counted.withColumn("total", total).withColumn("p", F.col("n") / F.col("total"))


def mean_distribution(dist: DataFrame, group: str, unit: str, label: str = "label") -> DataFrame:
    """Mean of the units' distributions per group, a missing label counting as 0."""
    units = dist.groupBy(group).agg(F.countDistinct(unit).alias("units"))
    sums = dist.groupBy(group, label).agg(F.sum("p").alias("s"))
    return sums.join(units, group).select(group, label, (F.col("s") / F.col("units")).alias("p"))


def deciles(spans: DataFrame, *conversation: str, order: tuple[str, ...] = ("ts", "span")) -> DataFrame:
    """Adds the positional decile, 0..9: a single span is in 0, the last of several in 9."""
    w = Window.partitionBy(*conversation)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    at = F.when(n <= 1, 0.0).otherwise(i / F.greatest(n - 1, F.lit(1)))
    return spans.withColumn("decile", F.least(F.floor(at * 10), F.lit(9)).cast("int"))


def aligned(dist: DataFrame, conditions: list[str], *by: str, condition: str = "condition", label: str = "label", value: str = "p", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``by, a, b, label, p, q`` for all pairs of conditions over the union of their labels, in one aggregation.

    Each row goes to the pairs that its condition is a side of, so no join is needed.
    """
    pairs = pairs if pairs is not None else list(combinations(conditions, 2))
    sides = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("side")) for a, b in pairs for c in (a, b)]
    rows = dist.withColumn("__pair", F.explode(F.filter(F.array(*sides), lambda s: s["side"] == F.col(condition))))
    on = lambda side: F.sum(F.when(F.col(f"__pair.{side}") == F.col(condition), F.col(value)).otherwise(0))
    return rows.groupBy(*by, F.col("__pair.a").alias("a"), F.col("__pair.b").alias("b"), label).agg(on("a").alias("p"), on("b").alias("q"))


def distances(pairs: DataFrame, *by: str) -> DataFrame:
    """Jensen-Shannon distance (base 2), L1, L2 and total variation of aligned distributions."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    got = pairs.groupBy(*by).agg(
        F.sqrt(F.greatest(0.5 * F.sum(plog(p, m)) + 0.5 * F.sum(plog(q, m)), F.lit(0.0))).alias("jsd"),
        F.sum(F.abs(p - q)).alias("l1"),
        F.sqrt(F.sum((p - q) * (p - q))).alias("l2"),
        F.sum("p").alias("__p"),
        F.sum("q").alias("__q"),
    )
    # A condition without spans is an error, not a distance of 0.
    ok = (F.col("__p") > 0) & (F.col("__q") > 0)
    guard = lambda c: F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit("a condition has no spans")).cast("double")).alias(c)
    return got.select(*by, guard("jsd"), guard("l1"), guard("l2"), (F.col("l1") / 2).alias("tvd"))


def effects(pairs: DataFrame) -> DataFrame:
    """Per label: difference, Cohen's h and contribution to the divergence in bits."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    return pairs.withColumn("diff", p - q).withColumn("h", cohen_h(p, q)).withColumn("bits", 0.5 * plog(p, m) + 0.5 * plog(q, m))


def cramers_v(counts: DataFrame, *by: str) -> DataFrame:
    """Cramér's V of 2 x k counts ``p, q``; null if fewer than two labels occur."""
    both = counts.where("p + q > 0")
    w = Window.partitionBy(*by)
    a, b = F.sum("p").over(w), F.sum("q").over(w)
    rows = both.withColumn("__n", a + b).withColumn("__ea", (F.col("p") + F.col("q")) * a / (a + b)).withColumn("__eb", (F.col("p") + F.col("q")) * b / (a + b))
    square = lambda x, e: F.sum((F.col(x) - F.col(e)) * (F.col(x) - F.col(e)) / F.col(e))
    got = rows.groupBy(*by).agg(F.count("*").alias("k"), F.max("__n").alias("n"), (square("p", "__ea") + square("q", "__eb")).alias("chi2"))
    return got.withColumn("v", F.when(F.col("k") >= 2, F.sqrt(F.col("chi2") / F.col("n"))))


def entropy(dist: DataFrame, *by: str) -> DataFrame:
    """Shannon entropy in bits and the share of the most frequent label."""
    return dist.groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.max("p").alias("top_share"))
