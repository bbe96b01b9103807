"""Tail probabilities as column expressions: normal, Student's t, Fisher's exact test, and intervals of means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Terms of the error function's series, enough for arguments up to 6; the tail beyond is below 1e-8.
TERMS = 120


def _series(n: Column, first: Column, factor) -> Column:
    """The sum of ``first`` and the ``n`` terms that follow, each the one before times ``factor(i)``."""
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * factor(i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, step, lambda acc: acc["sum"])


def erf(x: Column) -> Column:
    """The error function for x >= 0, by its series of positive terms."""
    x = F.least(x, F.lit(6.0))
    return 2 / math.sqrt(math.pi) * F.exp(-x * x) * _series(F.lit(TERMS), x, lambda i: 2 * x * x / (2 * i + 1))


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal deviate."""
    return 1 - erf(F.abs(z) / math.sqrt(2))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by the finite sums of its distribution."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    s, c = F.sin(angle), F.cos(angle)
    even = s * _series(df / 2 - 1, F.lit(1.0), lambda i: (2 * i - 1) / (2 * i) * c * c)
    odd_sum = F.when(df > 1, s * _series((df - 1) / 2 - 1, c, lambda i: (2 * i) / (2 * i + 1) * c * c)).otherwise(0.0)
    return 1 - F.when(df % 2 == 0, even).otherwise(2 / math.pi * (angle + odd_sum))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs; 0 for a perfect one, null below three pairs."""
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(student_p(r * F.sqrt(F.try_divide(n - 2, 1 - r * r)), n - 2))


def mann_whitney_p(u: Column, n_a: Column, n_b: Column, ties: Column) -> Column:
    """Two-sided p of U by the normal approximation, with corrections for ties (sum of t^3 - t) and continuity."""
    n = n_a + n_b
    deviation = F.sqrt(n_a * n_b / 12.0 * ((n + 1) - ties / (n * (n - 1))))
    return F.when(deviation > 0, normal_p(F.greatest(F.abs(u - n_a * n_b / 2) - 0.5, F.lit(0.0)) / deviation)).otherwise(1.0)


def t_quantile(z: float, df: Column) -> Column:
    """The t quantile at the normal quantile ``z``, by the Cornish-Fisher expansion (within 1e-4 from 10 degrees on)."""
    return (
        z
        + (z**3 + z) / 4 / df
        + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (df * df * df)
    )


def fisher(tables: DataFrame, a: str, b: str, c: str, d: str, *keys: str) -> DataFrame:
    """Fisher's exact two-sided p of 2x2 tables ``[[a, b], [c, d]]``: ``keys, p``.

    The sum of the probabilities of all tables with the same margins that are no likelier than the given one.
    A table's possible cells are rows, so a long margin is spread by key, not folded in one expression.
    """
    n = F.col(a) + F.col(b) + F.col(c) + F.col(d)
    margins = tables.select(*keys, F.col(a).alias("seen"), (F.col(a) + F.col(b)).alias("row"), (F.col(a) + F.col(c)).alias("column"), n.alias("n"))
    low, high = F.greatest(F.lit(0), F.col("row") + F.col("column") - F.col("n")), F.least("row", "column")
    cells = margins.withColumn("low", low).withColumn("x", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    before = F.col("x") - 1
    ratio = F.log((F.col("row") - before) * (F.col("column") - before)) - F.log(F.col("x") * (F.col("n") - F.col("row") - F.col("column") + F.col("x")))
    w = Window.partitionBy(*keys).orderBy("x")
    logs = cells.withColumn("ln", F.sum(F.when(F.col("x") == F.col("low"), 0.0).otherwise(ratio)).over(w))
    whole = Window.partitionBy(*keys)
    weight = F.exp(F.col("ln") - F.max("ln").over(whole))
    own = logs.withColumn("weight", weight).withColumn("own", F.max(F.when(F.col("x") == F.col("seen"), F.col("weight"))).over(whole))
    return own.groupBy(*keys).agg((F.sum(F.when(F.col("weight") <= F.col("own") * (1 + 1e-7), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("p"))
