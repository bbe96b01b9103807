"""Resampling with deterministic hash draws; the conversation is the sampling unit.

A draw depends on the replicate, its index and a purpose only, so every engine, group and exclusion set sees
the same numbers (common random numbers).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.scalar import draw, hash_order, plog


def units(spans: DataFrame, *by: str, unit: str = "conv") -> DataFrame:
    """Numbers the units of each group: ``by, unit, i`` (from 0) and ``n``."""
    distinct = spans.select(*by, unit).distinct()
    w = Window.partitionBy(*by)
    return distinct.withColumn("i", F.row_number().over(w.orderBy(unit)) - 1).withColumn("n", F.count("*").over(w))


def bootstrap(spans: DataFrame, replicates: int, purpose: str, *by: str, unit: str = "conv") -> DataFrame:
    """``by, b, unit, weight``: how often each unit is drawn, with replacement, in each replicate."""
    own = units(spans, *by, unit=unit)
    size = own.groupBy(*by).agg(F.max("n").alias("n"))
    picks = size.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    picks = picks.withColumn("i", draw(F.col("n"), F.col("b").cast("string"), F.col("j").cast("string"), purpose)).groupBy(*by, "b", "i").agg(F.count("*").alias("weight"))
    return picks.join(own.drop("n"), [*by, "i"]).drop("i")


def halves(spans: DataFrame, replicates: int, purpose: str, *by: str, unit: str = "conv") -> DataFrame:
    """``by, b, unit, half``: a random half (rounded down) of the units is 0, the rest 1."""
    own = units(spans, *by, unit=unit).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = Window.partitionBy(*by, "b").orderBy(hash_order(F.col("b").cast("string"), F.col(unit).cast("string"), purpose), unit)
    return own.withColumn("half", (F.row_number().over(w) > F.floor(F.col("n") / 2)).cast("int")).drop("i", "n")


#: Replicates that one task draws.
BLOCK = 50


def half_counts(spans: DataFrame, counts: DataFrame, replicates: int, purpose: str, *cell: str, unit: str = "conv") -> DataFrame:
    """``b, half, cell, k``: the sums of ``counts`` (``unit, cell, k``) over either half of the units, as ``halves`` draws them.

    Drawn and summed in one task a block of replicates, so that no row is made for a unit and a replicate.  A
    task holds a number for each unit and cell.
    """
    cells = counts.select(*cell).distinct().withColumn("__c", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*cell)) - 1)
    # Nulls are cells like others.
    same = [counts[c].eqNullSafe(cells[c]) for c in cell]
    at = counts.join(F.broadcast(cells), same).groupBy(counts[unit].alias(unit)).agg(F.collect_list("__c").alias("cs"), F.collect_list(F.col("k").cast("long")).alias("ks"))
    blocks = -(-replicates // BLOCK)
    rows = spans.select(unit).distinct().join(at, unit, "left").select(F.col(unit).cast("string").alias("u"), "cs", "ks")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block")

    def draws(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        n, sizes = len(pdf), [0 if x is None else len(x) for x in pdf["cs"]]
        c, k = (np.concatenate([np.zeros(0, np.int64), *(x for x in pdf[col] if x is not None)]).astype(np.int64) for col in ("cs", "ks"))
        table = np.zeros((n, int(c.max(initial=-1)) + 1))
        np.add.at(table, (np.repeat(np.arange(n), sizes), c), k)
        whole, out = table.sum(axis=0), []
        ends = [("" if u is None else f"|{u}") + f"|{purpose}" for u in pdf["u"]]
        for b in range(key[0] * BLOCK, min((key[0] + 1) * BLOCK, replicates)):
            digests = np.frombuffer(b"".join([hashlib.md5(f"{b}{e}".encode()).digest() for e in ends]), ">u8").reshape(n, 2)
            order = np.argsort(high := digests[:, 0].astype(np.uint64), kind="stable")
            if (high[order[1:]] == high[order[:-1]]).any():
                order = np.lexsort((digests[:, 1], high))
            lower = np.zeros(n)
            lower[order[: n // 2]] = 1
            for half, sums in ((0, first := lower @ table), (1, whole - first)):
                out += [(b, half, i, int(x)) for i, x in enumerate(sums) if x]
        return pd.DataFrame(out, columns=["b", "half", "__c", "k"])

    return rows.groupBy("block").applyInPandas(draws, "b int, half int, __c int, k long").join(F.broadcast(cells), "__c").drop("__c")


def weighted_jsd(counts: DataFrame, side: Column, weight: Column, *by: str) -> DataFrame:
    """Distance between side 0 and side 1 of weighted label counts, per ``by``."""
    sums = counts.groupBy(*by, "label").agg(F.sum(F.when(side == 0, F.col("k") * weight).otherwise(0)).alias("__a"), F.sum(F.when(side == 1, F.col("k") * weight).otherwise(0)).alias("__b"))
    w = Window.partitionBy(*by)
    shares = sums.withColumn("p", F.col("__a") / F.sum("__a").over(w)).withColumn("q", F.col("__b") / F.sum("__b").over(w))
    m = (F.col("p") + F.col("q")) / 2
    return shares.groupBy(*by).agg(F.sqrt(F.greatest(0.5 * F.sum(plog(F.col("p"), m)) + 0.5 * F.sum(plog(F.col("q"), m)), F.lit(0.0))).alias("jsd"))


def interval(draws: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and exact percentiles 2.5, 95 and 97.5 of replicate values."""
    p = lambda q: F.percentile(value, F.lit(q))
    return draws.groupBy(*by).agg(F.avg(value).alias("mean"), p(0.025).alias("low"), p(0.95).alias("p95"), p(0.975).alias("high"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, purpose: str) -> DataFrame:
    """``size`` rows a stratum in hash order, with the population for weights."""
    w = Window.partitionBy(stratum)
    ranked = rows.withColumn("nth", F.row_number().over(w.orderBy(hash_order(F.col(key).cast("string"), purpose), key))).withColumn("population", F.count("*").over(w))
    return ranked.where(F.col("nth") <= size)


def length_matched(rows: DataFrame, group: str, reference: str, bin_: str, key: str, purpose: str) -> DataFrame:
    """``rows`` redrawn with replacement, so that every group has the reference's number of rows in each bin.

    Adds ``weight``, the times a row is drawn; bins that a group has no row in are left out.
    """
    w = Window.partitionBy(group, bin_)
    pool = rows.withColumn("__i", F.row_number().over(w.orderBy(key)) - 1)
    sizes = rows.groupBy(group, bin_).agg(F.count("*").alias("__n"))
    quota = sizes.where(F.col(group) == reference).select(bin_, F.col("__n").alias("__k"))
    picks = sizes.join(quota, bin_).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    picks = picks.withColumn("__i", draw(F.col("__n"), F.col(bin_).cast("string"), F.col("__j").cast("string"), purpose)).groupBy(group, bin_, "__i").agg(F.count("*").alias("weight"))
    return pool.join(picks, [group, bin_, "__i"]).drop("__i")
