"""Agreement beyond kappa: boundaries, tolerant ladders, lenient hits, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.offsets import visible
from colloquy.operators.tests import kappa


def boundaries(text: Column, spans: Column) -> Column:
    """Ends of spans but the last, and whole spans, as counts of the visible characters before them."""
    at = lambda p: visible(F.substring(text, F.lit(1), p))
    return F.transform(spans, lambda s: F.struct(at(s["start"]).alias("start"), at(s["end"]).alias("end")))


def boundary_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of boundaries, and the rate of exact spans, of two columns of ``boundaries``.

    Rows without a predicted span do not count.
    """
    ends = lambda c: F.array_distinct(F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda s: s["end"]))
    sizes = rows.where(F.size(predicted) > 0).select(
        F.size(F.array_intersect(ends(gold), ends(predicted))).alias("hits"),
        F.size(ends(gold)).alias("of_gold"),
        F.size(ends(predicted)).alias("of_predicted"),
        F.size(gold).alias("spans"),
        F.size(F.filter(gold, lambda s: F.array_contains(predicted, s))).alias("exact"),
    )
    got = sizes.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sizes.columns])
    p, r = F.col("hits") / F.greatest("of_predicted", F.lit(1)), F.col("hits") / F.greatest("of_gold", F.lit(1))
    return got.select("n", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), F.try_divide("exact", "spans").alias("exact"))


def tolerant_ladder(rows: DataFrame, gold: str, predicted: str, ladder: list[tuple[str, list[set[str]]]]) -> DataFrame:
    """Accuracy and kappa on each rung; on a rung, labels of one of its groups count as the gold label."""
    out = None
    for step, groups in ladder:
        same = F.lit(False)
        for g in groups:
            same = same | (F.col(gold).isin(*sorted(g)) & F.col(predicted).isin(*sorted(g)))
        folded = rows.select(F.col(gold).alias("gold"), F.when(same, F.col(gold)).otherwise(F.col(predicted)).alias("pred"))
        rung = kappa(folded, "gold", "pred").select(F.lit(step).alias("step"), "n", "agreement", "kappa")
        out = rung if out is None else out.unionByName(rung)
    return out


def lenient_hits(rows: DataFrame, unit: list[str], gold: str, predicted: str) -> DataFrame:
    """Share of units of which the predicted label is among the gold ones."""
    sets = rows.groupBy(*unit).agg(F.collect_set(gold).alias("__g"), F.min(predicted).alias("__p"))
    return sets.agg(F.count("*").alias("units"), F.avg(F.array_contains("__g", F.col("__p")).cast("int")).alias("hit"))


def bucket_scores(rows: DataFrame, gold: str, predicted: str, buckets: dict[str, list[str]]) -> DataFrame:
    """Share of gold, precision and recall of each bucket of labels."""
    one = lambda name, ls: F.struct(F.lit(name).alias("bucket"), F.col(gold).isin(*ls).alias("g"), F.col(predicted).isin(*ls).alias("p"))
    flat = rows.select(F.explode(F.array(*[one(n, ls) for n, ls in buckets.items()])).alias("x")).select("x.*")
    got = flat.groupBy("bucket").agg(F.avg(F.col("g").cast("int")).alias("share"), F.count_if("g").alias("__g"), F.count_if("p").alias("__p"), F.count_if(F.col("g") & F.col("p")).alias("__h"))
    return got.select("bucket", "share", F.try_divide("__h", "__p").alias("precision"), F.try_divide("__h", "__g").alias("recall"))
