"""Risk-controlled quality rules, in DataFrame and SQL functions only.

Every text gets base counts and from them a few ratios, each with a rule "reject above a cutoff".  Cutoffs
come from a fixed grid.  Labelled documents (good = 1) are the holdout: in every stratum and for every rule
the grid is walked from the most lenient cutoff to stricter ones, and a cutoff is accepted while an exact
binomial test rejects, at its level, that good documents fail the rule more often than ``RISK / rules``.
The walk stops at the first cutoff that is not accepted (fixed-sequence testing), and the level is
``DELTA / (strata * rules)`` (Bonferroni).  So with probability 1 - DELTA no stratum's good documents are
rejected by the rules more often than RISK.  A stratum with too few labels, or none, accepts no cutoff and
rejects nothing.

Defined results: null and empty texts have zero counts and fail the base rule; a null stratum is a stratum
like others; repeated rows get equal results and count as often as they occur; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import BLANKS, SPLIT_BLANKS, written

RISK, DELTA = 0.02, 0.05
MIN_WORDS = 50
#: From lenient to strict, for each rule.
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005)
SYMBOLS = "#*$%&|<>"
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that later expressions read instead of computing it again inside a lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    keep = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("__t"))
    trimmed = F.trim("__t", F.lit(BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT_BLANKS))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    df = _once(df.withColumn("__w", words).withColumn("__l", lines), "__n", F.size("__w"))
    # Three-word windows as (hash, place), sorted: a window that occurs again is next to its equal.
    last = F.greatest(F.col("__n") - 2, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("__w", i, last).alias(f"w{i}") for i in (1, 2, 3)])
    windows = F.sort_array(F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x["w1"], x["w2"], x["w3"]).alias("h"), i.alias("i"))))
    chars = F.length(F.translate("__t", BLANKS, "")).cast("long")
    symbols = (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long")
    df = df.withColumn("word_chars", chars).withColumn("n_symbols", symbols).drop("__t")
    df = _once(df, "__s", windows)
    short = F.greatest(F.size("__s") - 1, F.lit(0))
    pairs = F.filter(F.arrays_zip(F.slice("__s", 1, short).alias("a"), F.slice("__s", 2, short).alias("b")), lambda p: p["a"]["h"] == p["b"]["h"])
    covered = F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(*[p[s]["i"] + k for s in "ab" for k in range(3)]))))
    return df.select(
        *keep,
        F.col("__n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


def _log_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial (n, p), summed term by term in log space."""
    first = n * F.log1p(F.lit(-p))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        return F.struct(t.alias("t"), (F.greatest(acc["c"], t) + F.log1p(F.exp(-F.abs(acc["c"] - t)))).alias("c"))
    terms = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))))
    return F.aggregate(terms, F.struct(first.alias("t"), first.alias("c")), add, lambda acc: acc["c"])


def cutoffs(measured: DataFrame, stratum: str, good: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff`` of the accepted cutoffs; ``measured`` are labelled rows with counts that pass the base rule."""
    share = risk / len(RULES)
    long = measured.where(F.col(good) == 1).select(F.col(stratum).alias("stratum"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(e).alias("value")) for r, e in RULES.items()])).alias("r")).select("stratum", "r.*")
    grid = F.array(*[F.lit(float(g)) for g in GRID])
    # How many cutoffs of the grid a document fails: the first place whose cutoff is below its value.
    passed = written(long.groupBy("stratum", "rule", F.size(F.filter(grid, lambda g: g >= F.col("value"))).alias("passes")).agg(F.count("*").alias("n")))
    whole = Window.partitionBy("stratum", "rule")
    steps = passed.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("passes", "n")).alias("by"))
    steps = steps.select("stratum", "rule", "n", "by", F.posexplode(grid).alias("place", "cutoff"))
    failed = F.aggregate("by", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["passes"] <= F.col("place"), x["n"]).otherwise(0))
    steps = steps.withColumn("k", failed)
    level = F.log(F.lit(delta / (max(1, passed.select("stratum").distinct().count()) * len(RULES))))
    plausible = F.col("k") <= F.col("n") * share
    accepted = F.when(plausible, _log_tail(F.when(plausible, F.col("k")).otherwise(F.lit(0).cast("long")), F.col("n"), share) <= level).otherwise(False)
    steps = steps.withColumn("ok", accepted)
    stop = F.min(F.when(~F.col("ok"), F.col("place"))).over(whole)
    return steps.withColumn("stop", F.coalesce(stop, F.lit(len(GRID)))).where("place < stop").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts of every document with ``base_failed``, ``rejected_by`` (rule names) and ``kept``."""
    measured = written(counts(docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))).withColumn("base_failed", base_failed()))
    held = measured.where("not base_failed").join(labels.select(F.col(key).alias("doc_id"), F.col(good).alias("good")), "doc_id")
    limits = cutoffs(held, "stratum", "good", risk, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    joined = measured.alias("m").join(limits.alias("l"), F.col("m.stratum").eqNullSafe(F.col("l.stratum")), "left")
    fails = F.filter(F.array(*[F.when(F.expr(e) > F.try_element_at("limits", F.lit(r)), F.lit(r)) for r, e in RULES.items()]), lambda x: x.isNotNull())
    return joined.select("m.*", fails.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
