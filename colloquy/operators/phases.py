"""Phases of conversations by hidden Markov models: best paths, profiles, changes, and cross-validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from colloquy.operators.sequences import ORDER, _baum_welch, _Steps


def _best_path(symbols: list[str], start: np.ndarray, trans: np.ndarray, emit: dict[str, np.ndarray]) -> list[int]:
    """The best path (Viterbi); ties go to the lower state.  Two arrays of states, linear in the length."""
    if not len(symbols):
        return []
    v, back = start + emit[symbols[0]], []
    for s in symbols[1:]:
        ways = v[:, None] + trans
        back.append(ways.argmax(axis=0))
        v = ways.max(axis=0) + emit[s]
    path = [int(v.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def paths(spans: DataFrame, start: list[float], trans: list[list[float]], emit: dict[str, list[float]], label: str = "label") -> DataFrame:
    """``condition, conv, records, path``: each conversation's ordered spans and the state of each."""
    seq = spans.groupBy("condition", "conv").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "speaker", F.col(label).alias("label")))).alias("records"))
    pi, a, b = np.log(start), np.log(trans), {k: np.log(x) for k, x in emit.items()}

    @pandas_udf("array<int>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_best_path(list(s), pi, a, b) for s in batch])

    return seq.withColumn("path", decode("records.label"))


def decoded(spans: DataFrame, start: list[float], trans: list[list[float]], emit: dict[str, list[float]]) -> DataFrame:
    """One row a span: ``condition, conv, i, speaker, label, state``."""
    zipped = F.posexplode(F.arrays_zip("records", F.col("path").alias("path")))
    rows = paths(spans, start, trans, emit).select("condition", "conv", zipped.alias("i", "z"))
    return rows.select("condition", "conv", "i", "z.records.speaker", "z.records.label", F.col("z.path").alias("state"))


def occupancy(phases: DataFrame) -> DataFrame:
    """States with their share of all spans, ranked by it.  As few rows as states before any window."""
    n = phases.groupBy("state").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return n.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("n"), "state")))


def profile(phases: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Per condition and state: occupancy, the client's share, and the share of each group of labels."""
    shares = [F.avg(F.col("label").isin(labels).cast("int")).alias(name) for name, labels in groups.items()]
    got = phases.groupBy("condition", "state").agg(F.count("*").alias("n"), F.avg((F.col("speaker") == "Client").cast("int")).alias("client"), *shares)
    return got.withColumn("occupancy", F.col("n") / F.sum("n").over(Window.partitionBy("condition")))


def changes(phases: DataFrame) -> DataFrame:
    """Adds ``changed``: whether the state differs from the span's before; null at the beginning."""
    return phases.withColumn("changed", F.col("state") != F.lag("state").over(Window.partitionBy("conv").orderBy("i")))


def responses(phases: DataFrame) -> DataFrame:
    """After each phase and last act: how many spans follow, how often the phase moves, and the client's share."""
    w = Window.partitionBy("conv").orderBy("i")
    h = phases.withColumn("phase", F.lag("state").over(w)).withColumn("last_act", F.lag("label").over(w)).where("phase is not null")
    return h.groupBy("phase", "last_act").agg(F.count("*").alias("n"), F.avg((F.col("state") != F.col("phase")).cast("int")).alias("moved"), F.avg((F.col("speaker") == "Client").cast("int")).alias("client"))


def emissions(phases: DataFrame, top: int, least: float) -> DataFrame:
    """The ``top`` labels of each state with a share of ``least`` or more."""
    e = phases.groupBy("state", "label").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))
    w = Window.partitionBy("state").orderBy(F.desc("p"), "label")
    return e.where(F.col("p") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def _sequences(spans: DataFrame) -> DataFrame:
    records = F.array_sort(F.collect_list(F.struct(*ORDER, "label")))
    return spans.groupBy("condition", "conv").agg(F.transform(records, lambda x: x["label"]).alias("symbols")).where(F.size("symbols") >= 2)


def _coded(pdf: pd.DataFrame) -> tuple[list[np.ndarray], int]:
    alphabet = {x: i for i, x in enumerate(sorted({x for s in pdf["symbols"] for x in s}))}
    return [np.array([alphabet[x] for x in s]) for _, s in sorted(zip(pdf["conv"], pdf["symbols"]))], len(alphabet)


def held_out(spans: DataFrame, states: list[int], folds: int, restarts: int, iterations: int, tolerance: float) -> DataFrame:
    """``condition, k, ll_per_observation``: fitted on all but one fold of conversations, measured on that fold, averaged.

    Every (condition, states, fold) is a task of its own; it holds one condition's conversations.
    """
    fold = F.pmod(F.xxhash64("conv", F.lit("fold")), F.lit(folds)).cast("int")
    tasks = _sequences(spans).withColumn("fold", fold).withColumn("k", F.explode(F.array(*[F.lit(k) for k in states])))
    tasks = tasks.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("conv")
        seqs, m = _coded(pdf)
        out = pdf["fold"].to_numpy() == key[2]
        inside, outside = [s for s, o in zip(seqs, out) if not o], [s for s, o in zip(seqs, out) if o]
        if not inside or not outside:
            return pd.DataFrame([(key[0], key[1], 0.0, 0)], columns=["condition", "k", "ll", "n"])
        best = max((_baum_welch(inside, int(key[1]), m, 42 + r, iterations, tolerance) for r in range(restarts)), key=lambda x: x[0])
        return pd.DataFrame([(key[0], key[1], _Steps(outside).forward(*best[1:])[2], sum(map(len, outside)))], columns=["condition", "k", "ll", "n"])

    got = tasks.groupBy("condition", "k", "held").applyInPandas(fit, "condition string, k int, ll double, n long")
    return got.groupBy("condition", "k").agg(F.try_divide(F.sum("ll"), F.sum("n")).alias("ll_per_observation"), F.sum("n").alias("n"))


def single_against_best(spans: DataFrame, k: int, restarts: int, iterations: int, tolerance: float) -> DataFrame:
    """``condition, single, best, loss``: the log-likelihood of the first random start, and of the best."""
    tasks = _sequences(spans).withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seqs, m = _coded(pdf)
        return pd.DataFrame([(*key, _baum_welch(seqs, k, m, 42 + int(key[1]), iterations, tolerance)[0])], columns=["condition", "restart", "ll"])

    got = tasks.groupBy("condition", "restart").applyInPandas(fit, "condition string, restart int, ll double")
    sides = got.groupBy("condition").agg(F.max(F.when(F.col("restart") == 0, F.col("ll"))).alias("single"), F.max("ll").alias("best"))
    return sides.withColumn("loss", F.col("best") - F.col("single"))
