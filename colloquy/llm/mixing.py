"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on a bounded sample of a labelled table, gives every document
posteriors over the domains.  Document rates (how often a document is repeated) are fitted so that expected
domain token totals, the sums of rate * tokens * posterior, match target weights of the corpus' tokens:
projected gradient descent on the least squares, from rates 1, kept nonnegative.  The gradients are summed before
they are projected, so a document's rate follows from its posteriors and one number a domain, however many steps
there were; a step's length is that of the Gram matrix of the documents whose rate is not held at zero.  A step is
one distributed aggregation of a few sums, and nothing of the size of the corpus is carried along.

Defined results: null and empty texts have no tokens, the prior as posteriors and rate 1; with fewer than
two domains in the labelled table every rate is 1; targets for unknown domains are refused; repeated rows
get equal rates; an empty table gives none.  Targets that no rates reach (within TOLERANCE of all tokens, after
STEPS steps) give the rates of the nearest step and a warning that names the shares.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from colloquy.llm.common import at_most, give_back, uniform, written

#: Labelled documents that the classifier is fitted on, at most (in expectation).
FIT_DOCS = 6000
BITS, DENSE, EPOCHS = 12, 3, 60
#: Documents of a block of the gradient, which bounds the driver's memory.
BLOCK = 500
#: Steps at most, and the sum of the domains' deviations from their targets that ends them, as a share of all tokens.
STEPS, TOLERANCE = 60, 5e-4
_memo: dict[str, int] = {}


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    weights: np.ndarray  # (2 ** BITS + DENSE + 1, domains)


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and values of a text's features, and its tokens (words)."""
    words = (text or "").split()
    if not words:
        return np.array([(1 << BITS) + DENSE]), np.ones(1, np.float32), 0
    if len(_memo) > 200_000:
        _memo.clear()
    ids = []
    for w in words:
        k = _memo.get(w)
        if k is None:
            k = _memo[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        ids.append(k)
    at, n = np.unique(np.array(ids), return_counts=True)
    value = np.log1p(n.astype(np.float32))
    value /= np.sqrt((value**2).sum())
    symbols = sum(text.count(c) for c in "#*$%&|<>") / len(text)
    dense = [min(1.0, 20 * symbols), len(at) / len(words), min(2.0, len(text) / len(words) / 10)]
    return np.concatenate([at, (1 << BITS) + np.arange(DENSE + 1)]), np.concatenate([value, np.array([*dense, 1.0], np.float32)]), len(words)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit_domains(labelled: DataFrame, text: str = "text", domain: str = "domain", key: str = "doc_id", sample: int = FIT_DOCS) -> DomainModel:
    """Multinomial logistic regression on about ``sample`` labelled documents at most (documented bound)."""
    rows = labelled.select(F.col(key).alias("k"), F.col(domain).cast("string").alias("d"), F.col(text).alias("t")).where("d is not null")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            got = [_features(t) for t in f["t"]]
            yield pd.DataFrame({"d": f["d"], "at": [g[0].astype("<i2").tobytes() for g in got], "value": [g[1].astype("<f4").tobytes() for g in got]})

    # Packed features, some six bytes each: as lists they would be ten times that on the driver.
    got = sorted((r["d"], bytes(r["at"]), bytes(r["value"])) for r in at_most(rows, sample, "mixing", "k").select("d", "t").mapInPandas(project, "d string, at binary, value binary").toLocalIterator())
    domains = tuple(sorted({d for d, _, _ in got}))
    w = np.zeros(((1 << BITS) + DENSE + 1, len(domains)))
    if len(domains) < 2:
        return DomainModel(domains, w)
    truth = np.eye(len(domains))[[domains.index(d) for d, _, _ in got]]
    counts = np.array([len(x) // 2 for _, x, _ in got])
    at, value = np.frombuffer(b"".join(x for _, x, _ in got), "<i2"), np.frombuffer(b"".join(v for _, _, v in got), "<f4")
    total = len(got)
    del got
    ends = np.concatenate([[0], np.cumsum(counts)])
    scale = np.zeros_like(w)
    for _ in range(EPOCHS):  # AdaGrad on the whole sample, whose gradient is summed over blocks of it
        slope = 1e-6 * w
        for low in range(0, total, BLOCK):
            high = min(low + BLOCK, total)
            here, v = at[ends[low] : ends[high]].astype(np.int64), value[ends[low] : ends[high]].astype(float)
            p = _softmax(np.add.reduceat(w[here] * v[:, None], ends[low:high] - ends[low]))
            error = np.repeat((p - truth[low:high]) / total, counts[low:high], axis=0) * v[:, None]
            slope += np.stack([np.bincount(here, error[:, k], len(w)) for k in range(len(domains))], axis=1)
        scale += slope**2
        w -= 0.5 * slope / (np.sqrt(scale) + 1e-8)
    give_back()
    return DomainModel(domains, w.astype(np.float32))


def posteriors(model: DomainModel):
    """A pandas UDF from a text to ``struct<tokens, p>``."""

    @pandas_udf("tokens long, p array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, ps = [], []
            for t in batch:
                at, value, n = _features(t)
                tokens.append(n)
                ps.append(_softmax((value @ model.weights[at]).astype(float)).tolist() if model.domains else [])
            yield pd.DataFrame({"tokens": tokens, "p": ps})
        _memo.clear()
        give_back()

    return run


def _along(p: Column, y: list[float]) -> Column:
    return F.aggregate(F.zip_with(p, F.array(*[F.lit(float(v)) for v in y]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def rate(tokens: Column, p: Column, y: list[float], mean: float) -> Column:
    """A document's rate, given the summed gradient ``y`` of each domain: 1 less its share of it, projected to 0 or more."""
    return F.greatest(F.lit(0.0), 1 - tokens.cast("double") / F.lit(mean or 1.0) * _along(p, y)) if y else F.lit(1.0)


def fit_rates(table: DataFrame, domains: tuple[str, ...], targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[float], float]:
    """Iterate over ``table`` (tokens, p) until expected domain totals match ``targets`` (shares of all tokens)."""
    if unknown := set(targets) - set(domains):
        raise ValueError(f"targets for unknown domains: {sorted(unknown)}")
    d = len(domains)
    if d < 2:
        return [], 1.0
    p, t = F.col("p"), F.col("tokens")
    total, n = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if not total:
        return [], 1.0
    mean = total / n
    size = t / F.lit(mean)
    want = np.array([targets.get(x, 0.0) for x in domains])
    want = want / want.sum() * n

    def measured(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals at ``y``, and the Gram matrix of the documents that move with it."""
        rated = table.withColumn("r", rate(t, p, y.tolist(), mean))
        cells = [F.sum(F.when(F.col("r") > 0, size * size * p[i] * p[j]).otherwise(0.0)) for i in range(d) for j in range(i, d)]
        got = rated.agg(*[F.sum(size * p[i] * F.col("r")) for i in range(d)], *cells).first()
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = np.array(got[d:], float)
        return np.array(got[:d], float), gram + np.triu(gram, 1).T

    y, step = np.zeros(d), np.zeros(d)
    best, shares, slope = (np.inf, y), want, np.zeros(d)
    for _ in range(steps):
        sums, gram = measured(y)
        gap = float(np.abs(sums - want).sum())
        if gap < best[0]:
            best, shares = (gap, y), sums
            if gap <= tolerance * n:
                break
            slope = np.linalg.solve(gram + np.eye(d) * 1e-9 * max(np.trace(gram), 1e-9), sums - want)
            step = slope
        else:  # too far along this gradient
            step = step / 2
        y = best[1] + step
    if best[0] > tolerance * n:
        warnings.warn(f"mixing: targets {dict(zip(domains, (want / n).round(4).tolist()))} were not reached; shares {dict(zip(domains, (shares / n).round(4).tolist()))}", stacklevel=2)
    return best[1].tolist(), mean


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, tokens, p, rate, copies``; ``copies`` rounds the rate by a hash of the id."""
    model = fit_domains(labelled)
    table = written(docs.select(F.col(key).alias("doc_id"), posteriors(model)(text).alias("m")).select("doc_id", "m.*"))
    y, mean = fit_rates(table, model.domains, targets)
    rated = table.withColumn("rate", rate(F.col("tokens"), F.col("p"), y, mean))
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def copies(r: Column, key: Column) -> Column:
    return (F.floor(r) + (uniform(F.lit("copies"), key) < r - F.floor(r)).cast("int")).cast("long")


def apply(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row repeated by its rate; same columns.  The rows are written once with their posteriors."""
    model = fit_domains(labelled)
    held = written(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), posteriors(model)(text).alias("m")))
    y, mean = fit_rates(held.select("m.*"), model.domains, targets)
    rated = held.select("row", copies(rate(F.col("m.tokens"), F.col("m.p"), y, mean), F.col("key")).alias("n"))
    return rated.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).select("row.*")
