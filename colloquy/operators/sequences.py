"""Ordered operators: transitions, turns, sessions, history, and hidden Markov models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ("ts", "span")


def transitions(spans: DataFrame, group: str = "condition", conversation: str = "conv", label: str = "label", order: tuple[str, ...] = ORDER) -> DataFrame:
    """``group, source, target, n, p`` of adjacent labels; p within the source."""
    w = Window.partitionBy(group, conversation).orderBy(*order)
    pairs = spans.select(group, F.col(label).alias("source"), F.lead(label).over(w).alias("target")).where("target is not null")
    counted = pairs.groupBy(group, "source", "target").agg(F.count("*").alias("n"))
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group, "source")))


def turns(spans: DataFrame, conversation: str = "conv", speaker: str = "speaker", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Maximal runs of one speaker: ``conv, turn, speaker, n``, and places from the start and the end of the speaker's turns.

    Runs without a label are dropped after the runs are found, so they still part their neighbours.
    """
    w = Window.partitionBy(conversation).orderBy(*order)
    new = F.coalesce((F.col(speaker) != F.lag(speaker).over(w)).cast("int"), F.lit(0))
    runs = spans.withColumn("__new", new).withColumn("turn", F.sum("__new").over(w))
    runs = runs.groupBy(conversation, "turn", speaker).agg(F.count("label").alias("n")).where("n > 0")
    own = Window.partitionBy(conversation, speaker)
    return runs.withColumn("from_start", F.row_number().over(own.orderBy("turn"))).withColumn("from_end", F.row_number().over(own.orderBy(F.desc("turn"))))


def sessions(spans: DataFrame, marker: Column, conversation: str = "conv", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``segment``: a marker starts a new one unless the current one is still empty."""
    w = Window.partitionBy(conversation).orderBy(*order)
    at = F.row_number().over(w)
    start = (marker & (at > 1)).cast("int")
    return spans.withColumn("__s", start).withColumn("segment", F.sum("__s").over(w)).drop("__s")


def last_of_other(spans: DataFrame, value: str, conversation: str = "conv", speaker: str = "speaker", other: str = "Counsellor", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``before``: the last value of the other speaker before each row (an as-of join, without a join)."""
    w = Window.partitionBy(conversation).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before", F.last(F.when(F.col(speaker) == other, F.col(value)), ignorenulls=True).over(w))


def viterbi(symbols: Column, start: list[float], trans: list[list[float]], emit: dict[str, list[float]]) -> Column:
    """Final score and state of the best path through an array of symbols, as one array fold.

    The last best state of a prefix is the arg-max of its trellis column, so prefixes need no decoding anew.
    Ties go to the lower state.
    """
    k = len(start)
    log = np.log
    rows = F.create_map(*[x for s, ps in sorted(emit.items()) for x in (F.lit(s), F.array(*[F.lit(float(log(p))) for p in ps]))])
    first = F.array(*[F.lit(float(log(p))) for p in start])

    def step(acc: Column, s: Column) -> Column:
        e = F.element_at(rows, s)
        scores = [F.greatest(*[acc["v"][i] + F.lit(float(log(trans[i][j]))) for i in range(k)]) + e[j] for j in range(k)]
        began = [first[j] + e[j] for j in range(k)]
        return F.struct(F.when(acc["n"] == 0, F.array(*began)).otherwise(F.array(*scores)).alias("v"), (acc["n"] + 1).alias("n"))

    done = lambda acc: F.struct(F.array_max(acc["v"]).alias("score"), (F.array_position(acc["v"], F.array_max(acc["v"])) - 1).cast("int").alias("state"))
    return F.aggregate(symbols, F.struct(first.alias("v"), F.lit(0).alias("n")), step, done)


class _Steps:
    """Sequences side by side, longest first: the symbols at each step of those that reach it.  A sequence counts ``weights`` times."""

    def __init__(self, seqs: list[np.ndarray], weights: list[int] | None = None):
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        by_length = [seqs[i] for i in order]
        sizes = np.array([len(x) for x in by_length])
        self.weights = np.array([weights[i] if weights else 1 for i in order], float)
        self.x = [np.array([x[t] for x in by_length[: int((sizes > t).sum())]]) for t in range(sizes[0])]

    def expected(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of several models at once (the first axis): log-likelihoods, and the expected counts of starts, transitions and emissions.

        States come before sequences, so that every operation runs along the sequences.  Every fourth step is scaled.
        """
        models, k, m = b.shape
        one, onward, alpha, scales, logs = np.eye(m), np.ascontiguousarray(a.transpose(0, 2, 1)), [], {}, np.zeros((models, len(self.weights)))
        last = np.empty_like(logs)
        for t, x in enumerate(self.x):
            n, v = len(x), np.take(b, x, axis=2)  # unlike b[:, :, x], in row order
            v *= onward @ alpha[-1][:, :, :n] if t else pi[:, :, None]
            if t % 4 == 3:
                c = scales[t] = np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
                v /= c
                logs[:, :n] += np.log(c[:, 0])
            alpha.append(v)
            over = len(self.x[t + 1]) if t + 1 < len(self.x) else 0
            if over < n:
                last[:, over:n] = np.maximum(v[:, :, over:].sum(axis=1), 1e-300)
        ended = np.repeat((self.weights / last)[:, None], k, axis=1)
        n_a, n_b, beta = np.zeros((models, k, k)), np.zeros((models, k, m)), ended[:, :, :0]
        for t in range(len(self.x) - 1, -1, -1):
            x = self.x[t]
            if len(x) > beta.shape[2]:
                beta = np.concatenate([beta, ended[:, :, beta.shape[2] : len(x)]], axis=2)
            gamma = alpha[t] * beta
            n_b += gamma @ one[x]
            if t:
                beta *= np.take(b, x, axis=2)
                if t in scales:
                    beta /= scales[t]
                n_a += alpha[t - 1][:, :, : len(x)] @ beta.transpose(0, 2, 1)
                beta = a @ beta
        return (logs + np.log(last)) @ self.weights, gamma.sum(axis=2), a * n_a, n_b

    def forward(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], float]:
        """Scaled forward variables and scales of every step, and the log-likelihood."""
        alpha, scale = [], []
        for t, x in enumerate(self.x):
            v = (pi if t == 0 else alpha[-1][: len(x)] @ a) * b.T[x]
            c = np.maximum(v.sum(axis=1), 1e-300)
            alpha.append(v / c[:, None])
            scale.append(c)
        return alpha, scale, float(sum(self.weights[: len(c)] @ np.log(c) for c in scale))

    def occupancy(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shares of the observations on the states of the best paths (Viterbi)."""
        counts = self.occupied(pi, a, b)
        return counts / counts.sum()

    def occupied(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Observations on the states of the best paths."""
        with np.errstate(divide="ignore"):
            pi, a, e = np.log(pi), np.log(a), np.log(b.T)
        v, back = pi + e[self.x[0]], []
        ends = [v]
        for x in self.x[1:]:
            paths = ends[-1][: len(x), :, None] + a
            back.append(paths.argmax(axis=1))
            ends.append(paths.max(axis=1) + e[x])
        counts, state = np.zeros(len(pi)), np.zeros(0, int)
        for t in range(len(self.x) - 1, -1, -1):
            before = back[t][np.arange(len(state)), state] if len(state) else state
            state = np.concatenate([before, ends[t][len(state) :].argmax(axis=1)])
            counts += np.bincount(state, self.weights[: len(state)], len(pi))
        return counts


#: Sequences that are worked on at once, and restarts that are fitted side by side in one task.
PART, BESIDE = 1024, 5


def _parts(seqs: list[np.ndarray], weights: list[int] | None = None) -> list[_Steps]:
    """Sequences of similar length side by side, PART at a time."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    cut = [order[at : at + PART] for at in range(0, len(order), PART)]
    return [_Steps([seqs[i] for i in part], [weights[i] for i in part] if weights else None) for part in cut]


def _fits(parts: list[_Steps], k: int, m: int, seeds: list[int], iterations: int, tolerance: float) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """For every seed the log-likelihood of the fitted parameters, and these: start, transitions, emissions.

    The fits run side by side, each until its own log-likelihood gains less than ``tolerance``.
    """
    drawn = [(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(m), k)) for r in map(np.random.default_rng, seeds)]
    pi, a, b = (np.array(x) for x in zip(*drawn))
    going, last = np.arange(len(seeds)), np.full(len(seeds), -np.inf)
    for _ in range(iterations):
        total, n_pi, n_a, n_b = (sum(x) for x in zip(*(part.expected(pi[going], a[going], b[going]) for part in parts)))
        pi[going] = n_pi / sum(part.weights.sum() for part in parts)
        a[going] = (n_a + 1e-12) / (n_a + 1e-12).sum(axis=2, keepdims=True)
        b[going] = (n_b + 1e-12) / (n_b + 1e-12).sum(axis=2, keepdims=True)
        gained = ~(total - last[going] < tolerance)
        last[going] = total
        going = going[gained]
        if not len(going):
            break
    return [(sum(part.forward(*model)[2] for part in parts), *model) for model in zip(pi, a, b)]


def _baum_welch(seqs: list[np.ndarray], k: int, m: int, seed: int, iterations: int, tolerance: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The log-likelihood of the fitted parameters, and these: start, transitions, emissions."""
    return _fits(_parts(seqs), k, m, [seed], iterations, tolerance)[0]


def fit_hmm(sequences: DataFrame, states: list[int], restarts: int = 5, iterations: int = 50, tolerance: float = 1e-3, group: str = "condition") -> DataFrame:
    """Categorical hidden Markov models by Baum-Welch, the best of several restarts for each group and state count.

    ``sequences`` has ``group, conv, symbols`` (array of strings).  Equal sequences are fitted as one with a weight,
    which gives the same counts.  Every restart is a fit of its own; BESIDE of a (group, states) share a task, and the
    tasks are dealt out to more partitions than there are of (states, restart).  Returns ``group, k, log_likelihood, n_params, bic, aic, min_occupancy, min_pairwise_tv`` of the best
    restart (occupancy by best paths; total variation of two states' emissions), and ``distinct_optima``: the
    restarts' different log-likelihoods, to two places.
    """
    different = sequences.where(F.size("symbols") >= 2).groupBy(group, "symbols").agg(F.count("*").alias("times"))
    tasks = different.withColumn("k", F.explode(F.array(*[F.lit(k) for k in states])))
    tasks = tasks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1), F.lit(BESIDE))))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((list(s), n) for s, n in zip(pdf["symbols"], pdf["times"]))
        alphabet = sorted({x for s, _ in rows for x in s})
        code = {s: i for i, s in enumerate(alphabet)}
        parts = _parts([np.array([code[x] for x in s]) for s, _ in rows], [n for _, n in rows])
        k, m, n = int(key[1]), len(alphabet), sum(len(s) * n for s, n in rows)
        free = (k - 1) + k * (k - 1) + k * (m - 1)
        numbers, out = range(int(key[2]), min(int(key[2]) + BESIDE, restarts)), []
        for restart, (score, pi, a, b) in zip(numbers, _fits(parts, k, m, [42 + r for r in numbers], iterations, tolerance)):
            apart = min((np.abs(b[i] - b[j]).sum() / 2 for i in range(k) for j in range(i)), default=np.nan)
            occupied = sum(part.occupied(pi, a, b) for part in parts)
            out.append((key[0], k, restart, score, free, free * np.log(n) - 2 * score, 2 * free - 2 * score, occupied.min() / occupied.sum(), apart))
        return pd.DataFrame(out, columns=[group, "k", "restart", "log_likelihood", "n_params", "bic", "aic", "min_occupancy", "min_pairwise_tv"])

    kind = sequences.schema[group].dataType.simpleString()
    # By number, as adaptive execution would put fits into few tasks: their rows are few, their work is not.
    dealt = tasks.repartition(2 * len(states) * restarts, group, "k", "first")
    fitted = dealt.groupBy(group, "k", "first").applyInPandas(fit, f"{group} {kind}, k int, restart int, log_likelihood double, n_params int, bic double, aic double, min_occupancy double, min_pairwise_tv double")
    best = Window.partitionBy(group, "k").orderBy(F.desc("log_likelihood"), "restart")
    optima = F.size(F.collect_set(F.round("log_likelihood", 2)).over(Window.partitionBy(group, "k")))
    return fitted.withColumn("distinct_optima", optima).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "restart")


def viterbi_prefixes(symbols: Column, start: list[float], trans: list[list[float]], emit: dict[str, list[float]], empty: int) -> Column:
    """The best path's last state before each symbol, decoded from the symbols before it; ``empty`` where there are none.

    One forward pass: the state of a prefix is the arg-max of its trellis column.
    """
    k = len(start)
    rows = F.create_map(*[x for s, ps in sorted(emit.items()) for x in (F.lit(s), F.array(*[F.lit(float(np.log(p))) for p in ps]))])

    def step(acc: Column, s: Column) -> Column:
        e = F.element_at(rows, s)
        later = F.array(*[F.greatest(*[acc["v"][i] + F.lit(float(np.log(trans[i][j]))) for i in range(k)]) + e[j] for j in range(k)])
        first = F.array(*[F.lit(float(np.log(start[j]))) + e[j] for j in range(k)])
        best = (F.array_position(acc["v"], F.array_max(acc["v"])) - 1).cast("int")
        began = F.size(acc["out"]) == 0
        return F.struct(F.when(began, first).otherwise(later).alias("v"), F.array_append(acc["out"], F.when(began, F.lit(empty)).otherwise(best)).alias("out"))

    zero = F.struct(F.array(*[F.lit(0.0)] * k).alias("v"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(symbols, zero, step, lambda acc: acc["out"])


def repaired_roles(spans: DataFrame, marker: Column, signal: Column, conversation: str = "conv", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``segment`` and ``role``: roles alternate in a segment, from the speaker that agrees more with ``signal``.

    The first segment is the client's alone; without a signal, or in a tie, the counsellor begins.
    """
    rows = sessions(spans, marker, conversation, order).withColumn("__signal", signal)
    own = Window.partitionBy(conversation, "segment")
    rows = rows.withColumn("__odd", (F.row_number().over(own.orderBy(*order)) - 1) % 2)
    by_counsellor = F.when(F.col("__odd") == 0, "Counsellor").otherwise("Client")
    hits, scored = F.count_if(F.col("__signal") == by_counsellor).over(own), F.count("__signal").over(own)
    swap = (scored - hits > hits).cast("int")
    role = F.when(F.col("segment") == 0, "Client").when((F.col("__odd") + swap) % 2 == 0, "Counsellor").otherwise("Client")
    return rows.withColumn("role", role).drop("__signal", "__odd")


def transition_fdr(spans: DataFrame, compared: str, reference: str, replicates: int, purpose: str, least: int = 10, q: float = 0.1) -> DataFrame:
    """Transitions whose probability differs between two conditions more than between halves of the reference.

    Cells off the diagonal with ``least`` transitions in both together: ``source, target, n, delta, p, bh``.
    Counts are per conversation first, so a replicate is a sum over conversations, not a pass over the spans.
    """
    from colloquy.operators.resampling import half_counts
    from colloquy.operators.tests import adjusted

    two = spans.where(F.col("condition").isin(compared, reference))
    w = Window.partitionBy("condition", "conv").orderBy(*ORDER)
    pairs = two.select("condition", "conv", F.col("label").alias("source"), F.lead("label").over(w).alias("target")).where("target is not null")
    counts = pairs.groupBy("condition", "conv", "source", "target").agg(F.count("*").alias("k"))

    def delta(rows: DataFrame, side: Column, *by: str) -> DataFrame:
        of = lambda x: F.sum(F.when(side == x, F.col("k")).otherwise(0))
        sums = rows.groupBy(*by, "source", "target").agg(of(1).alias("x"), of(0).alias("y"))
        own = Window.partitionBy(*by, "source")
        share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(own)), F.lit(0.0))
        return sums.select(*by, "source", "target", (F.col("x") + F.col("y")).alias("n"), (share("x") - share("y")).alias("delta"))

    cells = delta(counts, (F.col("condition") == compared).cast("int")).where((F.col("n") >= least) & (F.col("source") != F.col("target")))
    of_reference = F.col("condition") == reference
    split = half_counts(two.where(of_reference), counts.where(of_reference), replicates, purpose, "source", "target")
    null = delta(split, 1 - F.col("half"), "b").select("b", "source", "target", F.col("delta").alias("null_delta"))
    every = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).join(null, ["b", "source", "target"], "left")
    hits = F.count_if(F.round(F.abs(F.coalesce("null_delta", F.lit(0.0))), 9) >= F.round(F.abs("delta"), 9))
    tested = every.groupBy("source", "target", "n", "delta").agg(((1 + hits) / (replicates + 1)).alias("p"))
    return adjusted(tested.withColumn("cell", F.concat_ws(">", "source", "target")), "p", "cell", q).select("source", "target", "n", "delta", "p", "bh")
