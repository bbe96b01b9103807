"""Language identification by multilingual mixture inference.

A model holds, for every learned language, the log probabilities of hashed letter trigrams (with word
edges).  A text is a bag of words, each drawn from one of the languages; a word's likelihood is the
product of its trigrams'.  Expectation-maximisation estimates the text's language proportions.  The
language set is then selected by penalised likelihood: the best one, two or three languages are fitted
again and the set with the largest ``log-likelihood - penalty * (size - 1) * log(words)`` is kept.  The
prediction is the selected language with the largest share.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a tie goes to the first
language in name order; a model without languages predicts ``und`` for all; repeated rows get equal
results; other columns are never read.  Long texts are processed whole, in slices of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from colloquy.llm.common import give_back, uniform

UNDETERMINED = "und"
BITS = 14
#: Documents per language that the trigram tables are fitted on, at most (in expectation).
FIT_DOCS = 3000
#: Code points that are worked on at once.
SLICE = 1 << 20
STEPS = 8
PENALTY = 1.0
SETS = 3
#: Words from which a text counts for the deviation between texts; the least deviation, in nats a letter.
LONG, LEAST = 20, 0.1

_letters: np.ndarray | None = None


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: (2 ** BITS, languages) log probabilities.
    table: np.ndarray
    #: Of each language's learned texts: mean of the words' evidence, its deviation between texts, and between words.
    evidence: tuple[tuple[float, float, float], ...] = ()


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return _letters


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; what is no letter is 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plane0 = codes < 0x10000
    letter = _letter_table()[np.where(plane0, codes, 0)]
    if not plane0.all():  # the other planes have few letters: each code point is asked for once
        beyond = codes[~plane0]
        known = {c: chr(c).isalpha() for c in np.unique(beyond).tolist()}
        letter[~plane0] = [known[c] for c in beyond.tolist()]
    return np.where(letter, codes, 0)


def _trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter its hashed trigram, the places where words begin among them, and in ``codes``."""
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = codes
    at = np.flatnonzero(codes)
    mixed = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    grams = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    first = np.flatnonzero(padded[at] == 0)
    return grams, first, at[first]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = FIT_DOCS) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language; at most ``per_language`` texts of each (documented bound)."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in docs.select(F.col(lang).alias("l")).where("l is not null").groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32))
    share = F.coalesce(*[F.when(F.col("l") == one, F.lit(per_language / n)) for one, n in sizes.items()])
    picked = rows.where(uniform(F.lit("langid"), "k") < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for t, one in zip(batch["t"], batch["l"]):
                for start in range(0, len(t), SLICE):
                    grams = _trigrams(_codes(t[start : start + SLICE]))[0]
                    got = np.bincount(grams, minlength=1 << BITS)
                    sums[one] = sums[one] + got if one in sums else got
        if sums:  # an empty frame of objects has no Arrow type
            yield pd.DataFrame({"l": list(sums), "n": [v.astype("<i8").tobytes() for v in sums.values()]})

    # The sample is bounded, so eight tasks and one table a language and task are.
    got = picked.select("t", "l").repartition(8).mapInPandas(count, "l string, n binary").collect()
    counts = np.full((1 << BITS, len(languages)), 0.5)
    for one, n in got:
        counts[:, languages.index(one)] += np.frombuffer(n, "<i8")
    model = LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, one in zip(batch["t"], batch["l"]):
                n, total, squares = word_evidence(t, model)
                if n:
                    own = total / n
                    sums[one] = sums.get(one, np.zeros(6)) + [n, total, squares, *((1, own, own * own) if n >= LONG else (0, 0, 0))]
        if sums:
            yield pd.DataFrame({"l": list(sums), "x": [v.tolist() for v in sums.values()]})

    sums = dict.fromkeys(languages, np.zeros(6))
    for one, x in picked.select("t", "l").repartition(8).mapInPandas(calibrate, "l string, x array<double>").collect():
        sums[one] = sums[one] + x
    spread = lambda n, total, squares: max(LEAST, float(np.sqrt(max(0.0, squares / n - (total / n) ** 2)))) if n else LEAST
    known = tuple((x[1] / x[0], spread(*x[3:]), spread(*x[:3])) if x[0] else (0.0, LEAST, LEAST) for x in (sums[one] for one in languages))
    return LanguageModel(languages, model.table, known)


def _mix(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM of mixture proportions ``pi`` (documents, languages), and the log-likelihood of the words."""
    n = np.diff(np.append(starts, len(doc)))[:, None].astype(np.float32)
    for _ in range(steps):
        joint = like * pi[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        pi = np.add.reduceat(joint, starts, axis=0) / n
    total = np.log(np.maximum((like * pi[doc]).sum(axis=1), 1e-30))
    return pi, np.add.reduceat(total.astype(np.float64), starts)


def infer(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (texts, languages), the number of selected languages, and the number of words."""
    out = np.zeros((len(texts), len(model.languages)), np.float32)
    sizes, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not texts or not model.languages:
        return out, sizes, words
    tokens = [(t, k) for k, text in enumerate(texts) for t in _word_likelihoods(text, model)]
    if not tokens:
        return out, sizes, words
    doc = np.concatenate([np.full(len(t), k) for t, k in tokens])
    logs = np.concatenate([t for t, _ in tokens])
    like = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -30)).astype(np.float32)
    present, doc, n = np.unique(doc, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    full, _ = _mix(like, doc, starts, np.full((len(present), like.shape[1]), 1 / like.shape[1], np.float32), STEPS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, best_score, best_size = full, np.full(len(present), -np.inf), np.zeros(len(present), np.int64)
    for k in range(1, min(SETS, like.shape[1]) + 1):
        pi = np.where(rank < k, np.maximum(full, 1e-3), 0).astype(np.float32)
        pi, score = _mix(like, doc, starts, pi / pi.sum(axis=1, keepdims=True), 0 if k == 1 else 2)
        score = score - PENALTY * (k - 1) * np.log(n + 1.0)
        better = score > best_score
        best = np.where(better[:, None], pi, best)
        best_size = np.where(better, k, best_size)
        best_score = np.where(better, score, best_score)
    out[present], sizes[present], words[present] = best, best_size, n
    return out, sizes, words


def _word_likelihoods(text: str, model: LanguageModel) -> Iterator[np.ndarray]:
    """(words, languages) log-likelihoods of a whole text, slice by slice."""
    for likelihoods, _ in _words(text, model):
        yield likelihoods


def word_evidence(text: str | None, model: LanguageModel) -> tuple[int, float, float]:
    """Number, sum and sum of squares of the words' evidence: their best log-likelihood of any language, a letter."""
    n, total, squares = 0, 0.0, 0.0
    for likelihoods, letters in _words(text or "", model):
        own = likelihoods.max(axis=1).astype(np.float64) / letters
        n, total, squares = n + len(own), total + float(own.sum()), squares + float(own @ own)
    return n, total, squares


def _surprise(text: str | None, lang: str, model: LanguageModel) -> float | None:
    """By how many deviations a text's words are less likely than those of the learned texts of ``lang``; None without words.

    It does not depend on how the other languages do, so texts of languages that were never learned stand out.
    The deviation is that between texts and, for short texts, between words.
    """
    if lang not in model.languages:
        return None
    n, total, _ = word_evidence(text, model)
    mean, between, within = model.evidence[model.languages.index(lang)]
    return (mean - total / n) / (between**2 + within**2 / n) ** 0.5 if n else None


def _words(text: str, model: LanguageModel) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-likelihoods (words, languages) and letters of a text's words, slice by slice; slices end at a blank where they can."""
    start = 0
    while start < len(text):
        end = start + SLICE
        if end < len(text):
            cut = text.rfind(" ", start + SLICE // 2, end)
            end = cut if cut > start else end
        grams, first, _ = _trigrams(_codes(text[start:end]))
        if len(first):
            yield np.add.reduceat(model.table[grams], first, axis=0), np.diff(np.append(first, len(grams)))
        start = end


def _predicted(texts: list[str], model: LanguageModel) -> list[tuple[str, float, int]]:
    """Language, score and size of the language set of each text, by runs of about SLICE code points."""
    out: list[tuple[str, float, int]] = []
    start = 0
    while start < len(texts):
        step, size = start, 0
        while step < len(texts) and (step == start or size + len(texts[step]) <= SLICE):
            size += len(texts[step])
            step += 1
        for p, s, n in zip(*infer(texts[start:step], model)):
            top = int(p.argmax()) if n else -1
            out.append((model.languages[top], min(1.0, max(0.0, float(p[top]))), int(s)) if n else (UNDETERMINED, 0.0, int(s)))
        start = step
    return out


def predictor(model: LanguageModel, judged: bool = False):
    """A pandas UDF from a text to ``struct<lang, score, n_languages>``; ``judged`` adds ``surprise`` (:func:`_surprise`)."""

    @pandas_udf("lang string, score double, n_languages int" + (", surprise double" if judged else ""))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            got = _predicted(texts, model)
            frame = pd.DataFrame(got, columns=["lang", "score", "n_languages"]).astype({"score": float, "n_languages": "int32"})
            if judged:
                frame["surprise"] = pd.Series([_surprise(t, g[0], model) for t, g in zip(texts, got)], dtype="float64")
            yield frame
        give_back()

    return predict


def predict(text: Column | str, model: LanguageModel) -> Column:
    return predictor(model)(text)


def judge(text: Column | str, model: LanguageModel) -> Column:
    """The prediction and its surprise in one pass over the texts, so by one Python worker a task."""
    return predictor(model, True)(text)
