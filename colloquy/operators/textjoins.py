"""Joins of texts: the most similar by shared word n-grams, and unique containment."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _grams(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``key, g``: the distinct word n-grams of whole texts; shorter texts have none."""
    def of(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.when(F.size(w) >= k, F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))

    # The words are bound to a lambda's variable, so that they are split once a text and not once an n-gram.
    grams = F.flatten(F.transform(F.array(F.split(F.trim("text"), " +")), of))
    return rows.select(key, F.array_distinct(grams).alias("gs"))


def jaccard_top(left: DataFrame, left_key: str, right: DataFrame, right_key: str, k: int, top: int) -> DataFrame:
    """The ``top`` right texts of most Jaccard similarity with each left text: ``left_key, place, right_key, jaccard``.

    An equi-join on n-grams, so only texts that share one meet; ties go to the smaller key.
    """
    a = _grams(left, left_key, k).select(left_key, F.size("gs").alias("__a"), F.explode("gs").alias("g"))
    b = _grams(right, right_key, k).select(right_key, F.size("gs").alias("__b"), F.explode("gs").alias("g"))
    both = a.join(b, "g").groupBy(left_key, right_key, "__a", "__b").agg(F.count("*").alias("__n"))
    scored = both.select(left_key, right_key, F.round(F.col("__n") / (F.col("__a") + F.col("__b") - F.col("__n")), 6).alias("jaccard"))
    w = Window.partitionBy(left_key).orderBy(F.desc("jaccard"), right_key)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(left_key, "place", right_key, "jaccard")


def contained(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Left ``id, text`` whose text lies in exactly one right text of the same ``by``: ``by, id, right_id``."""
    r = right.select(*by, F.col("id").alias("right_id"), F.col("text").alias("__t"))
    pairs = left.where("text <> ''").join(r, list(by)).where(F.contains("__t", "text"))
    return pairs.groupBy(*by, "id").agg(F.min("right_id").alias("right_id"), F.count("*").alias("__n")).where("__n = 1").drop("__n")


def aligned_lines(left: DataFrame, right: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Lines of two texts of the same ``by`` that longest matching blocks align: ``by, left_line, right_line``.

    A pair of texts is one task's; its lines are bounded by the longest text.
    """

    def align(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order), b.sort_values(order)
        matcher = difflib.SequenceMatcher(None, a[text].tolist(), b[text].tolist(), autojunk=False)
        rows = [(key[0], int(a[order].iloc[m.a + k]), int(b[order].iloc[m.b + k])) for m in matcher.get_matching_blocks() for k in range(m.size)]
        return pd.DataFrame(rows, columns=[by, "left_line", "right_line"])

    pick = lambda d: d.select(by, order, text).groupBy(by)
    return pick(left).cogroup(pick(right)).applyInPandas(align, f"{by} long, left_line long, right_line long")


class _Bags:
    """Upper bounds of how many adjacent pairs of characters texts share, for many texts at once.

    The bound is a product of rows: for each pair, whether a text has it and how often beyond once.  Pairs rarer than the
    COMMON ones are dealt out by hash.
    """

    COMMON, RARE = 255, 64

    def __init__(self, texts: list[str]):
        often = Counter(g for t in texts for g in zip(t, t[1:]))
        self.place = {g: k if k < self.COMMON else self.COMMON + k % self.RARE for k, (g, _) in enumerate(often.most_common())}

    def rows(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.COMMON + self.RARE), np.int64)
        for row, t in zip(counts, texts):
            np.add.at(row, [self.place[g] for g in zip(t, t[1:])], 1)
        return np.hstack([counts > 0, np.maximum(counts - 1, 0)]).astype(np.uint8 if counts.max(initial=0) < 256 else np.float32)

    @staticmethod
    def shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.float32) @ right.astype(np.float32).T


def _common(t: str, others: np.ndarray, codes: dict[str, int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``t`` (up to 64 characters) and texts given as rows of codes."""
    masks = np.zeros(len(codes) + 1, np.uint64)
    for k, c in enumerate(t):
        masks[codes[c]] |= np.uint64(1 << k)
    v = np.full(len(others), np.iinfo(np.uint64).max, np.uint64)
    for column in np.take(masks, np.ascontiguousarray(others.T)):
        u = v & column
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint64((1 << len(t)) - 1)).astype(np.int64)


def _represented(texts: list[str], least: float, block: int = 256, chunk: int = 8192) -> list[int]:
    """For each of distinct texts the place of its representative: the first before it of a ratio of ``least``, else itself.

    What a ratio counts are M of the T characters, in order, in blocks of which at most one more than characters are
    left over, T - 2M.  So a pair needs M - (T - 2M + 1) adjacent pairs in common, and a common subsequence of M.
    """
    bags = _Bags(texts)
    size = np.array([len(t) for t in texts])
    width = int(size.max(initial=0))
    codes = {c: k + 1 for k, c in enumerate(sorted(set().union(*texts)))}
    coded = np.zeros((len(texts), width if width <= 64 else 0), np.int32)
    for row, t in zip(coded, texts if width <= 64 else []):
        row[: len(t)] = [codes[c] for c in t]
    leads: list[int] = []  # representatives before the block
    held: list[np.ndarray] = []  # their bags
    out = []
    for start in range(0, len(texts), block):
        end = min(start + block, len(texts))
        own = bags.rows(texts[start:end])
        found: list[list[np.ndarray]] = [[] for _ in range(start, end)]
        at = 0
        for part, places in [*((h, None) for h in held), (own, np.arange(start, end))]:
            places = np.array(leads[at : at + len(part)], np.int64) if places is None else places
            at += len(part)
            total = size[start:end, None] + size[places][None, :]
            matched = np.ceil(least * total / 2 - 1e-9)
            i, j = np.nonzero(bags.shared(own, part) >= 3 * matched - total - 1)
            cuts = np.searchsorted(i, np.arange(end - start + 1))
            for k in range(end - start):
                found[k].append(places[j[cuts[k] : cuts[k + 1]]])
        fresh = []
        for k, t in enumerate(texts[start:end]):
            matcher, hit = None, None
            near = np.concatenate(found[k])
            if width <= 64:
                near = near[2.0 * _common(t, coded[near], codes) >= least * (len(t) + size[near]) - 1e-9]
            for p in near.tolist():
                if p >= start + k:
                    break
                if p < start or out[p] == p:
                    matcher = matcher or difflib.SequenceMatcher(None, b=t, autojunk=False)
                    matcher.set_seq1(texts[p])
                    if matcher.ratio() >= least:
                        hit = p
                        break
            out.append(start + k if hit is None else hit)
            if hit is None:
                fresh.append(k)
        leads += [start + k for k in fresh]
        held = held[:-1] + [np.concatenate([held[-1], own[fresh]])] if held and len(held[-1]) < chunk else [*held, own[fresh]]
    return out


def fuzzy_clusters(rows: DataFrame, by: str, key: str, text: str, least: float) -> DataFrame:
    """``by, key, representative``: each text joins the first earlier representative of a similarity ratio of ``least``.

    Greedy in the order of the key, so a group of ``by`` is one task's; equal texts are compared once, and only
    those pairs as sequences whose common pairs of characters, and common subsequence (up to 64 characters), allow the ratio.
    """

    def cluster(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(zip(pdf[key], pdf[text].fillna("")))
        first: dict[str, int] = {}
        for k, t in ordered:
            first.setdefault(t, k)
        texts = list(first)
        lead = {t: first[texts[r]] for t, r in zip(texts, _represented(texts, least))}
        return pd.DataFrame([(group[0], k, lead[t]) for k, t in ordered], columns=[by, key, "representative"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, key, text).groupBy(by).applyInPandas(cluster, f"{by} {kind}, {key} long, representative long")
