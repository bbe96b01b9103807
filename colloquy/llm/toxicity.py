"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned: words, and word beginnings (stems), that are far more frequent among the toxic
documents of a bounded labelled sample.  A trie holds it; its product with the automata that accept strings
within one edit (terms of 4 letters or more) or two (of 8 or more), swapped neighbours being one edit, is
determinised lazily, state by state, so a token is classed by one walk that
mostly ends after a few letters.  Tokens that the sample's clean documents use are known not to be
misspellings.  A hit's context window decides whether it is a quotation (quotation marks around it, or
reporting words near it) or an attack (second person near it).  A logistic regression with prior weights,
fitted on the same sample, turns the counts into a score.

Defined results: null and empty texts have no hits and so the base score, below 0.5 unless most of the
sample is toxic; without labels of both classes there is no lexicon and every score is the smoothed base
rate, kept below 0.5; repeated rows score alike.  Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from colloquy.llm.common import at_most, give_back

#: Labelled documents that are learned from, at most (in expectation).
FIT_DOCS = 12000
MAX_TERMS = 400
MIN_DOCS = 4
STEM = (4, 8)
#: Letters that a term needs for one edit to count, and for two.
FUZZY_FROM, FUZZY_TWO = 4, 8
#: States of an automaton that are kept; more begin anew, which bounds memory.
STATES = 50_000
WINDOW = 6
MEMO = 150_000
WORD = re.compile(r"[@$!*]?[^\W_]+(?:[@$!*'’][^\W_]+)*")
#: Letters that a mask before a word stands for.
MASKS = {"@": "a", "$": "s", "!": "i"}
OWNER = re.compile(r"['’]s?$")
QUOTES = "\"“”„«»‘"
REPORTING = frozenset("said says wrote quoted called cited reported quote word term dit écrit sagte schrieb dijo escribió".split())
SECOND_PERSON = frozenset("you your you're youre ur du dich dein tu toi vous ton tú usted te".split())
FEATURES = ("exact", "stem", "fuzzy", "quoted", "attack", "density")


@dataclass(frozen=True)
class ToxicityModel:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    #: Tokens of clean documents that are within reach of a term.
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-3.0,) + (0.0,) * len(FEATURES)
    memo: dict = field(default_factory=dict, compare=False)


class Matcher:
    """The lexicon trie intersected with the Levenshtein automaton of ``edits`` edits, determinised on demand.

    With ``swaps``, exchanged neighbours are one edit.
    """

    EXACT, STEMMED, FUZZY = 3, 2, 1

    def __init__(self, words: frozenset[str], stems: frozenset[str], edits: int = 1, swaps: bool = False):
        self.edits, self.swaps = edits, swaps
        self.next: list[dict[str, int]] = [{}]
        self.kind = [0]
        self.depth = [0]
        for kind, terms in ((self.STEMMED, stems), (self.EXACT, words)):
            for term in sorted(terms):
                node = 0
                for c in term:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.kind.append(0)
                        self.depth.append(self.depth[node] + 1)
                    node = self.next[node][c]
                self.kind[node] = kind
        #: Letters of the longest word behind a node: pairs whose edits no such word allows are dropped.
        self.far = [d if k == self.EXACT else 0 for k, d in zip(self.kind, self.depth)]
        for node in range(len(self.next) - 1, -1, -1):  # children come after their parents
            self.far[node] = max([self.far[node], *(self.far[x] for x in self.next[node].values())])
        self._begin()

    def _begin(self) -> None:
        #: States of the product: sets of (node, edits used, letter that ends a swap), closed under deletions of a term's letter.
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, pairs: set) -> int:
        far, least = self.far, (0, FUZZY_FROM, FUZZY_TWO)
        closed = {p for p in pairs if not p[1] or far[p[0]] >= least[p[1]]}
        fresh = closed
        while fresh:
            fresh = {(child, used + 1, "") for node, used, owed in fresh if used < self.edits and not owed for child in self.next[node].values() if far[child] >= least[used + 1]} - closed
            closed = closed | fresh
        key = frozenset((n, u, o) for n, u, o in closed if not (u and (n, 0, o) in closed or u == 2 and (n, 1, o) in closed))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(max((self._accept(n, u) for n, u, o in key if not o), default=0))
        return self.ids[key]

    def _accept(self, node: int, used: int) -> int:
        kind = self.kind[node]
        if used == 0:
            return kind
        return self.FUZZY if kind == self.EXACT and self.depth[node] >= (FUZZY_FROM if used == 1 else FUZZY_TWO) else 0

    def _move(self, state: int, c: str) -> int:
        pairs = set()
        for node, used, owed in self.sets[state]:
            if owed:
                if owed == c:
                    pairs.add((node, used, ""))
                continue
            child = self.next[node].get(c)
            if child is not None:
                pairs.add((child, used, ""))
            if used < self.edits:
                pairs.add((node, used + 1, ""))  # a letter too many
                for letter, x in self.next[node].items():
                    pairs.add((x, used + 1, ""))  # another letter
                    if self.swaps and letter != c and c in self.next[x]:
                        pairs.add((self.next[x][c], used + 1, letter))
        to = self._state(pairs) if pairs else -1
        self.moves[state][c] = to
        return to

    def match(self, token: str) -> int:
        """EXACT for a word of the lexicon, STEMMED if a stem begins the token, FUZZY within its edits of a word, else 0."""
        if len(self.sets) > STATES:
            self._begin()
        state, node, stem = self.start, 0, 0
        for c in token:
            if node >= 0:
                node = self.next[node].get(c, -1)
                if node >= 0 and self.kind[node] == self.STEMMED:
                    stem = self.STEMMED
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return stem
        return max(self.accepts[state], stem)


class Lexicon:
    """One edit from FUZZY_FROM letters, two from FUZZY_TWO; a first letter may be masked, and an owner's s is no letter."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        self.one = Matcher(words, stems, 1, True)
        long = frozenset(w for w in words if len(w) >= FUZZY_TWO)
        self.two = Matcher(long, frozenset(), 2, True) if long else None
        self.longest = max(map(len, long), default=0) + 2

    def match(self, token: str) -> int:
        kind = self.one.match(token)
        if kind == 0 and self.two and FUZZY_TWO - 2 <= len(token) <= self.longest:
            kind = self.two.match(token)
        return kind

    def classify(self, token: str, clean: frozenset[str]) -> int:
        """The match of a token of a text, if it is no misspelling that the clean documents use."""
        if token.isalnum():
            kind = self.match(token)
            return 0 if kind == Matcher.FUZZY and token in clean else kind
        whole = OWNER.sub("", token)
        bare = whole.lstrip("@$!*")
        best = 0
        for form in dict.fromkeys((bare, whole, MASKS.get(whole[:1], "") + bare, token.lstrip("@$!*"))):
            kind = self.match(form)
            if kind == Matcher.FUZZY and (form in clean or bare in clean):
                kind = 0
            best = max(best, kind)
        return best


def _matcher(model: ToxicityModel) -> Lexicon:
    if "matcher" not in model.memo:
        model.memo["matcher"] = Lexicon(model.words, model.stems)
        model.memo["kinds"] = {}
    return model.memo["matcher"]


def features(text: str | None, model: ToxicityModel) -> np.ndarray:
    """Counts of a whole text, in the order of FEATURES."""
    x = np.zeros(len(FEATURES))
    if not text or not (model.words or model.stems):
        return x
    matcher = _matcher(model)
    kinds: dict[str, int] = model.memo["kinds"]
    lower = text.lower()
    tokens = WORD.findall(lower)
    hits = []
    for k, token in enumerate(tokens):
        kind = kinds.get(token)
        if kind is None:
            if len(kinds) > MEMO:
                kinds.clear()
            kind = matcher.classify(token, model.clean)
            kinds[token] = kind
        if kind:
            hits.append((k, kind))
    if not hits:
        return x
    places = {}
    wanted = {k for k, _ in hits}
    for k, m in enumerate(WORD.finditer(lower)):
        if k in wanted:
            places[k] = m.span()
    for k, kind in hits:
        start, end = places[k]
        near = tokens[max(0, k - WINDOW) : k + WINDOW + 1]
        quoted = any(c in QUOTES for c in lower[max(0, start - 40) : start]) and any(c in QUOTES for c in lower[end : end + 40]) or any(w in REPORTING for w in near)
        if quoted:
            x[3] += 1
        else:
            x[Matcher.EXACT - kind] += 1
            x[4] += any(w in SECOND_PERSON for w in near)
    x[5] = 20 * (x[0] + x[1] + x[2]) / len(tokens)
    return np.log1p(x)


def _tokens(rows: DataFrame) -> DataFrame:
    """``y, w`` of each document's distinct words."""
    return rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))


def _counts(tokens: DataFrame) -> DataFrame:
    """``stem, w, toxic, all`` of words (stem 0) and of stems, each once for each word that it begins; the texts are read once."""
    form = lambda stem, w: F.struct(F.lit(stem).alias("stem"), w.alias("w"))
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: form(1, F.when(F.length("w") > n, F.substring("w", F.lit(1), n))))
    forms = tokens.select("y", F.explode(F.concat(F.array(form(0, F.col("w"))), stems)).alias("f")).where("f.w is not null").select("y", "f.stem", "f.w")
    return forms.groupBy("stem", "w").agg(F.sum("y").alias("toxic"), F.count("*").alias("all"))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = FIT_DOCS) -> ToxicityModel:
    """Learn from rows with a label 0 or 1; at most about ``sample`` documents (documented bound)."""
    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(key).alias("k")).where("t is not null and y in (0, 1)")
    rows = at_most(rows, sample, "toxicity", "k")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return ToxicityModel()

    # Each document's distinct words and stems, counted by class; only those few that are frequent and lean to one side return.
    tokens = _tokens(rows)
    counts = _counts(tokens)
    lean = F.log((F.col("toxic") + 0.1) / (n[1] + 1)) - F.log((F.col("all") - F.col("toxic") + 0.1) / (n[0] + 1))
    terms = counts.where(f"toxic >= {MIN_DOCS}").withColumn("lean", lean).where("lean > 3.5").orderBy(F.desc(F.col("lean") * F.sqrt("toxic")), "w").limit(10 * MAX_TERMS).collect()
    chosen, kept = [t for t in terms if t["stem"] == 0][:MAX_TERMS], []
    for t in sorted((t for t in terms if t["stem"]), key=lambda t: len(t["w"])):
        # A stem needs several words behind it that are not all one word, and no shorter stem.
        if not any(t["w"].startswith(s) for s in kept) and max((w["toxic"] for w in chosen if w["w"].startswith(t["w"])), default=0) < 0.5 * t["toxic"]:
            kept.append(t["w"])
    model = ToxicityModel(frozenset(w["w"] for w in chosen), frozenset(kept[:MAX_TERMS]))
    matcher = Lexicon(model.words, model.stems)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = batch[[matcher.match(w) == Matcher.FUZZY for w in batch["w"]]]
            if len(near):
                yield near

    clean = tokens.where("y = 0").select("w").distinct().mapInPandas(reach, "w string")
    model = ToxicityModel(model.words, model.stems, frozenset(r["w"] for r in clean.collect()))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [features(t, model).tolist() for t in batch["t"]]})

    got = rows.select("y", "t").mapInPandas(project, "y int, x array<double>").groupBy("y", "x").count().collect()
    x, y, w = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float), np.array([r["count"] for r in got], float)
    return ToxicityModel(model.words, model.stems, model.clean, tuple(_regress(x, y, w)))


def _regress(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float]:
    """Weighted logistic regression by Newton steps, with weights drawn to a prior where the sample says little."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior, stiff = np.array([-4.0, 6.0, 6.0, 3.0, 0.5, 1.0, 0.0]), np.array([0.05, 0.2, 0.2, 0.5, 1, 1, 1])
    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (w * (p - y)) + stiff * (b - prior)
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(stiff), gradient)
        b = b - step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def score(text: str | None, model: ToxicityModel) -> tuple[float, float]:
    """The score, and the number of unquoted hits."""
    x = features(text, model)
    z = model.weights[0] + float(np.dot(model.weights[1:], x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), float(np.expm1(x[:3]).sum())


def scorer(model: ToxicityModel):
    """A pandas UDF from a text to ``struct<score, hits>``."""

    @pandas_udf("score double, hits double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([score(t, model) for t in batch], columns=["score", "hits"])
        model.memo.clear()
        give_back()

    return run


def toxicity(text: Column | str, model: ToxicityModel) -> Column:
    return scorer(model)(text)
