"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over word one- and two-grams of phrases is fitted on notices of licence families
(templates: whole, cut, and with words left out; and usual phrases around the licences' names) against an unknown
class: all sentences of the corpus that match no family, and phrases that speak of the same names without granting
anything.  The unit of classification is a paragraph's sentence; neighbours of one family are one notice.  The most
probable family stands if the probability of a licence passes a threshold, at which at most FALSE_RATE of held-out
unknown sentences pass.  Comparison with the family's own templates then confirms or rejects it (enough of a
template's adjacent word pairs are in the notice, or a phrase names the licence); it never names another family.

Every sentence of the corpus counts, in the fit or, with every other profile, in the threshold: sentences are summed
up by profile (their grams that a phrase has, and the number of all their grams), profiles are packed into blocks, and
each step of the fit sums the blocks' gradients.  Grams that no phrase has only dilute the others.

Defined results: null and empty texts have no licence (empty list); a text may have several; repeated rows
get equal results; an empty table gives none; a corpus without texts is scanned with the phrases alone as unknown
class.  Texts are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from colloquy.llm.common import give_back, written

#: Sentences of either half of the corpus weigh as much as so many, together, beside the phrases.
UNKNOWN_WEIGHT = 10_000
#: Profiles of a block, about; and those that a task sums up before it hands them on.
BLOCK, HELD = 50_000, 200_000
EPOCHS, CONFIRM, FALSE_RATE = 80, 0.5, 1e-3
#: Usual names and wordings of licences, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-3-Clause", "2-clause BSD license"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License", "GPL-3.0-or-later", "GPLv3", "GPL version 2"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPL-2.1-only", "LGPLv3"),
    "mit": ("MIT License", "MIT licensed", "MIT licence", "SPDX-License-Identifier: MIT"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
}
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
}
#: Phrases that grant a licence by its name, and phrases that only speak of it.
GRANTS = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under a {}", "Distributed under the terms of the {}", "is available under the {}", "SPDX-License-Identifier: {}", "{} licensed", "License: {}", "under the terms of the {}", "This work is licensed under the {}", "published under {}")
TALK = (
    "we compared the {} with other licenses", "a talk about the {} and its history", "the lawyer explained what the {} means", "the {} was written long ago", "she works at {} in a laboratory", "the driver showed a license to the officer",
    "the licence of the driver was valid", "a license is needed to fish here", "software is distributed to the public", "the general public was not admitted", "the conditions of use have changed", "a copy of the document was obtained",
    "this file is part of the archive", "permission to enter was granted", "mit", "mit der zeit", "the mit campus", "gnu", "apache", "mozilla", "the terms of the agreement are unclear", "this work is about free software", "the version of the program was released in spring", "which license should a project choose, {} or another",
)
UNKNOWN = "unknown"
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_SENTENCE = re.compile(r"\n+|(?<=[.!?;])\s+(?=[^\W\d_a-z])")


@dataclass(frozen=True)
class Templates:
    """The adjacent word pairs of the families' templates and names; a name of one word is that word."""

    families: list[int]
    sizes: list[int]
    #: The templates that a gram is in.
    having: dict[int, list[int]]

    def confirmed(self, grams: list[int]) -> set[int]:
        """The families of which a template or name is among the grams, by a share of CONFIRM."""
        found: dict[int, int] = {}
        for g in grams:
            for t in self.having.get(g, ()):
                found[t] = found.get(t, 0) + 1
        return {self.families[t] for t, n in found.items() if n >= CONFIRM * self.sizes[t]}


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]
    weights: np.ndarray
    threshold: float
    #: Words of all phrases; without one of them a sentence has no feature of a licence.
    words: frozenset[str]
    #: The number of each gram (word, or pair of words) of a phrase.
    index: dict = field(compare=False)
    templates: Templates = field(compare=False)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _profile(words: list[str], index: dict) -> tuple[list[int], int]:
    """The numbers of the grams that a phrase has, sorted, and the number of all different grams."""
    singles, pairs = set(words), set(zip(words, words[1:]))
    known = [index[g] for g in singles if g in index]
    known += [index[g] for g in pairs if g in index]
    known.sort()
    return known, len(singles) + len(pairs)


def _pack(profiles: list[tuple[list[int], int]], n: list[float]) -> tuple[np.ndarray, ...]:
    """Numbers of grams on end, grams known and grams in all of each profile, and its weight."""
    at = [x for known, _ in profiles for x in known]
    return np.array(at, "<i2"), np.array([len(known) for known, _ in profiles], "<i4"), np.array([size for _, size in profiles], "<i4"), np.array(n, "<f8")


def _probabilities(block: tuple[np.ndarray, ...], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each profile and family; and the row, number and value of each gram."""
    at, known, size, _ = block
    row, at = np.repeat(np.arange(len(known)), known), at.astype(np.int64)
    value = (1 / np.sqrt(np.maximum(size, 1)))[row]
    z = np.stack([np.bincount(row, weights[at, k] * value, len(known)) for k in range(weights.shape[1])], axis=1) + weights[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True), row, at, value


def _slope(block: tuple[np.ndarray, ...], truth: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The gradient of a block's log loss."""
    p, row, at, value = _probabilities(block, weights)
    p[np.arange(len(truth)), truth] -= 1
    p *= block[3][:, None]
    slope = np.empty_like(weights)
    for k in range(weights.shape[1]):
        slope[:-1, k] = np.bincount(at, p[row, k] * value, len(weights) - 1)
    slope[-1] = p.sum(axis=0)
    return slope


def _index() -> tuple[dict, Templates]:
    """Every gram of a phrase by its number, and the families' templates in these numbers."""
    phrases = [g.format(n) for ns in NAMES.values() for n in ns for g in (*GRANTS, *TALK)] + [t for ts in TEMPLATES.values() for t in ts]
    grams: set = set()
    for words in map(_words, dict.fromkeys(phrases)):
        grams.update(words, zip(words, words[1:]))
    index = {g: k for k, g in enumerate(sorted(grams, key=lambda g: (isinstance(g, tuple), g)))}
    templates = Templates([], [], {})
    for k, (f, names) in enumerate(NAMES.items()):
        for words in map(_words, (*names, *TEMPLATES.get(f, ()))):
            own = frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)
            for g in own:
                templates.having.setdefault(index[g], []).append(len(templates.sizes))
            templates.families.append(k)
            templates.sizes.append(len(own))
    return index, templates


def profiles(docs: DataFrame, text: str, vocabulary: frozenset[str], index: dict, templates: Templates) -> DataFrame:
    """``half, at, size, n``: the profiles of all sentences that match no family (what does not look like a licence is unknown).

    Sentences without a word of a phrase never reach the classifier, and are none of its classes.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[bytes, int], int] = {}

        def out() -> pd.DataFrame:
            rows = [(zlib.crc32(at, size) & 1, at, size, n) for (at, size), n in found.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["half", "at", "size", "n"])

        for f in batches:
            for t in f["t"]:
                for s in _SENTENCE.split(t):
                    words = _words(s)
                    if not words or vocabulary.isdisjoint(words):
                        continue
                    known, size = _profile(words, index)
                    if not templates.confirmed(known):
                        key = np.array(known, "<i2").tobytes(), size
                        found[key] = found.get(key, 0) + 1
                if len(found) > HELD:
                    yield out()
        if found:
            yield out()
        give_back()

    rows = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(count, "half int, at binary, size int, n long")
    return written(rows.groupBy("half", "at", "size").agg(F.sum("n").alias("n")))


def blocks(found: DataFrame) -> DataFrame:
    """The profiles as ``half, block`` and the arrays of ``_pack``, about BLOCK a row; the same for any order and layout of the rows."""
    parts = found.count() // BLOCK + 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(key: tuple, rows: list[tuple[bytes, int, int]]) -> pd.DataFrame:
            at, size, n = zip(*rows)
            known = np.array([len(x) // 2 for x in at], "<i4")
            return pd.DataFrame([(*key, b"".join(at), known.tobytes(), np.array(size, "<i4").tobytes(), np.array(n, "<f8").tobytes())], columns=["half", "block", "at", "known", "size", "n"])

        last, rows = None, []
        for f in batches:
            for half, block, at, size, n in zip(f["half"].tolist(), f["block"].tolist(), f["at"], f["size"].tolist(), f["n"].tolist()):
                if last != (half, block):
                    if rows:
                        yield out(last, rows)
                    last, rows = (half, block), []
                rows.append((bytes(at), size, n))
        if rows:
            yield out(last, rows)

    dealt = found.withColumn("block", F.pmod(F.xxhash64("at", "size"), F.lit(parts)).cast("int")).repartition(parts, "block")
    sorted_ = dealt.sortWithinPartitions("half", "block", "at", "size").select("half", "block", "at", "size", "n")
    return written(sorted_.mapInPandas(pack, "half int, block int, at binary, known binary, size binary, n binary"))


def _arrays(row) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes(row[c]), kind) for c, kind in (("at", "<i2"), ("known", "<i4"), ("size", "<i4"), ("n", "<f8")))


def fit(docs: DataFrame, text: str = "text") -> LicenceModel:
    """Fit on the phrases and on the sentences of all documents; one half of their profiles is held out for the threshold."""
    vocabulary = frozenset(w for phrases in (*NAMES.values(), *TEMPLATES.values(), GRANTS) for t in phrases for w in _words(t))
    index, templates = _index()
    packed = blocks(profiles(docs, text, vocabulary, index, templates))
    totals = {r["half"]: r["n"] for r in packed.select("half", F.length("size").alias("n")).groupBy("half").agg(F.sum("n").alias("n")).collect()}
    alone = sum(totals.values()) <= 4 * BLOCK  # so few profiles need no tasks
    here = sorted(packed.collect(), key=lambda r: (r["half"], r["block"])) if alone else []

    def each(half: int, task) -> list[bytes]:
        """What ``task`` makes of each block of the half, in the order of the blocks."""
        if alone:
            return [task(_arrays(r)).tobytes() for r in here if r["half"] == half]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                yield pd.DataFrame([(r["block"], task(_arrays(r)).tobytes()) for r in f.to_dict("records")], columns=["block", "x"])

        got = packed.where(F.col("half") == half).select("block", "at", "known", "size", "n").mapInPandas(run, "block int, x binary").collect()
        return [bytes(r["x"]) for r in sorted(got, key=lambda r: r["block"])]

    families = (*NAMES, UNKNOWN)
    names = [n for ns in NAMES.values() for n in ns]
    random = np.random.Generator(np.random.PCG64(11))
    examples: list[tuple[list[str], int]] = []
    for k, family in enumerate(NAMES):
        phrases = [g.format(n) for n in NAMES[family] for g in GRANTS]
        for phrase in [*phrases, *TEMPLATES.get(family, ())]:
            words = _words(phrase)
            examples.append((words, k))
            if len(words) > 5:
                examples += [([w for w in words if random.random() > 0.15], k) for _ in range(4)]
                cut = int(random.integers(len(words) // 2, len(words)))
                examples += [(words[:cut], k), (words[-cut:], k)]
            # A notice in a sentence of other words, as paragraphs have them.
            examples.append((["the", "text"] + words + ["by", "its", "authors"], k))
    talk = [_words(t.format(n)) for t in TALK for n in (names if "{}" in t else names[:1])]
    bag = sorted(vocabulary)
    talk += [[bag[i] for i in random.integers(0, len(bag), random.integers(2, 8))] for _ in range(200)]
    known = _pack([_profile(w, index) for w in [*(w for w, _ in examples), *talk[::2]]], [1.0] * (len(examples) + len(talk[::2])))
    truth = np.array([y for _, y in examples] + [len(NAMES)] * len(talk[::2]))
    sentences = [sum(np.frombuffer(x)[0] for x in each(half, lambda b: b[3].sum(keepdims=True))) for half in (0, 1)]
    share = [min(1.0, UNKNOWN_WEIGHT / max(n, 1)) for n in sentences]
    w = np.zeros((len(index) + 1, len(families)))
    scale = np.zeros_like(w)
    for _ in range(EPOCHS):
        slope = _slope(known, truth, w)
        for x in each(0, lambda b, w=w: _slope(b, np.full(len(b[3]), len(NAMES)), w)):
            slope += share[0] * np.frombuffer(x).reshape(w.shape)
        scale += slope**2
        w = w - 0.5 * slope / (np.sqrt(scale) + 1e-8)

    def passing(b: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probability of a licence and weight, where it could pass."""
        licence = 1 - _probabilities(b, w)[0][:, -1]
        return np.stack([licence, b[3]], axis=1)[licence >= 0.5]

    calm = _pack([_profile(x, index) for x in talk[1::2]], [1.0] * len(talk[1::2]))
    found = [passing(calm), *(np.frombuffer(x).reshape(-1, 2) * [1, share[1]] for x in each(1, passing))]
    high = np.concatenate(found)
    high = high[np.argsort(-high[:, 0], kind="stable")]
    too_many = high[np.cumsum(high[:, 1]) > FALSE_RATE * (len(calm[3]) + share[1] * sentences[1]), 0]
    threshold = float(np.nextafter(too_many[0], 2)) if len(too_many) else 0.5
    return LicenceModel(families, w, threshold, vocabulary, index, templates)


def find(text: str | None, model: LicenceModel) -> list[tuple[str, float, int, int]]:
    """Family, probability, and begin and end of each licence notice: neighbouring sentences of one family."""
    out: list[tuple[str, float, int, int]] = []
    at, last = 0, False
    for m in [*_SENTENCE.finditer(text or ""), None]:
        start, end = at, m.start() if m else len(text or "")
        at = m.end() if m else end
        words = _words(text[start:end]) if end > start else []
        if not words or model.words.isdisjoint(words):  # no feature of a licence: the unknown class
            last = False
            continue
        profile = _profile(words, model.index)
        confirmed = model.templates.confirmed(profile[0])
        if not confirmed:  # whatever family is the most probable
            last = False
            continue
        p = _probabilities(_pack([profile], [1.0]), model.weights)[0][0]
        k = int(p[:-1].argmax())
        family, licence = model.families[k], float(1 - p[-1])
        if licence < model.threshold or k not in confirmed:
            last = False
        elif last and out[-1][0] == family:
            out[-1] = (family, max(licence, out[-1][1]), out[-1][2], end)
        else:
            out.append((family, licence, start, end))
            last = True
    return out


def scanner(model: LicenceModel):
    @pandas_udf("array<struct<family:string,score:double,start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"family": f, "score": s, "start": a, "end": b} for f, s, a, b in find(t, model)] for t in batch])
        give_back()

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """``doc_id, families`` (sorted, distinct), ``n_notices`` and ``notices`` with spans."""
    found: Column = scanner(model or fit(docs, text))(text)
    rows = docs.select(F.col(key).alias("doc_id"), found.alias("notices"))
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.col("notices.family"))).alias("families"), F.size("notices").cast("long").alias("n_notices"), "notices")
