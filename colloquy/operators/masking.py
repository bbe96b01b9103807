"""Masking and text surgery: tolerant spans, consistent masks, unique anchors, and a rule classifier."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def tolerant_span(text: Column, needle: Column) -> Column:
    """Where ``needle`` first lies in ``text`` if runs of blanks count as one: struct ``start, end``; null if nowhere.

    Blanks that a needle begins or ends with belong to the span, at most as many as the needle has there.
    """

    def pattern(n: str) -> str:
        bare = n.strip()
        lead, trail = (len(n) - len(n.lstrip()), len(n) - len(n.rstrip())) if bare else (len(n), 0)
        outer = [rf"\s{{1,{k}}}" if k else "" for k in (lead, trail)]
        return outer[0] + r"\s+".join(map(re.escape, n.split())) + outer[1]

    @pandas_udf("start int, end int")
    def locate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, needles in batches:
            out = []
            for t, n in zip(texts, needles):
                m = re.search(pattern(n), t or "") if n else None
                out.append((m.start(), m.end()) if m else (None, None))
            yield pd.DataFrame(out, columns=["start", "end"]).astype("Int32")

    found = locate(text, needle)
    return F.when(found["start"].isNotNull(), found)


def squeezed(text: Column) -> Column:
    """Unicode normal form C, no-break blanks as blanks, and runs of blanks as one."""

    @pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.trim(F.regexp_replace(normal(F.replace(text, F.lit(" "), F.lit(" "))), "[ \t\n\r]+", " "))


def masked_consistently(rows: DataFrame, seeds: DataFrame, by: str, mask: str, text: str = "text") -> DataFrame:
    """Every word of ``seeds`` (``by, name``) replaced in all texts of its conversation; adds ``n_masked``.

    Longer names first, whole words only.  The names of one conversation travel as an array, its texts as rows.
    """
    names = seeds.groupBy(by).agg(F.collect_set("name").alias("names"))

    @pandas_udf("text string, n int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_names in batches:
            out = []
            for t, ns in zip(texts, all_names):
                ns = [] if ns is None else sorted(ns, key=lambda x: (-len(x), x))
                out.append(re.subn(r"\b(?:" + "|".join(map(re.escape, ns)) + r")\b", mask, t) if t and ns else (t, 0))
            yield pd.DataFrame(out, columns=["text", "n"]).astype({"n": "int32"})

    joined = rows.join(names, by, "left")
    done = joined.withColumn("masked", run(F.col(text), F.col("names")))
    return done.withColumn(text, F.col("masked.text")).withColumn("n_masked", F.col("masked.n")).drop("masked", "names")


def spliced(text: Column, anchor: str, by: Column) -> Column:
    """``text`` with the anchor replaced; an anchor that does not occur exactly once ends the query with an error."""
    times = F.size(F.split(text, re.escape(anchor), -1)) - 1
    wrong = F.raise_error(F.concat(F.lit(f"anchor {anchor} occurs "), times.cast("string"), F.lit(" times")))
    return F.when(times == 1, F.replace(text, F.lit(anchor), by)).otherwise(wrong)


def classified(rows: DataFrame, text: str, rules: dict[str, list[str]], masked: dict[str, Column], other: float) -> DataFrame:
    """Adds ``label``, its probability ``p``, and all ``probabilities``, from counts of the rules' words as logits.

    A label is impossible where its condition in ``masked`` holds; ties go to the first name.  It has the columns
    of a neural classifier, for which it is the default where none is plugged in.
    """
    t = F.col(text)
    count = lambda w: (F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)
    weights = {}
    for name, words in rules.items():
        weight = F.exp(sum((count(w) for w in words), F.lit(0.0)).cast("int").cast("double"))
        weights[name] = F.when(masked[name], 0.0).otherwise(weight) if name in masked else weight
    weights["other"] = F.exp(F.lit(other))
    total = sum(weights.values(), F.lit(0.0))
    probabilities = F.array(*[F.struct((w / total).alias("p"), F.lit(name).alias("label")) for name, w in sorted(weights.items())])
    out = rows.withColumn("probabilities", probabilities)
    best = F.array_max(F.transform("probabilities", lambda x: x["p"]))
    first = F.filter("probabilities", lambda x: x["p"] == F.col("p"))[0]["label"]
    return out.withColumn("p", best).withColumn("label", first)
