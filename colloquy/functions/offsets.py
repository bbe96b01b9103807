"""Spans of text by code-point offsets: segments, anchoring, replacement and remapping, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
BLANK = " \t\r\n"
SENTENCE = "[^.!?\\n]+[.!?]?"


def anchor(text: Column, segments: Column) -> Column:
    """Offsets of consecutive segments: each is looked for from the end of the one before; what is not found is left out."""

    def step(acc: Column, s: Column) -> Column:
        at = F.position(s, text, acc["at"] + 1)
        end = (at - 1 + F.length(s)).cast("int")
        here = F.struct((at - 1).cast("int").alias("start"), end.alias("end"), s.alias("text"))
        return F.struct(F.when(at > 0, end).otherwise(acc["at"]).alias("at"), F.when(at > 0, F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(segments, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def matches(text: Column, pattern: str) -> Column:
    """Spans of all matches of a pattern whose matches cannot start earlier than the expression finds them."""
    return anchor(text, F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def trimmed(spans: Column) -> Column:
    """Spans without outer blanks; blank ones are dropped."""
    blank = F.lit(BLANK)

    def cut(s: Column) -> Column:
        t = F.trim(s["text"], blank)
        start = s["start"] + F.length(s["text"]) - F.length(F.ltrim(s["text"], blank))
        return F.struct(start.alias("start"), (start + F.length(t)).alias("end"), t.alias("text"))

    return F.filter(F.transform(spans, cut), lambda s: s["end"] > s["start"])


def sentences(text: Column) -> Column:
    """Sentences with trimmed offsets, by final punctuation and line ends."""
    return trimmed(matches(text, SENTENCE))


def visible(text: Column) -> Column:
    """Number of characters that are not blank."""
    return F.length(F.translate(text, BLANK, ""))


def replaced(text: Column, spans: Column, by: Column | str) -> Column:
    """``text`` with ordered, disjoint spans replaced."""
    new = by if isinstance(by, Column) else F.lit(by)
    last = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(0)

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(spans[F.greatest(i - 1, F.lit(0))]["end"])
        return F.concat(F.substring(text, before + 1, s["start"] - before), new)

    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))


def remapped(at: Column, spans: Column, width: int, is_end: bool) -> Column:
    """Where a position lies after ``replaced``; inside a span it goes to the start, or the end, of what replaced it."""
    shift = F.aggregate(F.filter(spans, lambda s: s["end"] <= at), F.lit(0), lambda acc, s: acc + width - (s["end"] - s["start"]))
    inside = F.filter(spans, lambda s: (s["start"] < at) & (at < s["end"]))
    return shift + F.when(F.size(inside) > 0, F.try_element_at(inside, F.lit(1))["start"] + (width if is_end else 0)).otherwise(at)
