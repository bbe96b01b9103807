"""Column functions: logs, effects, means, text measures, deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plog(p: Column, m: Column) -> Column:
    """p * log2(p / m), 0 where p is 0."""
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def cohen_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def mean(x: Column | str) -> Column:
    """A group's mean, summed in order of size: groups of the same values have the same mean to the last bit, and tie."""
    return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda acc, v: acc + v, lambda acc: F.try_divide(acc, F.count(x)))


def words(text: Column) -> Column:
    """Number of words; empty and blank texts have none."""
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " +")))


def final_punctuation(text: Column) -> Column:
    return text.rlike("[.!?…][\"'»“”)\\]]*[ \\n]*$")


def tier(code: Column, depth: int) -> Column:
    """The first ``depth`` levels of a hyphen-separated code."""
    return F.concat_ws("-", F.slice(F.split(code, "-"), 1, depth))


def draw(n: Column | int, *parts: Column | str | int) -> Column:
    """A draw from 0..n-1 that depends on the parts only, equal on every engine with md5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long") % n


def hash_order(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def bucket(text: Column) -> Column:
    """Problem, Solution, Request or Other by the first matching word of a label's text; the order matters."""
    t = F.lower(text)
    return F.when(t.contains("problem"), "Problem").when(t.contains("recommendation") | t.contains("solution"), "Solution").when(t.contains("request"), "Request").otherwise("Other")


def macro_category(label: Column, prefixes: list[tuple[str, str]], other: str) -> Column:
    """Category of the first prefix, in the given order, that the label starts with."""
    out = F.lit(other)
    for prefix, name in reversed(prefixes):
        out = F.when(F.startswith(label, F.lit(prefix)), name).otherwise(out)
    return out


def role(author: Column, clients: list[str]) -> Column:
    """Client for the listed authors, whatever their case; everyone else, and no author, is Counsellor."""
    return F.when(F.lower(F.trim(author)).isin(clients), "Client").otherwise("Counsellor")


def speaker_origin(group: Column, speaker: Column) -> Column:
    """A model speaks only as the client of a conversation with a model."""
    return F.when((group != "human_human") & (speaker == "Client"), "llm").otherwise("human")


def role_prefixed(text: Column, speaker: Column) -> Column:
    return F.concat(speaker, F.lit(": "), text)


def first_sentence(text: Column, most: int) -> Column:
    """Up to the first final punctuation; longer ones are cut at ``most`` characters with an ellipsis."""
    s = F.trim(F.regexp_extract(text, "^([^.!?\n]*[.!?]?)", 1))
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def without_headers(text: Column, headers: list[str]) -> Column:
    """Lines that do not start with one of the headers."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.exists(F.array(*[F.lit(h) for h in headers]), lambda h: F.startswith(line, h)))
    return F.array_join(kept, "\n")


def unquoted(text: Column, name: str) -> Column:
    """A generated turn without the speaker's label and outer quotes."""
    bare = F.regexp_replace(F.trim(text), f"^{name}\\s*:\\s*", "")
    return F.regexp_replace(bare, '^["“„]|["”“]$', "")


def plain_key(text: Column) -> Column:
    """A key that does not tell case, accents spelled out, or punctuation."""
    t = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def timestamp_of(text: Column) -> Column:
    """A time stamp in any of the formats of the exports; null if none fits."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def pomp(answer: Column, most: int = 5) -> Column:
    """An answer 1..most, 1 the best, as percent of the scale; others are missing."""
    return F.when(answer.between(1, most), (most - answer) / (most - 1) * 100)
