"""Chat formatting into budgeted windows.

A conversation's turns are rendered by a template and their tokens counted; prefix sums of the counts cut
the turns into windows that end at turn borders.  Every window repeats the leading system turn and the last
turns before it, as many as fit into the history budget; each assistant turn is a target in the one window
that it is new in, and masked where it is repeated.  A turn longer than the budget has a window of its own,
longer than the budget: turns are never cut.

The template marks a turn as ``<|role|>\\n`` text ``<|end|>\\n``.  Inside roles and texts each of the
characters backslash, ``<``, ``[`` and ``|`` is followed by a backslash, so no control string of this or
another template stays whole, and the change is reversible.

Rows are dealt out by conversation, sorted, and streamed: memory is bounded by one window, whatever the
length of a conversation.  (A digest over all turns of one conversation is sequential, so one task reads it.)

Defined results: null texts and roles are empty; turns with equal numbers are ordered by role and text;
repeated rows are turns of their own; null conversation ids are one conversation; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import tokens
from colloquy.llm.common import give_back

BUDGET, HISTORY = 1024, 256
WINDOWS = "conv_id long, window int, last boolean, n_repeated int, n_tokens long, text string, targets array<struct<start:long,end:long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PLAIN, _ESCAPED = re.compile(r"[\\<\[|]"), re.compile(r"([\\<\[|])\\", re.S)
_TURN = re.compile(r"<\|(?!\\)((?:[^|]|\|\\)*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the borders of its text in it."""
    head = f"<|{escape(role)}|>\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Windows of all conversations, those of one adjacent and in order."""
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = tokens.counter(path)
        conv, system, held, repeated, number = None, None, [], 0, 0
        out: list[tuple] = []

        def size(turns: list) -> int:
            return sum(t[4] for t in turns)

        def flush(last: bool) -> None:
            """Write the held turns, of which the first ``repeated`` are history."""
            nonlocal held, repeated, number
            parts, spans, at = [], [], 0
            head = [system] if system is not None else []
            for k, (who, rendered, start, end, _) in enumerate(head + held):
                if who == "assistant" and k >= len(head) + repeated:
                    spans.append({"start": at + start, "end": at + end})
                parts.append(rendered)
                at += len(rendered)
            again = repeated + (len(head) if number else 0)
            out.append((conv[0], number, last, again, size(head + held), "".join(parts), spans))
            ends = np.cumsum([t[4] for t in reversed(held)])  # suffix sums: the history that fits
            keep = int(np.searchsorted(ends, history, side="right"))
            held = held[len(held) - keep :] if keep else []
            repeated, number = len(held), number + 1

        for batch in batches:
            for c, who, t in zip(batch["c"], batch["r"], batch["t"]):
                key = (None if pd.isna(c) else int(c),)
                if key != conv:
                    if conv is not None:
                        flush(True)
                    conv, system, held, repeated, number = key, None, [], 0, 0
                    fresh = True
                else:
                    fresh = False
                rendered, start, end = render(who, t)
                item = (who, rendered, start, end, count(rendered))
                if fresh and who == "system":
                    system = item
                    continue
                fixed = system[4] if system is not None else 0
                if len(held) > repeated and fixed + size(held) + item[4] > budget:
                    flush(False)
                while repeated and fixed + size(held) + item[4] > budget:  # history gives way to the turn
                    held.pop(0)
                    repeated -= 1
                held.append(item)
            if out:
                yield _frame(out, WINDOWS)
                out = []
        if conv is not None:
            flush(True)
            yield _frame(out, WINDOWS)
        del count
        give_back()

    rows = conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    return rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t").mapInPandas(run, WINDOWS)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in re.sub("<.*?>", "", schema).split(", ")]).astype({"conv_id": "Int64"})


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a window: roles and texts."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns, each once, and all text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns, loss, n, n_loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            out = []
            for c, last, again, text, targets in zip(batch["conv_id"], batch["last"], batch["n_repeated"], batch["text"], batch["targets"]):
                for who, said in read_back(text)[again:]:
                    turns.update(f"{who}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in targets:
                    said = unescape(text[span["start"] : span["end"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    n_loss += len(said)
                chars += len(text)
                if last:
                    out.append((None if pd.isna(c) else int(c), n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
                    turns, loss, n, n_loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            if out:
                yield _frame(out, DIGEST)

    return formatted.mapInPandas(run, DIGEST)
