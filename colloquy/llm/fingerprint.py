"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines; blank ones do not count).  Every paragraph is hashed to a
wide vector, and the fingerprint is the sum of the vectors: EXACT lanes of 64 bits, summed modulo 2**64,
from a cryptographic hash of the paragraph, and LIKE lanes of 32 bits, summed modulo 2**32, in which each
adjacent word pair of the paragraph adds plus or minus one by hash.  So fingerprints do not depend on the
order of the paragraphs, and paragraphs are inserted and deleted by adding and subtracting
(:func:`combine`).  Equal multisets have equal fingerprints; the EXACT lanes decide equality, the LIKE
lanes estimate the Dice likeness of two texts' word pairs (standard error about 0.09).

Defined results: null is the empty text, whose fingerprint is the zero vector; two empty texts are alike by
1, an empty and a full one by 0; equal ids are ordered by a hash of the text; null ids come first.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

EXACT, LIKE = 8, 128
MEMO = 200_000
_signs: np.ndarray | None = None
_memo: dict[str, int] = {}


def _sign_table() -> np.ndarray:
    global _signs
    if _signs is None:
        _signs = (np.random.Generator(np.random.PCG64(7)).integers(0, 2, (1 << 16, LIKE), np.int8) * 2 - 1).astype(np.int8)
    return _signs


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The EXACT and LIKE lanes of a text: the sum over its paragraphs."""
    exact, ids = np.zeros(EXACT, np.uint64), [0]
    if len(_memo) > MEMO:
        _memo.clear()
    for paragraph in (text or "").split("\n"):
        words = paragraph.split()
        if not words:
            continue
        exact += np.frombuffer(hashlib.blake2b(paragraph.encode("utf-8", "surrogatepass"), digest_size=8 * EXACT).digest(), "<u8")
        for w in words:
            k = _memo.get(w)
            if k is None:
                k = _memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) | 1
            ids.append(k)
        ids.append(0)
    like = np.zeros(LIKE, np.uint32)
    if len(ids) > 1:
        code = np.array(ids, np.uint64)
        pairs = ((code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64)
        for start in range(0, len(pairs), 1 << 15):
            at, n = np.unique(pairs[start : start + (1 << 15)], return_counts=True)
            like += (n.astype(np.float32) @ _sign_table()[at].astype(np.float32)).astype(np.int64).astype(np.uint32)
    return exact, like


def encode(lanes: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(lanes[0].astype("<u8").tobytes() + lanes[1].astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<u4")


def combine(fingerprint: str, inserted: str | None = None, deleted: str | None = None) -> str:
    """The fingerprint after inserting and deleting paragraphs, without the document."""
    exact, like = (x.copy() for x in decode(fingerprint))
    for text, sign in ((inserted, 1), (deleted, -1)):
        e, v = vector(text)
        exact, like = (exact + e, like + v) if sign > 0 else (exact - e, like - v)
    return encode((exact, like))


def lanes_likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    norm = (x @ x + y @ y) / 2
    return float(min(1.0, max(0.0, x @ y / norm))) if norm else 0.0


def likeness(a: str, b: str) -> float:
    """Estimated likeness of two texts from their fingerprints alone, 0 to 1."""
    return 1.0 if a == b else lanes_likeness(decode(a), decode(b))


def fingerprint(text: Column | str) -> Column:
    """The fingerprint column of a text column."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: encode(vector(t)))

    return run(text)


def whole(k: str) -> list[Column]:
    """An id without nulls, and whether it was null: pandas turns integers beside nulls into doubles, which round ids above 2**53."""
    return [F.coalesce(k, F.lit(0)).alias("k"), F.col(k).isNull().alias("unset")]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """Rows ``bucket, own, k, tie, t`` dealt out by ranges of the key, sorted, each range in a partition of its own and followed by the next one's first row.

    Only the range borders (one number a shuffle partition) come to the driver.  The first row of a range is
    sent to its own and to the preceding range, that of the first range to the last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).cast("long").alias("k"))
    borders = sorted(set(ids.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []

    @pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.where(k.isna(), 0, np.searchsorted(np.array(borders), k.fillna(0).to_numpy(np.float64), side="right")).astype(np.int32))

    first = {r[0]: r[1] for r in ids.groupBy(bucket("k").alias("b")).agg(F.min(F.struct(F.col("k").isNotNull().alias("set"), "k")).getField("k").alias("k")).collect()}
    filled = sorted(first)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}

    @pandas_udf("array<int>")
    def buckets(k: pd.Series, unset: pd.Series) -> pd.Series:
        out = []
        for b, v, null in zip(np.where(unset, 0, np.searchsorted(np.array(borders), k.to_numpy(np.float64), side="right")), k, unset):
            same = null if first[b] is None else not null and v == first[b]
            out.append([int(b), int(before[b])] if same else [int(b)])
        return pd.Series(out)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.select("k", "t", F.xxhash64("t").alias("tie"), F.posexplode(buckets(*whole("k"))).alias("foreign", "bucket"))
    return rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "foreign", "k", "tie")


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, and the text whose second half is replaced by the beginning of the next document."""

    def one(k, t: str, after: str) -> tuple:
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        own, changed = vector(t), vector(edited)
        return k, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, encode(own), encode(changed), lanes_likeness(own, changed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = held = None
        for batch in batches:
            out = []

            def close(after: str) -> tuple:
                k, n, sha, own, f, g, near = one(*held, after)
                return k, n, sha, f, g, near, lanes_likeness(own, vector(after))

            for b, foreign, k, unset, t in zip(batch["bucket"], batch["foreign"], batch["k"], batch["unset"], batch["t"]):
                if b != at:
                    at, held = b, None
                if held is not None:
                    out.append(close(t))
                held = None if foreign else (None if unset else int(k), t)
            if not out:
                continue
            ids, *rest = zip(*out)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64")} | dict(zip(["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], rest)))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).select("bucket", "foreign", *whole("k"), "t").mapInPandas(run, schema)
