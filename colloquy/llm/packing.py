"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents are cut into pieces no longer than the capacity (the first piece takes the odd length), and the
pieces are range-sorted by length, longest first.  Packing is bulk-synchronous: a round takes all pieces of
one length and all open gaps, both sorted; a sweep gives the pieces to the smallest gaps that hold them (the
successors), a piece's rank among its equals decides which of several gaps of one size it gets, and whose
gaps are gone go to the next larger size or to new sequences; then gaps are updated and the next shorter
length follows.  This is best-fit decreasing.

Lengths and gaps are whole numbers up to the capacity, so a round works on runs of equal pieces and runs of
equal gaps.  The state of the sweep is bounded by the capacity, whatever the number of documents; what grows
with the documents (tokenising, sorting, ranking, placing) is distributed.

Defined results: null is the empty text; every document ends with the separator id, so an empty one has one
token; repeated rows and equal ids are packed as documents of their own; an empty table packs to nothing.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import tokens
from colloquy.llm.common import give_back, written

CAPACITY, SEPARATOR = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every document's ids (with the separator behind) into pieces of at most ``capacity``."""
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(path)
        for batch in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for k, t in zip(batch["k"], batch["t"]):
                ids = np.append(encode(t or ""), np.uint32(SEPARATOR)).astype("<u4")
                first = len(ids) % capacity or capacity
                for n, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + (first if n == 0 else capacity)]
                    for col, x in zip(cols, (None if pd.isna(k) else int(k), n, start, len(part), zlib.crc32(part.tobytes()))):
                        col.append(x)
            yield pd.DataFrame({"doc_id": pd.array(cols[0], "Int64"), "piece": np.array(cols[1], np.int32), "start": cols[2], "length": cols[3], "ids_crc32": cols[4]})
        del encode
        give_back()

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rounds of best-fit over runs: rows ``length, first rank, first sequence, offset``, sorted by length and rank."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                sizes.append(gap)
            gaps[gap].append((first, count))

    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        heap = [g for g in set(sizes) if g >= length and gaps.get(g)]
        heapq.heapify(heap)
        while left:
            while heap and not gaps.get(heap[0]):
                heapq.heappop(heap)
            if heap:
                gap = heap[0]
                first, count = gaps[gap].pop()
            else:
                gap, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = gap // length
            full = min(count, left // each)
            for layer in range(each if full else 0):
                out.append((length, rank, first, capacity - gap + layer * length))
                rank += full
            left -= full * each
            put(gap - each * length, first, full)
            first, count = first + full, count - full
            if count and left:  # fewer than fill a gap are left
                for layer in range(left):
                    out.append((length, rank, first, capacity - gap + layer * length))
                    rank += 1
                put(gap - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            put(gap, first, count)
        sizes = [g for g in gaps if gaps[g]]
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (columns PIECES) into sequences; adds ``sequence_id`` and ``offset``."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Number equal lengths of the sorted partition."""
        seen: dict[int, int] = {}
        for batch in batches:
            nth = batch.groupby("length").cumcount() + batch["length"].map(lambda x: seen.get(x, 0))
            for length, n in batch["length"].value_counts().items():
                seen[length] = seen.get(length, 0) + int(n)
            yield batch.assign(nth=nth.astype("int64"))

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.select(*[x.split()[0] for x in PIECES.split(", ")])
    ranged = cut.repartitionByRange(parts, F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).mapInPandas(number, f"{PIECES}, part int, nth long"))
    # One row a partition and length in it: as the input is sorted, at most partitions + capacity rows.
    counts = sorted(ranged.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    total: dict[int, int] = {}
    before = np.zeros(len(counts), np.int64)
    for k, (length, _, n) in enumerate(counts):
        before[k] = total.get(length, 0)
        total[length] = total.get(length, 0) + n
    groups = np.array([length << 32 | part for length, part, _ in counts], np.int64)
    rounds = plan(total, capacity)
    starts = rounds[:, 0] << 44 | rounds[:, 1] if len(rounds) else np.zeros(0, np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["nth"].to_numpy() + before[np.searchsorted(groups, length << 32 | batch["part"].to_numpy(np.int64))]
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            yield batch.drop(columns=["part", "nth"]).assign(sequence_id=rounds[at, 2] + rank - rounds[at, 1], offset=rounds[at, 3])

    return ranged.mapInPandas(place, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(written(pieces(docs, capacity, tokenizer, key, text)), capacity)
