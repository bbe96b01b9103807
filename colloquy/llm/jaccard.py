"""Exact n-gram Jaccard join with components, by set relations and skipping index lists.

Sets are the distinct word shingles of a text, hashed to 64 bits.  Texts with the same set are one *node*:
a node's answers are computed once and hold for all its copies.  The steps, none of which drops a pair:

1. One pass over the texts gives every document its node, and every node its size, its smallest document
   and a parity bitmap.  It also counts the shingles that can come near an index prefix; the counts, in a
   table of fixed size by hash, give every shingle a level, so that frequent ones come last in the order
   used below.  (Any order common to all sets is exact; shingles whose cells collide share a level.)
2. A second pass indexes each node's prefix in that order (sets that reach the threshold share a prefix
   shingle).  Rare shingles travel as packed blocks, and the lists of a block are built by a numeric sort; a
   list with one node is dropped there.  Frequent ones travel as rows.
3. Each list is joined between neighbours, by size and in a few hashed orders.  A candidate must pass the bounds
   of sizes and positions and the bitmap bound (the parity bitmaps' Hamming distance is at most the symmetric
   difference), and is then verified on the whole sets.  Links make components.  Pairs inside a component need
   no answer of their own, so lists whose nodes are all of one component are left out from here on.
4. Short lists (SMALL nodes) give their pairs of different components, which are verified likewise.
5. Long lists are cut into blocks.  Lists with the same hub (the node with most links) hold mostly the same
   nodes and are merged, so that a pair is seen once and not once a list.  A block is a range of sizes; a pair of
   blocks is skipped as a whole if its sizes, or the positions that its nodes have in their lists, rule out
   every pair.  Inside a pair of blocks one set is the pivot: the answers of all others are computed against it,
   and those of two others are derived from these.  Two sets whose differences from the pivot are together
   small link; if they differ much in size they do not; else the symmetric difference of the two differences,
   which are far smaller than the sets, decides.  Only links that join two components are returned, at most as
   many as a block pair has sets, so that nothing grows with the square of a list.

Defined results: null, empty and blank texts have no shingle, n_shingles 0, and are their own component;
texts of fewer words than a shingle have one; ties and repeated rows link as equal sets do; null ids form
rows with their own id null and link like others; an empty table gives none.  Long texts are shingled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import give_back, written

SHINGLE, PERCENT = 5, 75
#: Cells of the level table, as a power of two; it is what is broadcast, two cells a byte.
CELLS = 25
#: A shingle is frequent, and comes later in the order, from so many sets on.
FREQUENT = 24
#: Bits of the smallest parity bitmap; larger sets have as many bits as shingles, rounded up to a power of two.
BITMAP = 512
SEEN = 1 << 25
#: Bytes of a text that are worked on at once.
SLICE = 1 << 20
#: Hashed orders in which neighbours of an index list are compared in the first round.
ORDERS = 3
#: Nodes of a list from which on it is compared by blocks, and of a list's share in a round of neighbours.
SMALL, LONG = 16, 4096
#: Sets and shingles of a block, about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 200_000
#: Bands of sizes a doubling, by which blocks are cut.
BANDS = 8
#: Index entries that one task sorts, about.
ENTRIES = 2_000_000
#: Edges that one task contracts.
EDGES = 250_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _words(data: bytes) -> np.ndarray:
    """The hashes of a text's words, slice by slice; a word that a slice cuts goes on in the next."""
    values, sizes, cut = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], False
    for at in range(0, len(data), SLICE):
        raw = np.frombuffer(data, np.uint8, min(SLICE, len(data) - at), at)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power_tables(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        value, size = (total[end] - total[start]) * inverse[start], (end - start).astype(np.uint64)
        if cut and not blank[0]:
            values[-1][-1:] += value[:1] * np.uint64(pow(int(_BASE), int(sizes[-1][-1]), 1 << 64))
            sizes[-1][-1:] += size[:1]
            value, size = value[1:], size[1:]
        cut = not blank[-1]
        if len(value):
            values.append(value)
            sizes.append(size)
    return _mix(np.concatenate(values) + np.concatenate(sizes))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word ``n``-grams; A-Z are lower-cased, words end at blanks."""
    if not text:
        return np.zeros(0, np.uint64)
    words = _words(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        grams = _mix(grams * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i])
    return np.unique(_mix(grams + np.uint64(k)))


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(grams: np.ndarray) -> bytes:
    width = max(BITMAP, 1 << int(len(grams) - 1).bit_length())
    places = (grams >> np.uint64(20)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity bitmaps; the wider one is folded, as places are hashes modulo the width."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _folded(x: bytes) -> tuple[int, ...]:
    """A parity bitmap folded to 256 bits, as four longs that SQL can compare."""
    a = np.frombuffer(x, np.uint64)
    while len(a) > 4:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return tuple(a.view(np.int64).tolist())


def _prefix(size: int, percent: int) -> int:
    return size - (-(-percent * size // 100)) + 1


def _cells(grams: np.ndarray) -> np.ndarray:
    return (_mix(grams) >> np.uint64(64 - CELLS)).astype(np.int64)


def _survey(docs: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """Rows of two kinds: documents with their nodes, and parts of the level table."""
    ranges = 1 << max(0, int(parts - 1).bit_length())
    width = (1 << CELLS) // ranges
    columns = ["bucket", "no_k", "k", "node", "size", "s0", "s1", "s2", "s3", "bitmap", "counts"]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, pending, known = [], [], {}
            for k, t in zip(batch["k"], batch["t"]):
                got = known.get(t)
                if got is None:
                    grams = shingles(t, shingle)
                    got = known[t] = (node_of(grams), len(grams), *_folded(bits := _parity(grams)), bits) if len(grams) else (0, 0, 0, 0, 0, 0, None)
                    # In hash order, a prefix and a quarter of it more.
                    pending.append(grams[: _prefix(len(grams), percent) * 5 // 4])
                out.append((len(out) % ranges, k is None, 0 if k is None else int(k), *got, None))
            # No nulls among the numbers: pandas would turn them to doubles.
            yield pd.DataFrame(out, columns=columns)
            grams = np.concatenate(pending)
            if len(grams):
                mixed = np.sort(_mix(grams))
                cuts = np.searchsorted((mixed >> np.uint64(64 - CELLS)).astype(np.int64), np.arange(ranges + 1) * width)
                low = mixed.view(np.uint8).reshape(-1, 8)[:, 3:]  # the upper five of eight bytes
                rows = [(b, True, 0, 0, 0, 0, 0, 0, 0, None, low[cuts[b] : cuts[b + 1]].tobytes()) for b in range(ranges) if cuts[b] < cuts[b + 1]]
                yield pd.DataFrame(rows, columns=columns)
        give_back()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            plain = batch["counts"].isna()
            if plain.any():
                yield batch[plain]
            for b, raw in zip(batch.loc[~plain, "bucket"], batch.loc[~plain, "counts"]):
                held.setdefault(b, []).append(raw)
        for b, raws in held.items():
            padded = np.zeros((sum(map(len, raws)) // 5, 8), np.uint8)
            padded[:, 3:] = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, 5)
            value, n = np.unique(padded.view(np.uint64).ravel(), return_counts=True)
            often = n > FREQUENT
            level = np.zeros(width, np.uint8)
            at = (value[often] >> np.uint64(64 - CELLS)).astype(np.int64) - b * width
            np.maximum.at(level, at, np.minimum(15, np.log2(n[often] / FREQUENT).astype(np.uint8) + 1))
            packed = ((level[0::2] << 4) | level[1::2]).tobytes()
            yield pd.DataFrame([(b, True, 0, 0, 0, 0, 0, 0, 0, None, packed)], columns=columns)

    form = "bucket int, no_k boolean, k long, node long, size long, s0 long, s1 long, s2 long, s3 long, bitmap binary, counts binary"
    rows = docs.select(F.col("k").cast("string").alias("k"), "t")
    return written(rows.mapInPandas(emit, form).repartition(parts, "bucket").mapInPandas(count, form))


def _levels(survey: DataFrame) -> np.ndarray:
    """The level table, two cells a byte: 2 ** (CELLS - 1) bytes in all, whatever the input."""
    packed = np.zeros(1 << (CELLS - 1), np.uint8)
    for b, raw in survey.where("counts is not null").select("bucket", "counts").toLocalIterator():
        packed[b * len(raw) : (b + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
    return packed


def _ordered(grams: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the global order, frequent ones last, and their levels."""
    at = _cells(grams)
    both = packed[at >> 1]
    level = np.where(at & 1, both & 15, both >> 4)
    order = np.lexsort((grams, level))
    return grams[order], level[order]


def _index(docs: DataFrame, packed: np.ndarray, shingle: int, percent: int, parts: int) -> DataFrame:
    """Rows ``token, node, size, pos`` of all index lists with two nodes or more (frequent shingles: one or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # 2 ** CELLS / 2 bytes

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, nodes, sizes, counts, tokens, rare = set(), [], [], [], [], []
            for t in dict.fromkeys(batch["t"]):
                grams = shingles(t, shingle)
                if not len(grams) or (node := node_of(grams)) in seen:
                    continue
                seen.add(node)
                s = len(grams)
                p = _prefix(s, percent)
                ordered, level = _ordered(grams, shared.value)
                nodes.append(node)
                sizes.append(s)
                counts.append(p)
                tokens.append(ordered[:p])
                rare.append(level[:p] == 0)
            if not nodes:
                continue
            token, is_rare = np.concatenate(tokens), np.concatenate(rare)
            owner = np.repeat(np.arange(len(nodes)), counts)
            pos = np.concatenate([np.arange(c) for c in counts]).astype(np.int32)
            node, size = np.array(nodes, np.int64), np.array(sizes, np.int32)
            bucket = ((token >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
            often = ~is_rare
            if often.any():
                yield pd.DataFrame({"bucket": bucket[often], "block": None, "token": token[often].view(np.int64), "node": node[owner[often]], "size": size[owner[often]], "pos": pos[often]})
            order = np.argsort(bucket, kind="stable")
            order = order[is_rare[order]]
            cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
            blocks, of = [], []
            for b in range(parts):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    blocks.append(np.array([len(at)], "<i8").tobytes() + token[at].tobytes() + node[owner[at]].tobytes() + size[owner[at]].tobytes() + pos[at].tobytes())
                    of.append(b)
            zero = np.zeros(len(of), np.int64)
            if of:
                yield pd.DataFrame({"bucket": np.array(of, np.int32), "block": blocks, "token": zero, "node": zero, "size": zero.astype(np.int32), "pos": zero.astype(np.int32)})

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        for batch in batches:
            plain = batch["block"].isna()
            if plain.any():
                yield batch.loc[plain, ["token", "node", "size", "pos"]]
            held += batch.loc[~plain, "block"].tolist()
        if not held:
            return
        cols: list[list] = [[], [], [], []]
        for raw in held:
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            at = 8
            for col, kind, width in zip(cols, ("<i8", "<i8", "<i4", "<i4"), (8, 8, 4, 4)):
                col.append(np.frombuffer(raw, kind, n, at))
                at += n * width
        del held
        token, node, size, pos = (np.concatenate(c) for c in cols)
        order = np.lexsort((node, token))
        token, node, size, pos = token[order], node[order], size[order], pos[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # copies of a set are one node
        token, node, size, pos = token[new], node[new], size[new], pos[new]
        # An entry stays if some other of its list passes the size and position bounds with it.
        keep = np.zeros(len(token), bool)
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        for ahead in range(1, len(token)):
            at = np.flatnonzero(token[ahead:] == token[:-ahead])
            if not len(at):
                break
            a, b = size[at], size[at + ahead]
            fits = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * np.minimum(a - pos[at], b - pos[at + ahead]) >= percent * (a + b))
            keep[at[fits]] = keep[at[fits] + ahead] = True
        at = np.flatnonzero(keep)
        size, pos = size.astype(np.int32), pos.astype(np.int32)
        for start in range(0, len(at), 1 << 18):
            k = at[start : start + (1 << 18)]
            yield pd.DataFrame({"token": token[k], "node": node[k], "size": size[k], "pos": pos[k]})
        del token, node, size, pos, order, keep
        give_back()

    rows = docs.select("t").where("t is not null").mapInPandas(emit, "bucket int, block binary, token long, node long, size int, pos int")
    return written(rows.repartition(parts, "bucket").mapInPandas(lists, "token long, node long, size int, pos int"))


def _fits(percent: int) -> str:
    """Size and position bounds of a pair whose first common shingle this is, in SQL over a_, b_ columns."""
    return f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size) and {100 + percent} * least(a_size - a_pos, b_size - b_pos) >= {percent} * (a_size + b_size)"


def _could_reach(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the bitmap bound leaves: symmetric difference >= Hamming distance of the parities."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if not len(f):
                continue
            apart = np.array([_apart(x, y) for x, y in zip(f["a_bitmap"], f["b_bitmap"])], np.int64)
            both = (f["a_size"] + f["b_size"]).to_numpy()
            yield f.loc[(100 + percent) * (both - apart) >= 2 * percent * both, ["a", "b"]]

    of = lambda side: nodes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("bitmap").alias(f"{side}_bitmap"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return joined.select("a", "b", "a_size", "b_size", "a_bitmap", "b_bitmap").mapInPandas(check, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, grams`` of the wanted nodes (and of some more), shingled again from the nodes' smallest documents."""
    needed = nodes.select("node", "rep").join(wanted, "node", "left_semi")

    def flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(SEEN, bool)
        for f in batches:
            found[_slot(f["rep"].to_numpy(np.int64))] = True
        if found.any():
            yield pd.DataFrame({"part": [0], "bits": [np.packbits(found).tobytes()]})

    # A filter of fixed size (SEEN bits) over the wanted documents; what else it lets through meets no pair.
    bits = np.zeros(SEEN // 8, np.uint8)
    for _, raw in needed.select("rep").where("rep is not null").coalesce(8).mapInPandas(flags, "part int, bits binary").toLocalIterator():
        bits |= np.frombuffer(raw, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            slot = _slot(f["k"].to_numpy(np.int64))
            # A node without any id has no smallest document, so texts without an id all pass.
            f = f[f["no_k"].to_numpy(bool) | ((shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)]
            grams = [g for g in (shingles(t, shingle) for t in dict.fromkeys(f["t"])) if len(g)]
            if grams:
                yield pd.DataFrame({"node": np.array([node_of(g) for g in grams], np.int64), "grams": [g.tobytes() for g in grams]})
        give_back()

    rows = docs.where("t is not null").select(F.coalesce("k", F.lit(0)).alias("k"), F.col("k").isNull().alias("no_k"), "t")
    return rows.mapInPandas(sets, "node long, grams binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by the whole sets of both."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keep = np.zeros(len(f), bool)
            for k, (x, y) in enumerate(zip(f["a_grams"], f["b_grams"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = _common(x, y)
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield f.loc[keep, ["a", "b"]]

    of = lambda side: sets.select(F.col("node").alias(side), F.col("grams").alias(f"{side}_grams"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_grams", "b_grams").mapInPandas(check, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _slot(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) % np.uint64(SEEN)).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``a, b`` edges; the root is the smallest node of its component.

    Rounds of partition-local union-find, dealt out by the smaller and then by the larger end, until no edge
    changes.  A task holds about EDGES edges: a root with more is dealt over several tasks, which any contraction
    allows; what fits into one task is contracted there at once.  The edges are read twice (counted, contracted),
    so they should be a written table; repeated edges do no harm.
    """

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for f in batches:
            for x, y in zip(f["a"].tolist(), f["b"].tolist()):
                x, y = find(x), find(y)
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        out = [(x, find(x)) for x in parent]
        out = [(x, r) for x, r in out if x != r]
        for start in range(0, len(out), 100_000):
            yield pd.DataFrame(out[start : start + 100_000], columns=["a", "b"])

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        parts = -(-edges.count() // EDGES)
        if parts <= 1:  # one task's share: contracted at once
            edges = written(edges.coalesce(1).mapInPandas(contract, "a long, b long"))
            break
        heavy = edges.groupBy("b").count().where(f"count > {EDGES}").select("b", F.ceil(F.col("count") / EDGES).alias("shares"))
        dealt = edges.join(heavy, "b", "left").withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("a"), "shares")).otherwise(F.lit(0)))
        by_low = dealt.repartition(parts, "b", "share").select("a", "b").mapInPandas(contract, "a long, b long")
        edges = written(by_low.distinct().repartition(parts, "a").mapInPandas(contract, "a long, b long").distinct())
        # Done when every node has one parent, and parents have none.
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        deep = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
        if not twice.union(deep).head(1):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()


#: A pair's columns, from structs a and b; and its nodes, the smaller first.
_FLAT = [f"{s}.{c} as {s}_{c}" if c != "node" else f"{s}.node as {s}" for s in "ab" for c in ("node", "size", "pos")]
_SORTED = ["least(a, b) as a", "greatest(a, b) as b"]


def _neighbours(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of neighbours in the index lists, by size and in ORDERS hashed orders, that pass the bounds.

    A list longer than LONG is dealt into shares, by size or by hash, as neighbours need no whole list.
    """
    long = lists.groupBy("token").agg(F.count("*").alias("n")).where(f"n > {LONG}").select("token", F.ceil(F.col("n") / LONG).alias("shares"))
    rows = lists.select("token", F.struct("node", "size", "pos").alias("x")).join(long, "token", "left")
    hashed = [F.xxhash64("x.node", F.lit(k)) for k in range(ORDERS)]
    orders = [(F.floor(F.log2("x.size") * BANDS), ("x.size", "x.node")), *((h, (h, "x.node")) for h in hashed)]
    share = lambda by: F.when(F.col("shares").isNotNull(), F.pmod(by, "shares"))
    ahead = [F.lead("x").over(Window.partitionBy("token", share(by)).orderBy(*order)).alias(f"b{k}") for k, (by, order) in enumerate(orders)]
    near = rows.select(F.col("x").alias("a"), *ahead)
    near = near.select("a", F.explode(F.array_distinct(F.array(*near.columns[1:]))).alias("b")).where("b is not null")
    return near.selectExpr(*_FLAT).where(_fits(percent)).selectExpr(*_SORTED).distinct()


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Index entries ``token, x, c, n`` of lists with several components: entry, its component, the list's length."""
    labelled = lists.select("token", F.struct("node", "size", "pos").alias("x")).join(roots.withColumnRenamed("node", "n"), F.col("x.node") == F.col("n"), "left")
    labelled = labelled.select("token", "x", F.coalesce("root", "x.node").alias("c"))
    spread = labelled.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high").select("token", "n")
    return written(labelled.join(spread, "token"))


def _short(entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components in short lists that pass the bounds of size, position and folded bitmaps."""
    bits = [f"s{k}" for k in range(4)]
    signed = entries.join(nodes.select(F.col("node").alias("m"), F.struct(*bits).alias("s")), F.col("x.node") == F.col("m"))
    left = signed.select("token", F.col("x").alias("a"), F.col("c").alias("a_c"), F.col("s").alias("a_s"))
    right = signed.select(F.col("token").alias("t"), F.col("x").alias("b"), F.col("c").alias("b_c"), F.col("s").alias("b_s"))
    apart = " + ".join(f"bit_count(a_s.{c} ^ b_s.{c})" for c in bits)
    fits = _fits(percent)
    for s in "ab":
        for c in ("size", "pos"):
            fits = fits.replace(f"{s}_{c}", f"{s}.{c}")
    fits += f" and {100 + percent} * (a.size + b.size - ({apart})) >= {2 * percent} * (a.size + b.size)"
    return left.join(right, F.expr(f"token = t and a_c <> b_c and a.node < b.node and {fits}")).selectExpr("a.node as a", "b.node as b").distinct()


def _merged(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Long lists as groups ``key, node, size, pos, c``: lists of one hub are one group, if that makes fewer pairs."""
    degree = _ends(links).groupBy("node").agg(F.count("*").alias("degree")).withColumnRenamed("node", "m")
    ranked = entries.join(degree, F.col("x.node") == F.col("m"), "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    hubs = ranked.groupBy("token").agg(F.max(F.struct("degree", F.col("x.node").alias("node"))).getField("node").alias("hub"))
    rows = written(entries.join(hubs, "token").select("token", "hub", "x.*", "c"))
    together = rows.groupBy("hub", "node").agg(F.min("pos").alias("pos"), F.first("size").alias("size"), F.first("c").alias("c"))
    alone = rows.groupBy("hub", "token").agg(F.count("*").alias("n")).groupBy("hub").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    merge = together.groupBy("hub").agg(F.count("*").alias("u")).join(alone, "hub").select("hub", (F.col("u") * F.col("u") <= F.col("pairs")).alias("merge"))
    merge = written(merge)
    one = together.join(merge.where("merge"), "hub").select(F.xxhash64("hub").alias("key"), "node", "size", "pos", "c")
    own = rows.join(merge.where("not merge"), "hub").select(F.xxhash64("hub", "token").alias("key"), "node", "size", "pos", "c")
    return written(one.union(own))


def _blocked(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join components, from all pairs of a group, by pairs of blocks of similar size."""
    most = f"greatest(n / {BLOCK_SETS}, total / {BLOCK_SHINGLES})"
    total = [F.count("*").alias("n"), F.sum("size").alias("total")]
    banded = groups.withColumn("band", F.floor(F.log2("size") * BANDS))
    large = groups.groupBy("key").agg(*total).where(f"{most} > 1").select("key", F.lit(True).alias("large"))
    banded = banded.join(large, "key", "left").withColumn("band", F.when(F.col("large"), F.col("band")).otherwise(F.lit(0)))
    shares = banded.groupBy("key", "band").agg(*total).where(f"{most} > 1").select("key", "band", F.expr(f"cast(ceil({most}) as long) as shares"))
    dealt = banded.join(shares, ["key", "band"], "left").withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("node"), "shares")).otherwise(F.lit(0).cast("long")))
    dealt = written(dealt.select("key", F.struct("band", "share").alias("at"), "node", "size", "pos", "c"))
    directory = dealt.groupBy("key", "at").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - F.col("pos")).alias("rest"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    of = lambda s: directory.select(F.col("key").alias(f"{s}_key"), *[F.col(x).alias(f"{s}_{x}") for x in directory.columns[1:]])
    possible = f"a_key = b_key and a_at <= b_at and not (a_c0 = a_c1 and b_c0 = b_c1 and a_c0 = b_c0) and 100 * a_high >= {percent} * b_low and 100 * b_high >= {percent} * a_low and {100 + percent} * least(a_rest, b_rest) >= {percent} * (a_low + b_low)"
    pairs = of("a").join(of("b"), F.expr(possible)).select(F.col("a_key").alias("key"), F.col("a_at").alias("first"), F.col("b_at").alias("second"))
    blocks = dealt.join(sets, "node").groupBy("key", "at").agg(F.collect_list(F.struct("node", "size", "pos", "c", "grams")).alias("sets"))
    both = pairs.join(blocks.select("key", F.col("at").alias("first"), F.col("sets").alias("a")), ["key", "first"])
    both = both.join(blocks.select("key", F.col("at").alias("second"), F.col("sets").alias("b")), ["key", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column("a"), batch.column("b"), batch.column("same").to_pylist()):
                found = block_links(_side(a), None if same else _side(b), percent)
                yield pa.RecordBatch.from_pydict({"a": [min(x) for x in found], "b": [max(x) for x in found]}, schema=_PAIR)
        give_back()

    return both.select("a", "b", F.expr("first = second").alias("same")).mapInArrow(run, "a long, b long").distinct()


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _side(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, sizes, positions, components and sets of a block, each node once."""
    got = {r["node"]: r for r in rows.as_py()}
    cols = [np.array([r[k] for r in got.values()], np.int64) for k in ("node", "size", "pos", "c")]
    return *cols, [np.frombuffer(r["grams"], np.uint64) for r in got.values()]


def block_links(a, b, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between two blocks (or within one, if ``b`` is None) that join components, without a needless one.

    Every set is compared with a pivot.  D, the symmetric difference of two sets, is that of their differences
    from the pivot; sets link if D <= (100 - percent) / (100 + percent) of their sizes' sum.
    """
    sides = [a] if b is None else [a, b]
    node, size, pos, c = (np.concatenate([s[k] for s in sides]) for k in range(4))
    sets = [g for s in sides for g in s[4]]
    pivot = sets[0]
    apart = [np.setxor1d(g, pivot, assume_unique=True) for g in sets]
    far = np.array([len(x) for x in apart], np.int64)
    width = min(1 << 15, max(1 << 10, 1 << int(4 * far.max(initial=1) - 1).bit_length()))
    bits = np.zeros((len(sets), width // 8), np.uint8)
    for k, x in enumerate(apart):
        places = (x >> np.uint64(20)).astype(np.int64) & (width - 1)
        bits[k] = np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8))
    words = bits.view(np.uint64)
    parent = {int(x): int(x) for x in c}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    n = len(sets) if b is None else len(a[0])
    for i in range(n):
        j = np.arange(i + 1, len(sets)) if b is None else np.arange(n, len(sets))
        both = size[i] + size[j]
        rest = np.minimum(size[i] - pos[i], size[j] - pos[j])
        most = (100 - percent) * both // (100 + percent)  # the largest D that links
        j_ok = (c[i] != c[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & ((100 + percent) * rest >= percent * both) & (np.abs(far[i] - far[j]) <= most)
        j, most = j[j_ok], most[j_ok]
        if not len(j):
            continue
        least = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        j, most, least = j[least <= most], most[least <= most], least[least <= most]
        for k in np.argsort(least, kind="stable"):
            other = int(j[k])
            x, y = find(int(c[i])), find(int(c[other]))
            if x == y or node[i] == node[other]:
                continue
            if far[i] + far[other] <= most[k] or far[i] + far[other] - 2 * _common(apart[i], apart[other]) <= most[k]:
                parent[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[other])))
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, node, n_shingles, component_id``; ``node`` is the class of equal sets."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    survey = _survey(docs, shingle, percent, parts)
    members = survey.where("counts is null").select(F.expr("if(no_k, null, k)").alias("k"), F.expr("if(size = 0, null, node)").alias("node"), "size")
    nodes = written(survey.where("size > 0").withColumn("k", F.expr("if(no_k, null, k)")).groupBy("node").agg(F.min("k").alias("rep"), *[F.first(c).alias(c) for c in ("size", "s0", "s1", "s2", "s3", "bitmap")]))
    entries = nodes.agg(F.sum(F.floor(F.col("size") * (100 - percent) / 100) + 1)).first()[0] or 0
    lists = _index(docs, _levels(survey), shingle, percent, max(parts, entries // ENTRIES + 1))

    near = written(_could_reach(_neighbours(lists, percent), nodes, percent))
    links = written(_verify(near, _sets(docs, _ends(near), nodes, shingle), percent))
    still = _open(lists, components(links))
    short = _short(still.where(f"n <= {SMALL}"), nodes, percent).join(near, ["a", "b"], "left_anti")
    short = written(_could_reach(short, nodes, percent))
    groups = _merged(still.where(f"n > {SMALL}"), links)
    sets = written(_sets(docs, _ends(short).union(groups.select("node")).distinct(), nodes, shingle))
    more = written(_verify(short, sets, percent).union(_blocked(groups, sets, percent)))
    roots = components(links.union(more))

    low = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = low.join(low.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    return members.join(low, "node", "left").select(F.col("k").alias("doc_id"), "node", F.col("size").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))
