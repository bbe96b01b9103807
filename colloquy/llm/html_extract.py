"""Main text of web pages: structure first, then host suffix arrays.

A page is cut into blocks.  Scripts, styles and comments go; containers whose tag or class says menu,
header, footer, sidebar, notice, advert, form or reader comment go with all they hold; inside a marked
article (``article``, ``main``, role or class), headings and ids are not held against a container.
The blocks of all pages are compared across pages of the host: the suffixes of their token streams are
sorted to RUN tokens, and substrings of that length that occur on PAGES distinct pages or more are marked;
blocks covered by marks are boilerplate, and the unique runs are the main text.  A marked article confines
the main text to its own blocks, unless more unique text stands beside it than in it (a teaser), and an
article that is mostly repeated is a copy and is protected whole.  Pages with the same stream count as one
page, so a copied page is not boilerplate.

A host is compared as a whole, whatever its size, in two rounds.  Pages are parsed in groups, which stay where
they are: only hashes travel.  Every substring of RUN tokens has a *minimizer*, the least hash of its substrings
of PART tokens; equal substrings have equal ones, and a minimizer serves some three substrings.  The first round
sorts the minimizers of all groups, dealt out by ranges of the hash, and tells each group which of its own are on
PAGES pages of the host or more.  The second does the same, exactly, for the substrings that have such a
minimizer, hashed with the host to 64 bits, with at most PAGES of a group's token streams each.  So no task
holds a host, and a page's text does not depend on other hosts or on the table's size.  :func:`main_texts` finds
the same by a suffix array of one host's pages.

Defined results: null or empty html gives the empty text; a null url is a host of its own; character
references are decoded; white space inside a block is one blank; blocks are joined by two line feeds.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from colloquy.llm.common import give_back, shared_folder
from colloquy.llm.jaccard import _mix, _power_tables

RUN, PAGES, COVER = 8, 3, 0.8
#: Tokens of a minimizer's substrings, and bits that the first round keeps of their hashes.
PART, SHORT = 4, 40
#: Characters of a group of pages, and tokens whose hashes a task sorts at once; both only bound memory.
GROUP_CHARS, BUCKET = 3_000_000, 1 << 22
#: The code of a block's border.
BORDER = np.uint64(0x9E3779B97F4A7C15)
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title|object)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<[!?][^<>]*>")
_CUT = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form head script style noscript template iframe select button menu dialog fieldset".split())
#: Words of class, id or role that mark a container as boilerplate.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header "
    "hidden login menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related reply replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets complementary contentinfo".split()
)
MAIN = frozenset("article main".split())
#: Not held to MARKED inside a marked article.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
CONTENT = re.compile(r"(?:^|[\s_-])(?:articlebody|article[-_ ]?(?:body|content|text)|post[-_ ]?(?:body|content|text)|entry[-_ ]?content|main[-_ ]?content)(?:$|[\s_-])", re.I)


def _kind(tag: str, attributes: str, inside_main: bool) -> int:
    """-1 boilerplate, 1 article, 0 neither."""
    if tag in DROPPED or (tag == "header" and not inside_main):
        return -1
    if "=" in attributes or "hidden" in attributes:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
        named = " ".join(values.get(k, "") for k in ("class", "id", "role"))
        telling = " ".join(values.get(k, "") for k in ("class", "role")) if inside_main else named
        if tag not in ("body", "html", "main") and not (inside_main and tag in HEADINGS) and any(w.lower() in MARKED for w in _PART.findall(telling)):
            return -1
        if "display:none" in values.get("style", "").replace(" ", "").lower() or re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes):
            return -1
        if values.get("role", "").lower() in MAIN or values.get("itemprop", "").lower() == "articlebody" or CONTENT.search(named):
            return 1
    return 1 if tag in MAIN else 0


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """The blocks of a page that no container drops, in order, and whether they are in a marked article."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, dropped depth, in an article
    text: list[str] = []
    source = _RAW.sub(" ", page or "")
    source = _CUT.sub("", source)

    def close() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((joined, bool(stack) and stack[-1][2]))

    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at and not (stack and stack[-1][1]):
            text.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag not in INLINE
        if block:
            close()
        elif tag == "br":
            text.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if block:  # a block ends an open paragraph, and an item the item before it
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p", "li"):
                    break
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        kind = _kind(tag, m[3], inside)
        stack.append((tag, dropped + (kind < 0), inside or kind > 0))
    if not (stack and stack[-1][1]):
        text.append(source[at:])
    close()
    return out


def repeated(streams: list[list[int]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each token stream, which tokens are covered by substrings of ``run`` tokens found in ``pages`` distinct streams.

    The suffixes of the concatenation are ordered by prefix doubling until they are sorted by ``run`` tokens
    (a power of two); equal ranks are equal substrings.
    """
    distinct = {tuple(s): k for k, s in enumerate(dict.fromkeys(map(tuple, streams)))}
    order = sorted(distinct, key=distinct.get)
    n = sum(map(len, order)) + len(order)
    if not n:
        return [np.zeros(0, bool) for _ in streams]
    page = np.repeat(np.arange(len(order)), [len(s) + 1 for s in order])
    text = np.concatenate([np.append(np.array(s, np.int64), -1 - k) for k, s in enumerate(order)])  # each end is unique
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        behind = np.zeros(n, np.int64)
        behind[:-width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        width *= 2
    seen = np.unique(rank * len(order) + page)
    often = np.bincount(seen // len(order), minlength=n) >= pages
    start = often[rank]
    cover = np.cumsum(np.concatenate([[0], start.astype(np.int64)]))
    covered = cover[np.arange(1, n + 1)] - cover[np.maximum(np.arange(1, n + 1) - width, 0)] > 0
    parts = dict(zip(order, np.split(covered, np.cumsum([len(s) + 1 for s in order])[:-1])))
    return [parts[tuple(s)][:-1] for s in streams]


def _spans(page: list[tuple[str, bool]]) -> tuple[list[str | None], list[tuple[int, int]]]:
    """The token stream of a page's blocks, and each block's range in it; a border (None) begins each block."""
    stream: list[str | None] = []
    at = []
    for block, _ in page:
        begin = len(stream)
        stream.append(None)  # block borders are tokens: a row of short blocks can repeat too
        stream += block.split()
        at.append((begin, len(stream)))
    return stream, at


def _kept(page: list[tuple[str, bool]], cover: np.ndarray, at: list[tuple[int, int]]) -> str:
    """The main text of a page, given which tokens of its stream are repeated."""
    often = [cover[i:j].mean() >= COVER for i, j in at]
    size = [j - i - 1 for i, j in at]
    inside = sum(n for n, (_, marked) in zip(size, page) if marked)
    beside = sum(n for n, r, (_, marked) in zip(size, often, page) if not marked and not r)
    if beside > inside:  # no marked article, or a teaser only
        return "\n\n".join(b for (b, _), r in zip(page, often) if not r)
    # Boilerplate is the smaller part of an article; one that is mostly repeated is a copy, and stays whole.
    copied = 2 * sum(n for n, r, (_, marked) in zip(size, often, page) if marked and r) >= inside
    return "\n\n".join(b for (b, marked), r in zip(page, often) if marked and (copied or not r))


def main_texts(pages: list[list[tuple[str, bool]]]) -> list[str]:
    """Main texts of pages of one host, given their blocks; :func:`extract` gives the same for hosts of any size."""
    ids: dict[str | None, int] = {None: 0}
    parts = [_spans(p) for p in pages]
    covers = repeated([[ids.setdefault(w, len(ids)) for w in stream] for stream, _ in parts])
    return [_kept(p, cover, at) for p, cover, (_, at) in zip(pages, covers, parts)]


def _hash(data: bytes, size: int = 8) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=size).digest(), "little")


def _codes(text: bytes) -> np.ndarray:
    """64-bit codes of the tokens of blocks that each follow a line feed: the line feeds and the words."""
    raw = np.frombuffer(text, np.uint8)
    border = raw == 10
    blank = border | (raw == 32)
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    words = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    del total
    at = np.concatenate([np.flatnonzero(border), start])
    return np.concatenate([np.full(len(at) - len(start), BORDER), words])[np.argsort(at, kind="stable")]


def _hashed(code: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` tokens in a row, with a seed for each place."""
    size = max(0, len(code) - n + 1)
    h = seed[:size].copy()
    for k in range(n):
        h = (h ^ code[k : k + size]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


class Group:
    """The parsed pages of a group: ``pages`` with (page_id, url, marks of its blocks), tokens, and their hashes."""

    def __init__(self, data: bytes):
        self.pages, hosts, text = pickle.loads(zlib.decompress(data))
        self.text = text
        self.code = _codes(text)
        borders = np.append(np.flatnonzero(self.code == BORDER), len(self.code))
        counts = np.array([len(marks) for *_, marks in self.pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of each page's blocks
        self.block = borders  # where blocks begin among the tokens
        self.begin = borders[self.first]  # where pages begin
        self.page = np.repeat(np.arange(len(self.pages)), np.diff(self.begin))
        self.seed = np.repeat(np.array([_hash(h.encode("utf-8", "surrogatepass")) for h in hosts], np.uint64), np.diff(self.begin))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where RUN tokens of one page begin, and the hashes of these and the host."""
        h = _hashed(self.code, self.seed, RUN)
        at = np.flatnonzero(self.page[: len(h)] == self.page[RUN - 1 : RUN - 1 + len(h)])
        return at, h[at]

    def minimizers(self, at: np.ndarray) -> np.ndarray:
        """The least hash of PART tokens within the RUN at each place, its upper SHORT bits."""
        h = _hashed(self.code, self.seed, PART) >> np.uint64(64 - SHORT)
        least = h[at]
        for k in range(1, RUN - PART + 1):
            np.minimum(least, h[at + k], out=least)
        return least

    def streams(self) -> np.ndarray:
        """A hash of each page's token stream; pages with the same stream count as one."""
        if not len(self.code):
            return np.zeros(len(self.pages), np.uint32)
        place = (np.arange(len(self.code)) - self.begin[self.page]).astype(np.uint64)
        total = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum(_mix(self.code + _mix(place)), out=total[1:])
        return (_mix(total[self.begin[1:]] - total[self.begin[:-1]]) >> np.uint64(32)).astype(np.uint32)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as planes of their differences' bytes, which compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _first(keys: np.ndarray, streams: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by key: at most ``most`` distinct streams of each key, which is all that a count up to ``most`` needs."""
    order = np.lexsort((streams, keys))
    keys, streams = keys[order], streams[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (streams[1:] != streams[:-1])
    keys, streams = keys[new], streams[new]
    begins = np.ones(len(keys), bool)
    begins[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(begins)
    rank = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))
    return keys[rank < most], streams[rank < most]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of parsed pages: ``part, tokens, data``."""

    def group(held: list) -> pa.RecordBatch:
        pages = [(k, u, [marked for _, marked in p]) for k, u, _, p in held]
        text = "".join("\n" + b for *_, p in held for b, _ in p).encode("utf-8", "surrogatepass")
        data = zlib.compress(pickle.dumps((pages, [h for _, _, h, _ in held], text)), 1)
        return pa.RecordBatch.from_pydict({"part": [uuid.uuid4().hex], "tokens": [text.count(b" ") + 2 * text.count(b"\n")], "data": [data]}, _PARSED)

    held, size = [], 0
    for batch in batches:
        for k, u, source, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host"))):
            page = blocks(source)
            held.append((k, u, h, page))
            size += sum(len(b) for b, _ in page) + 100
            if size > GROUP_CHARS:
                yield group(held)
                held, size = [], 0
    if held:
        yield group(held)
    del held
    give_back()


_PARSED = pa.schema([("part", pa.string()), ("tokens", pa.int64()), ("data", pa.binary())])
_KEYS = pa.schema([("bucket", pa.int32()), ("part", pa.string()), ("keys", pa.binary()), ("more", pa.binary())])
_HOT = pa.schema([("part", pa.string()), ("keys", pa.binary())])
KEYS = "bucket int, part string, keys binary, more binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _slices(part: str, keys: np.ndarray, more: np.ndarray, bits: int, buckets: int) -> list[tuple]:
    """Rows of _KEYS from sorted keys of so many bits: buckets are ranges of the key, so each is a slice."""
    top = keys >> np.uint64(bits - 32)
    cut = np.searchsorted(top * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    return [(b, part, _packed(keys[i:j]), more[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]


def _emit_minimizers(buckets: int):
    """From groups to their minimizers, each with the pages of the group that have it, up to PAGES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                group = Group(data)
                at = group.grams()[0]
                least, page = group.minimizers(at), group.page[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (page[1:] != page[:-1])
                least, page = least[new], page[new].astype(np.uint64)
                order = np.argsort(least, kind="stable")  # pages stay in order among equal keys
                least, page = least[order], page[order]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (page[1:] != page[:-1])
                keys, n = np.unique(least[new], return_counts=True)
                del least, page, order, new
                # One row for each count of pages: the count is no bytes of each key.
                for pages in range(1, PAGES + 1):
                    of = keys[n == pages] if pages < PAGES else keys[n >= pages]
                    yield _rows([(b, part, k, bytes([pages])) for b, part, k, _ in _slices(part, of, of[:0], SHORT, buckets)], _KEYS)
        give_back()

    return run


def _emit_grams(buckets: int):
    """From groups, with the minimizers that are on enough pages, to the substrings that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, hot in zip(*(batch.column(c).to_pylist() for c in ("part", "data", "keys"))):
                group = Group(data)
                at, h = group.grams()
                often = _among(group.minimizers(at), _sorted(hot))
                k, s = _first(h[often], group.streams()[group.page[at[often]]], PAGES)
                yield _rows(_slices(part, k, s, 64, buckets), _KEYS)
        give_back()

    return run


def _sorted(hot: list[bytes] | None) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, hot or [])]))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _count(exact: bool):
    """From the keys of a bucket to those on PAGES pages or more (``exact``: distinct streams), for each group that has them."""

    def often(held: list) -> np.ndarray:
        keys = np.concatenate([k for _, k, _ in held])
        if exact:
            values, n = np.unique(_first(keys, np.concatenate([np.frombuffer(m, np.uint32) for *_, m in held]), PAGES)[0], return_counts=True)
        else:
            values, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, np.repeat([float(m[0]) for *_, m in held], [len(k) for _, k, _ in held]), len(values))
        return values[n >= PAGES]

    def flush(held: list) -> pa.RecordBatch:
        found = often(held)
        got = [(part, k[_among(k, found)]) for part, k, _ in held]
        held.clear()
        return _rows([(part, _packed(k)) for part, k in got if len(k)], _HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for b, part, keys, more in zip(*(batch.column(c).to_pylist() for c in _KEYS.names)):
                if held and b != at:
                    yield flush(held)
                at = b
                held.append((part, _unpacked(keys), more))
        if held:
            yield flush(held)
        give_back()

    return run


def _kept_in_place(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``rows`` written to the shared folder in buckets of ``key``, so that a join on it moves only the other side."""
    spark = rows.sparkSession
    name = f"colloquy_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018 - resolved now: the files stay when the name goes
    spark.sql(f"drop table {name}")
    return found


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host.alias("host"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = _kept_in_place(rows.mapInArrow(_parse, "part string, tokens long, data binary"), "part", parts)
    buckets = (parsed.agg(F.sum("tokens")).first()[0] or 0) // BUCKET + 1

    def hot(keys: DataFrame, exact: bool) -> DataFrame:
        # Each bucket holds about BUCKET keys at most, of whatever hosts: hashes spread them evenly.
        dealt = keys.repartition(max(buckets, parts), "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_count(exact), "part string, keys binary").groupBy("part").agg(F.collect_list("keys").alias("keys"))

    first = hot(parsed.select("part", "data").mapInArrow(_emit_minimizers(buckets), KEYS), False)
    second = hot(parsed.join(first, "part").select("part", "data", "keys").mapInArrow(_emit_grams(buckets), KEYS), True)
    kind = pages.schema[key].dataType
    result = StructType([StructField("page_id", kind), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column("data").to_pylist(), batch.column("keys").to_pylist()):
                group = Group(data)
                at, h = group.grams()
                start = at[_among(h, _sorted(found))]
                cover = np.zeros(len(group.code), bool)
                for i in range(RUN):
                    cover[start + i] = True
                texts = group.text.decode("utf-8", "surrogatepass").split("\n")[1:]
                out = []
                for n, (k, u, marks) in enumerate(group.pages):
                    i, j, begin = group.first[n], group.first[n + 1], group.begin[n]
                    spans = [(int(x - begin), int(y - begin)) for x, y in zip(group.block[i:j], group.block[i + 1 : j + 1])]
                    text = _kept(list(zip(texts[i:j], marks)), cover[begin : group.begin[n + 1]], spans)
                    out.append((k, u, text, len(text)))
                yield _rows(out, schema)
        give_back()

    return parsed.select("part", "data").join(second, "part", "left").select("data", "keys").mapInArrow(run, result)
