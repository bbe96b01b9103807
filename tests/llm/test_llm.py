"""The corpus operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import chat, fingerprint, html_extract, jaccard, langid, licenses, mixing, packing, quality, queries, toxicity
from colloquy.llm.common import fold, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and blank texts, ties, repeated rows, one long text; and a column whose name operators use inside.
EDGE = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "a b c", "x"), (4, "a b c", "x"), (None, "one two three four five six", "x"), (5, "word " * 60_000, "x"), (6, "<|endoftext|> ü 漢字 😀 </s>", "x")]


def edge(spark, rows=EDGE):
    return spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("lang", F.lit("en")).withColumn("node", F.lit("n"))


def sentences(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary, n))


# -- language ID ------------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    held = docs.where(fold("doc_id", 3) == 1).select("lang", langid.predict("text", model).alias("l"))
    got = held.agg(F.avg((F.col("lang") == F.col("l.lang")).cast("int")).alias("a"), F.min("l.score").alias("low"), F.max("l.score").alias("high")).first()
    assert got.a > 0.97 and 0 <= got.low <= got.high <= 1


def test_language_id_edges(spark):
    model = langid.fit(edge(spark))
    got = edge(spark).select("doc_id", langid.predict("text", model).alias("l")).collect()
    assert {r.l.lang for r in got if r.doc_id in (1, 2, 3)} == {"und"} and {r.l.lang for r in got if r.doc_id in (4, 5)} == {"en"}
    empty = langid.fit(edge(spark, []))
    assert {r.l.lang for r in edge(spark).select(langid.predict("text", empty).alias("l")).collect()} == {"und"}


def test_letters_of_all_planes(spark):
    model = langid.fit(edge(spark))
    rows = spark.createDataFrame([(t,) for t in ("😀 😀", "𝟏𝟐", "𐐀𐐁", "12 !?")], "t string").select("t", langid.predict("t", model).alias("l"))
    assert {r.t: r.l.lang for r in rows.collect()} == {"😀 😀": "und", "𝟏𝟐": "und", "𐐀𐐁": "en", "12 !?": "und"}


def test_mixture_selects_two_languages():
    rng = np.random.default_rng(0)
    words = {"aa": ["abab", "baba", "abba"], "bb": ["xyxy", "yxyx", "xyyx"]}
    counts = np.full((1 << langid.BITS, 2), 0.5)
    for k, ws in enumerate(words.values()):
        counts[:, k] += np.bincount(langid._trigrams(langid._codes(" ".join(ws * 100)))[0], minlength=1 << langid.BITS)
    model = langid.LanguageModel(("aa", "bb"), np.log(counts / counts.sum(axis=0)).astype(np.float32))
    pi, sizes, n = langid.infer([sentences(rng, 40, words["aa"]) + " " + sentences(rng, 40, words["bb"]), sentences(rng, 40, words["aa"])], model)
    assert sizes.tolist() == [2, 1] and abs(pi[0, 0] - 0.5) < 0.05 and pi[1, 0] > 0.99 and n.tolist() == [80, 40]


# -- toxicity ---------------------------------------------------------------------------------------------


def distance_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_automaton_equals_edit_distance():
    words = frozenset(["idiot", "stupid", "scum"])
    m = toxicity.Matcher(words, frozenset(["loser"]))
    rng = np.random.default_rng(1)
    for _ in range(4000):
        w = list(rng.choice(["idiot", "stupid", "scum", "loser"]))
        for _ in range(rng.integers(0, 3)):
            k = rng.integers(0, len(w) + 1)
            w[k : k + rng.integers(0, 2)] = list("".join(rng.choice(list("abdiost"), rng.integers(0, 2))))
        w = "".join(w)
        want = 3 if w in words else 2 if w.startswith("loser") else 1 if any(len(x) >= toxicity.FUZZY_FROM and distance_one(w, x) for x in words) else 0
        assert m.match(w) == want, w


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_lexicon_equals_edit_distance_with_swaps():
    words = frozenset(["idiot", "scum", "worthless", "pathetic"])
    m = toxicity.Lexicon(words, frozenset())
    rng = np.random.default_rng(14)
    for _ in range(3000):
        w = list(rng.choice(sorted(words)))
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(0, len(w)))
            if rng.integers(0, 2):
                w[k : k + 2] = w[k : k + 2][::-1]
            else:
                w[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("cdiostw"), rng.integers(0, 2)))
        w = "".join(w) or "x"
        want = 3 if w in words else 1 if any(osa(w, x) <= (len(x) >= 4) + (len(x) >= 8) for x in words) else 0
        assert m.match(w) == want, w


def test_misspelt_abuse_is_found():
    model = toxicity.ToxicityModel(frozenset(["idiot", "moron", "scum", "worthless", "stupid"]), frozenset(), frozenset(["sum", "scam"]), (-4.0, 6.0, 6.0, 3.0, 0.5, 1.0, 0.0))
    for t in ("idoit", "morno", "scun", "wortles", "$tupid", "$tupdi", "moron's", "moron’s", "@idiot", "*idiot*"):
        assert toxicity.score(f"what a {t} here", model)[1] == 1, t
    assert all(toxicity.score(t, model)[1] == 0 for t in ("sum", "the sum's scam", "worth less", "river"))


def test_toxicity_held_out_and_edges(spark):
    rng = np.random.default_rng(2)
    clean = ["tree", "river", "house", "green", "cloud", "paper", "window"]
    rows = [(k, sentences(rng, 30, clean) + (" you idiot" if k % 4 == 0 else "") + " ende", int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where(fold("doc_id", 5) != 0))
    assert "idiot" in model.words
    got = docs.where(fold("doc_id", 5) == 0).select("toxic", toxicity.toxicity("text", model).alias("t")).collect()
    assert got and all((r.t.score >= 0.5) == bool(r.toxic) for r in got)
    assert toxicity.score("you idioot", model)[0] >= 0.5
    assert toxicity.score('he wrote "idiot" there', model)[0] < toxicity.score("idiot there", model)[0]
    assert all(0 <= toxicity.score(t, model)[0] < 0.5 for t in (None, "", "   "))
    none = toxicity.fit(docs.where("toxic = 0"))
    assert toxicity.score("you idiot", none)[0] < 0.5
    assert edge(spark).select(toxicity.toxicity("text", model).alias("t")).count() == len(EDGE)


# -- html -------------------------------------------------------------------------------------------------


def test_html_structure():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>About</ul></nav><div class='cookie-notice'>Accept</div>"
        "<article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Fo&uuml;r</p><div class=\"ad\">Buy</div><form>Mail <input></form></article>"
        "<div id=comments><article>first!</article></div><aside>x</aside><footer>&copy;</footer></body>"
    )
    assert html_extract.main_texts([html_extract.blocks(page)]) == ["A & B\n\nOne two three\n\nFoür"]
    assert html_extract.main_texts([html_extract.blocks(x) for x in (None, "", "<p", "plain 2 < 3 text")]) == ["", "", "", "plain 2 < 3 text"]


def test_repeated_equals_brute_force():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 3, rng.integers(0, 60)).tolist() for _ in range(8)] + [[1, 2] * 20]
    distinct = {tuple(s) for s in streams}
    pages = defaultdict(set)
    for s in distinct:
        for i in range(len(s) - 7):
            pages[s[i : i + 8]].add(s)
    for s, got in zip(streams, html_extract.repeated(streams, 8, 2)):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 7):
            if len(pages[tuple(s[i : i + 8])]) >= 2:
                want[i : i + 8] = True
        assert (got == want).all()


def test_unmarked_boilerplate_goes_and_unique_runs_stay(spark):
    foot = "this site uses small files to remember what you like best"
    rows = [(k, f"https://h.example/{k}", f"<body><div>own words of page number {k} here {'z' * k}</div><div>{foot}</div></body>") for k in range(5)]
    rows += [(9, None, None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"own words of page number {k} here {'z' * k}".strip() for k in range(5)}, 9: ""}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_host_is_compared_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "GROUP_CHARS", 20_000, raising=False)  # many groups
    notice = "this rare notice is on few of the pages of the host"
    rows = [(k, f"https://big.example/{k}", f"<div>{' '.join(f'w{k}x{i}' for i in range(9))}</div>" + (f"<div>{notice}</div>" if k in (3, 700, 1400) else "")) for k in range(1500)]
    rows += [(k, f"https://other.example/{k}", f"<div>{notice}</div><div>{k}</div>") for k in (2001, 2002)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows) and not any(notice in got[k] for k in range(1500)) and all(notice in got[k] for k in (2001, 2002))


def test_extract_equals_suffix_array(spark):
    rng = np.random.default_rng(11)
    pages = ["".join(f"<div>{sentences(rng, 9, ['a', 'b', 'c'])}</div>" for _ in range(rng.integers(0, 5))) for _ in range(60)]
    pages += pages[:10]
    want = html_extract.main_texts([html_extract.blocks(p) for p in pages])
    rows = [(k, "//h/", p) for k, p in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == dict(enumerate(want)) and {r.n_chars for r in got} > {0}


def test_repeats_inside_marked_articles_and_teasers(spark):
    own = lambda k, n=30: " ".join(f"t{k}y{i}" for i in range(n))
    notice = "please tell all of your friends about this fine page"
    article = lambda k: f"<article><header class='entry-header'><h1>Head {k}</h1></header><p>{own(k)}</p><h2 id='related-work'>Work</h2><section id='share'><p>{own(100 + k)}</p></section><p>{notice}</p></article>"
    pages = [f"<body><p>by line {k}</p>{article(k)}</body>" for k in range(4)]
    pages += [f"<body><article>teaser {k}</article><div>{own(k)}</div></body>" for k in range(4, 6)]
    pages += [f"<body><article><p>{own(50)}</p><p>only {k}</p></article></body>" for k in range(6, 9)]  # near copies
    want = [f"Head {k}\n\n{own(k)}\n\nWork\n\n{own(100 + k)}" for k in range(4)] + [f"teaser {k}\n\n{own(k)}" for k in range(4, 6)] + [f"{own(50)}\n\nonly {k}" for k in range(6, 9)]
    assert html_extract.main_texts([html_extract.blocks(p) for p in pages]) == want
    rows = spark.createDataFrame([(k, "//h/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(rows).collect()} == dict(enumerate(want))


# -- packing ----------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    from colloquy.llm import tokens

    docs = table(spark, SF, "documents").select("doc_id", "text").union(edge(spark).where("doc_id in (1, 2, 5, 6)").select(F.col("doc_id") + 100_000, "text"))
    got = packing.pack_documents(docs, capacity=256).collect()
    plain = Tokenizer.from_file(tokens.default_path())
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, t in docs.collect():
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(parts[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 256 or k == 0)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 41, rng.integers(1, 200)).tolist(), reverse=True)
        gaps = []
        for x in lengths:
            fit = [g for g in gaps if g >= x]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - x)
            else:
                gaps.append(40 - x)
        histogram = {x: lengths.count(x) for x in lengths}
        rounds, used, ends = packing.plan(histogram, 40), defaultdict(int), {}
        for n, (length, rank, first, offset) in enumerate(rounds):
            last = rounds[n + 1][1] if n + 1 < len(rounds) and rounds[n + 1][0] == length else histogram[length]
            for i in range(last - rank):
                used[first + i] += length
                ends[first + i] = max(ends.get(first + i, 0), offset + length)
        assert len(used) == len(gaps) and sum(used.values()) == sum(lengths) and all(used[s] == ends[s] <= 40 for s in used)


# -- licences ---------------------------------------------------------------------------------------------


def test_licences(spark):
    model = licenses.fit(table(spark, SF, "documents"))
    find = lambda t: [f for f, *_ in licenses.find(t, model)]
    assert find("abc def.\nReleased under the MIT License.\nmore") == ["mit"]
    assert find("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"] and find("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert find("This work is licensed under the GNU General Public License, version 3.") == ["gpl"]
    assert find("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published") == ["gpl"]
    assert find("MIT licensed") == ["mit"] and find("Mit.") == find("She studied at MIT.") == find("the BSD kernel is fast") == []
    assert find("The licence of the driver was valid.") == [] and find(None) == [] and find("") == []
    got = licenses.scan(edge(spark), model=model)
    assert got.count() == len(EDGE) and got.where("n_notices > 0").count() == 0
    text = "word " * 200_000 + "Released under the MIT License."
    assert licenses.find(text, model)[-1][0] == "mit" and licenses.find(text, model)[-1][3] == len(text)
    assert licenses.scan(edge(spark, [])).count() == 0


def test_licence_query_finds_planted_notices(spark):
    """The registered query against a plain search for the notices that the documents' generator plants."""
    got = {r.doc_id: set(r.families) for r in queries.op5_license_scan(spark, "/root/testdata/sf0.01").collect()}
    plain = {"mit": "Released under the MIT License", "cc-by-nc": "Licensed under CC BY-NC 4.0", "gpl": "GNU General Public License", "apache-2.0": "Licensed under the Apache License"}
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    assert got == {r.doc_id: {f for f, phrase in plain.items() if phrase in (r.text or "")} for r in docs}


def test_licence_fit_counts_every_document(spark, monkeypatch):
    """Every sentence of more documents than a sample would have is counted; any document tells in the model, and blocks do not."""
    draw = random.Random(5)
    bag = sorted({w for phrases in (*licenses.TEMPLATES.values(), licenses.GRANTS) for t in phrases for w in licenses._words(t)})
    texts = [" ".join("A " + " ".join(draw.choice(bag) for _ in range(draw.randint(2, 7))) + "." for _ in range(8)) for _ in range(1000)] + [None, "", "Released under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index, templates = licenses._index()
    vocabulary = frozenset(bag)
    wanted = defaultdict(int)
    for t in texts:
        for s in licenses._SENTENCE.split(t or ""):
            grams = {*(w := licenses._words(s)), *zip(w, w[1:])}
            known = sorted(index[g] for g in grams if g in index)
            if not vocabulary.isdisjoint(w) and not templates.confirmed(known):
                wanted[tuple(known), len(grams)] += 1
    got = {(tuple(np.frombuffer(bytes(r["at"]), "<i2").tolist()), r["size"]): r["n"] for r in licenses.profiles(docs, "text", vocabulary, index, templates).collect()}
    assert got == wanted and sum(got.values()) > 7000
    model = licenses.fit(docs)
    assert all(not np.array_equal(licenses.fit(docs.where(f"doc_id <> {k}")).weights, model.weights) for k in (3, 999))
    monkeypatch.setattr(licenses, "BLOCK", 900)  # now tasks sum the gradients
    dealt = licenses.fit(docs)
    assert np.allclose(dealt.weights, model.weights) and abs(dealt.threshold - model.threshold) < 1e-9


# -- quality ----------------------------------------------------------------------------------------------


def quality_counts(t):
    w = WORD.findall(t or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(edge(spark).select("doc_id", "text")).union(spark.createDataFrame([(7, "a b\x0bc a b c a\n a b\n\n a b"), (8, "x # $ é é")], "doc_id long, text string"))
    got = sorted(map(repr, [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(docs).collect()]))
    assert got == sorted(map(repr, [(d, *quality_counts(t)) for d, t in docs.collect()]))


def test_log_tail_is_the_binomial(spark):
    from math import comb, log

    rows = spark.createDataFrame([(0, 10), (3, 10), (5, 200), (40, 900)], "k long, n long")
    for r in rows.select("k", "n", quality._log_tail(F.col("k"), F.col("n"), 0.05).alias("t")).collect():
        assert r.t == pytest.approx(log(sum(comb(r.n, j) * 0.05**j * 0.95 ** (r.n - j) for j in range(r.k + 1))), abs=1e-9)


def test_cutoffs_need_evidence(spark):
    rows = [("en", 0.0)] * 3000 + [("fr", 0.0)] * 50
    measured = spark.createDataFrame([(k, s, 100, 500, 0, 0, 0, 5, 1) for k, (s, _) in enumerate(rows)], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, good int")
    got = {(r.stratum, r.rule) for r in quality.cutoffs(measured, "stratum", "good").collect()}
    assert got == {("en", rule) for rule in quality.RULES}
    judged = quality.judge(edge(spark), spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    assert judged.count() == len(EDGE) and judged.where("not base_failed and not kept").count() == 0


# -- fingerprints -----------------------------------------------------------------------------------------


def test_fingerprint_is_a_multiset_hash():
    of = lambda t: fingerprint.encode(fingerprint.vector(t))
    a, b, c = "one two three", "four five", "six seven eight nine"
    assert of(f"{a}\n{b}\n{c}") == of(f"{c}\n{a}\n\n{b}") != of(f"{a}\n{b}")
    assert fingerprint.combine(of(f"{a}\n{b}"), inserted=c) == of(f"{a}\n{b}\n{c}")
    assert fingerprint.combine(of(f"{a}\n{b}"), deleted=a) == of(b)
    assert of(None) == of("") and fingerprint.likeness(of(""), of("")) == 1 and fingerprint.likeness(of(a), of("")) == 0


def test_likeness_of_many_equal_pairs(spark):
    of = lambda t: fingerprint.encode(fingerprint.vector(t))
    a, b = "word " * 60_000, "word " * 30_000
    assert fingerprint.likeness(of(a), of(b)) == pytest.approx(0.8, abs=0.01)  # 2ab / (a² + b²)
    assert fingerprint.combine(of(a), inserted="x y", deleted="x y") == of(a) and fingerprint.likeness(of(a), fingerprint.combine(of(a), inserted=b)) > 0.9
    got = fingerprint.fingerprints_with_edits(spark.createDataFrame([(1, a), (2, "q")], "doc_id long, text string")).where("doc_id = 1").first()
    assert got.near_edited == pytest.approx(0.8, abs=0.3) and got.near_edited > 0.5


def test_fingerprints_with_edits(spark):
    rows = [(k, t) for k, t in enumerate([None, "", "ab\ncde", "x" * 31, "long " * 500, "q"])] + [(50 + k, f"text {k} of several") for k in range(40)]
    got = {r.doc_id: r for r in fingerprint.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest() and got[d].n_chars == len(t)
    assert fingerprint.fingerprints_with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first().near_next == 1.0
    # ids that doubles would round stay whole beside a null id, which comes first
    far = [(None, "first")] + [((1 << 60) + k, f"text {k} of several") for k in range(40)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprints_with_edits(spark.createDataFrame(far, "doc_id long, text string").repartition(3)).collect()}
    for (k, t), (_, after) in zip(far, far[1:] + far[:1]):
        h = len(t) // 2
        assert got[k] == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
    assert fingerprint.fingerprints_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert fingerprint.fingerprints_with_edits(edge(spark)).count() == len(EDGE)


# -- chat -------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = np.random.default_rng(5)
    pieces = ["</s>", "[INST]", "<|end|>\n", "<|user|>\n", "\\", "<", "|>", "[", "ä 😀", " word", "\n", "<\\", "|\\"]
    rows, k = [], 0
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be " + str(conv)))
        for turn in range(1, 40 if conv == 5 else 6):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], None if (k := k + 1) % 17 == 0 else "".join(rng.choice(pieces, rng.integers(0, 30)))))
    rows.append((99, 1, None, "x"))
    windows = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=300, history=80)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == conv)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = windows.where("conv_id = 5").collect()
    assert len(many) > 1 and all(w.n_tokens <= 300 or len(chat.read_back(w.text)) == 1 for w in many) and any(w.n_repeated for w in many)
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- mixing -----------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(10, 500)), rng.dirichlet([0.3, 0.3, 0.3]).tolist()) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    y, mean = mixing.fit_rates(df, ("a", "b", "c"), {"a": 0.6, "b": 0.3, "c": 0.1})
    got = df.withColumn("rate", mixing.rate(F.col("tokens"), F.col("p"), y, mean)).collect()
    total = np.array([np.array(r.p) * r.tokens * r.rate for r in got]).sum(axis=0)
    assert min(r.rate for r in got) >= 0 and np.abs(total / sum(r.tokens for r in got) - [0.6, 0.3, 0.1]).max() < 0.001
    with pytest.raises(ValueError):
        mixing.fit_rates(df, ("a", "b", "c"), {"z": 1.0})
    even = spark.createDataFrame([(10, [0.5, 0.5])] * 4, "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="not reached"):  # no rates give a all tokens
        y, mean = mixing.fit_rates(even, ("a", "b"), {"a": 1.0})
    assert all(r.rate >= 0 for r in even.withColumn("rate", mixing.rate(F.col("tokens"), F.col("p"), y, mean)).collect())


def test_mixing_query_meets_its_targets(spark):
    got = queries.op9_mixing(spark, "/root/testdata/sf0.01").collect()
    total = np.array([np.array(r.p) * r.tokens * r.rate for r in got]).sum(axis=0) / sum(r.tokens for r in got)
    assert np.abs(total - [queries.TARGETS[d] for d in sorted(queries.TARGETS)]).max() < 0.001


def test_mixing_edges(spark):
    labelled = edge(spark).where("doc_id > 3").withColumn("domain", F.when(F.col("doc_id") == 5, "p").otherwise("q"))
    got = mixing.mix(edge(spark), labelled, {"p": 0.5, "q": 0.5}).collect()
    assert len(got) == len(EDGE) and all(r.rate == 1 for r in got if r.doc_id in (1, 2, 3)) and all(r.rate >= 0 for r in got)
    alone = mixing.mix(edge(spark), labelled.where("domain = 'p'"), {"p": 1.0}).collect()
    assert {r.rate for r in alone} == {1.0}
    assert mixing.apply(edge(spark), labelled, {"p": 0.5, "q": 0.5}).columns == edge(spark).columns


# -- n-gram Jaccard join ----------------------------------------------------------------------------------


def brute_components(rows, n=5):
    sets, ids = [], {}
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(ids.setdefault(tuple(w[i : i + n]), len(ids)) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("frequent", "edges"), [(24, 250_000), (2, 7)])
def test_jaccard_equals_brute_force(spark, monkeypatch, frequent, edges):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "EDGES", edges)  # the second case contracts in many tasks and rounds
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = sentences(rng, 40, vocabulary)
    rows = []
    for _ in range(12):
        base = rng.choice(vocabulary, rng.integers(30, 200)).tolist()
        for _ in range(rng.integers(1, 9)):
            text = base.copy()
            for k in rng.integers(0, len(text), rng.integers(0, 6)):
                text[k] = str(rng.choice(vocabulary))
            rows.append(" ".join(text))
    rows += [sentences(rng, 20, vocabulary) + " " + passage for _ in range(15)] + [None, "", " \n", "A b", "a B", "a b c d e", "one"]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(rows)), rows)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_shingles_of_long_texts_in_bounded_memory(monkeypatch):
    rng = random.Random(8)
    for text in ("", " ", "a", " Ab\tc ", "x" * 40, *("".join(rng.choice("aB é\n") for _ in range(60)) for _ in range(50))):
        whole = jaccard.shingles(text)
        for size in (1, 2, 7):
            with monkeypatch.context() as m:
                m.setattr(jaccard, "SLICE", size, raising=False)
                assert jaccard.shingles(text).tolist() == whole.tolist()
        words = re.findall(r"[^\x20\x09-\x0D]+", text.replace("B", "b"))
        assert len(whole) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else ())
    long = " ".join("w" * 15 + str(k) for k in range(400_000))  # 8 MB
    monkeypatch.setattr(jaccard, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    tracemalloc.start()
    try:
        assert len(jaccard.shingles(long)) == 400_000 - 4
        assert tracemalloc.get_traced_memory()[1] < 20 * len(long)
    finally:
        tracemalloc.stop()


def test_jaccard_edges(spark):
    got = jaccard.join(edge(spark)).collect()
    assert len(got) == len(EDGE) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1, 2, 3} and all(r.n_shingles == 0 for r in got if r.doc_id in (1, 2, 3))
    assert jaccard.join(edge(spark, [])).count() == 0


# -- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_drops_languages_never_learned(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    rng = np.random.default_rng(12)
    odd = [sentences(rng, 60, ["qxzzkv", "wjqqyx", "kzvxj", "bqxwz", "zzqjk"]), sentences(rng, 40, ["данные", "город", "река", "слово"]), "?? 12"]
    rows = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(rows)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, SF).select("doc_id").collect()}
    wanted = {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect()}
    assert not any(10**9 + k in kept for k in range(3)) and len(wanted - kept) <= 0.01 * len(wanted)


def test_near_duplicates_keep_one_row(spark):
    import corpus_pipeline

    rng = np.random.default_rng(13)
    a, b, c, d = (sentences(rng, 60, [f"v{k}" for k in range(200)]) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (2, a + " more"), (3, b), (3, c), (None, c), (None, c + " end"), (None, d), (None, d + " end"), (None, None), (None, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    key = lambda r: (r[0] or 0, r[1] or "")
    plain = sorted(((r.doc_id, r.text) for r in got if r.text and not r.text.startswith(d)), key=key)
    assert plain == sorted([(1, a), (3, b), (3, c)], key=key)
    assert sum(bool(r.text and r.text.startswith(d)) for r in got) == 1 and sum(not r.text for r in got) == 2


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from colloquy.llm.common import written

        kept = written(stage(spark, docs, SF))
        assert kept.columns == columns and 0 < kept.count()
        if name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _, c in brute_components(rows) if d == c}
        elif name != "mixing":
            assert kept.count() >= 0.7 * before
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def reachable(sets):
    """Links between sets by their definition, and each set's smallest reachable index."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 120)
    sets = []
    for k in range(60):
        drop = rng.integers(0, 30)
        sets.append(frozenset(rng.choice(base, 120 - drop, replace=False).tolist()) | frozenset(rng.integers(1, 1 << 62, rng.integers(0, 30)).tolist()))
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    n = np.arange(60)
    block = lambda at: (n[at], np.array([len(arrays[k]) for k in at]), np.zeros(len(at), np.int64), n[at], [arrays[k] for k in at])
    whole = jaccard.block_links(block(n), None)
    halves = jaccard.block_links(block(n[:25]), None) + jaccard.block_links(block(n[25:]), None) + jaccard.block_links(block(n[:25]), block(n[25:]))
    for links in (whole, halves):
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
        roots = list(range(60))
        for _ in range(60):
            for a, b in links:
                roots[a] = roots[b] = min(roots[a], roots[b])
        assert roots == reachable(sets)
    assert len(whole) == 60 - len(set(reachable(sets)))


@pytest.mark.parametrize("sets_a_block, merged", [(512, True), (5, False)])
def test_long_lists_by_blocks_equal_brute_force(spark, monkeypatch, sets_a_block, merged):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "LONG", 8)
    monkeypatch.setattr(jaccard, "ORDERS", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets_a_block)
    rng = np.random.default_rng(6)
    words = np.array([f"w{k}" for k in range(4000)])
    texts = []
    for size in (60, 60, 200):
        base = rng.choice(words, size)
        for _ in range(30):
            text = base.copy()
            at = rng.choice(size, rng.integers(0, size // 12), replace=False)
            text[at] = rng.choice(words, len(at))
            texts.append(" ".join(text[: size - rng.integers(0, size // 5)]))
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts, 1)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {k: c + 1 for k, c in enumerate(reachable([frozenset(jaccard.shingles(t).tolist()) for t in texts]), 1)}
    groups = defaultdict(set)
    for k, c in want.items():
        if k % 7:
            groups[c].add(k)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {k: min(g) for g in groups.values() for k in g}


def test_extract_keeps_any_rows(spark):
    """Null keys, repeated rows, equal ids, columns with clashing names, blocks with odd characters."""
    rows = [(None, None, "<p>no key</p>", "p"), (1, "//h/", "<p>a\x00b \x85 c</p><p>&#10;x&nbsp;y</p>", "p"), (1, "//h/", "<p>a\x00b \x85 c</p><p>&#10;x&nbsp;y</p>", "p"), (1, "//h/", "<p>other</p>", "p"), (2, "", "", "p")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, part string").withColumn("keys", F.lit(1)).withColumn("data", F.lit("d"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(frame).collect())
    assert got == [(0, "no key", 6), (1, "a\x00b c\n\nx y", 10), (1, "a\x00b c\n\nx y", 10), (1, "other", 5), (2, "", 0)]


def test_words_and_stems_are_counted_in_one_read(spark, tmp_path):
    """two reads of a table in one large row group held its texts twice."""
    texts = [(1, "badly worded badge, badly!"), (0, "Bad weather and worded letters"), (1, "weatherproof ünïcode9 words"), (0, ""), (1, None)]
    spark.createDataFrame(texts, "y int, t string").write.parquet(str(tmp_path / "t"))
    counts = toxicity._counts(toxicity._tokens(spark.read.parquet(str(tmp_path / "t"))))
    expected = {}
    for y, t in texts:
        for w in set(re.findall(r"[^\W_]+", (t or "").lower())):
            for key in [(0, w), *((1, w[:n]) for n in range(4, 9) if len(w) > n)]:
                toxic, every = expected.get(key, (0, 0))
                expected[key] = toxic + y, every + 1
    assert {(r.stem, r.w): (r.toxic, r["all"]) for r in counts.collect()} == expected
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
