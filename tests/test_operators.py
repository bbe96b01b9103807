"""Fixtures with results known from paper."""

import math

import pytest
from pyspark.sql import functions as F

from colloquy.functions.scalar import final_punctuation, words
from colloquy.operators import distributions as D
from colloquy.operators import sequences as S
from colloquy.operators import tests as H
from colloquy.operators import vectors as V


def dist(spark, rows):
    return D.distribution(spark.createDataFrame(rows, "condition string, label string"), "condition")


def test_equal_and_disjoint_distributions(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z")]
    got = {(r.a, r.b): r for r in D.distances(D.aligned(dist(spark, rows), ["a", "b", "c"]), "a", "b").collect()}
    assert got["a", "b"].jsd == 0
    assert got["a", "c"].jsd == pytest.approx(1) and got["a", "c"].l1 == pytest.approx(2) and got["a", "c"].tvd == pytest.approx(1)


def test_absent_condition_is_an_error(spark):
    with pytest.raises(Exception, match="no spans"):
        D.distances(D.aligned(dist(spark, [("a", "x")]), ["a", "b"]), "a", "b").collect()


def test_deciles_of_one_and_of_eleven_spans(spark):
    rows = spark.createDataFrame([("p", 0)] + [("q", i) for i in range(11)], "conv string, i int")
    got = {(r.conv, r.i): r.decile for r in D.deciles(rows, "conv", order=("i",)).collect()}
    assert got["p", 0] == 0 and [got["q", i] for i in range(11)] == [*range(10), 9]


def test_turns_drop_empty_runs_after_finding_them(spark):
    rows = [(0, "C", "a"), (1, "C", None), (2, "K", None), (3, "C", "b"), (4, "K", "c")]
    got = S.turns(spark.createDataFrame([("v", *r) for r in rows], "conv string, i int, speaker string, label string"), order=("i",)).orderBy("turn").collect()
    assert [(r.speaker, r.n, r.from_start, r.from_end) for r in got] == [("C", 1, 1, 2), ("C", 1, 2, 1), ("K", 1, 1, 1)]


def test_session_markers(spark):
    rows = spark.createDataFrame([("v", i, m) for i, m in enumerate("mxxmx")], "conv string, i int, m string")
    got = S.sessions(rows, F.col("m") == "m", order=("i",)).orderBy("i").collect()
    assert [r.segment for r in got] == [0, 0, 0, 1, 1]


def test_holm_and_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0.01, 1), (0.02, 2), (0.03, 3), (0.5, 4)], "p double, k int")
    got = H.adjusted(rows, "p", "k").orderBy("k").collect()
    assert [round(r.holm, 10) for r in got] == [0.04, 0.06, 0.06, 0.5] and [r.bh for r in got] == [True, True, True, False]


def test_kappa_is_null_when_chance_agreement_is_one(spark):
    assert H.kappa(spark.createDataFrame([("x", "x")] * 3, "g string, p string"), "g", "p").first().kappa is None


def test_ranks_average_ties(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    r = H.rank_sum(rows, "g", "a", "b", "v").first()
    assert r.u == 0.5 and r.delta == pytest.approx(-0.75)


def test_viterbi_equals_full_search(spark):
    start, trans, emit = [0.5, 0.5], [[0.8, 0.2], [0.3, 0.7]], {"x": [0.9, 0.2], "y": [0.1, 0.8]}
    seq = list("xyyx")
    best = max((math.log(start[s[0]] * emit["x"][s[0]]) + sum(math.log(trans[s[i - 1]][s[i]] * emit[seq[i]][s[i]]) for i in range(1, 4)), s[-1]) for s in ((a, b, c, d) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)))
    v = spark.createDataFrame([(seq,)], "s array<string>").select(S.viterbi(F.col("s"), start, trans, emit).alias("v")).first().v
    assert v.score == pytest.approx(best[0]) and v.state == best[1]


def test_baum_welch_equals_sums_over_paths(spark):
    import itertools

    import numpy as np

    seqs, k, m, rounds = [np.array(x) for x in ([0, 1, 1, 2], [2, 0], [1, 1, 0])], 2, 3, 4
    rng = np.random.default_rng(42)
    pi, a, b = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k)
    total = 0.0
    for turn in range(rounds + 1):
        n_pi, n_a, n_b, total, best = np.zeros(k), np.zeros((k, k)), np.zeros((k, m)), 0.0, []
        for x in seqs:
            paths = list(itertools.product(range(k), repeat=len(x)))
            p = [pi[s[0]] * math.prod(b[i, o] for i, o in zip(s, x)) * math.prod(a[i, j] for i, j in zip(s, s[1:])) for s in paths]
            best += paths[int(np.argmax(p))]
            total += math.log(sum(p))
            for s, w in zip(paths, p):
                n_pi[s[0]] += w / sum(p)
                for i, o in zip(s, x):
                    n_b[i, o] += w / sum(p)
                for i, j in zip(s, s[1:]):
                    n_a[i, j] += w / sum(p)
        if turn < rounds:
            pi, a, b = n_pi / n_pi.sum(), n_a / n_a.sum(axis=1, keepdims=True), n_b / n_b.sum(axis=1, keepdims=True)
    got = S._baum_welch(seqs, k, m, 42, rounds, -1.0)
    assert got[0] == pytest.approx(total, abs=1e-7) and all(np.allclose(x, y, atol=1e-7) for x, y in zip(got[1:], (pi, a, b)))
    rows = spark.createDataFrame([("g", c, [str(o) for o in x]) for c, x in enumerate(seqs)], "condition string, conv int, symbols array<string>")
    row = S.fit_hmm(rows, [2], restarts=1, iterations=rounds, tolerance=-1.0).first()
    assert row.log_likelihood == pytest.approx(total, abs=1e-7) and row.distinct_optima == 1
    assert row.min_occupancy == pytest.approx(min(best.count(i) for i in range(k)) / len(best)) and row.min_pairwise_tv == pytest.approx(np.abs(b[0] - b[1]).sum() / 2, abs=1e-7)


def test_one_transition_among_twenty_cells_can_pass(spark, monkeypatch):
    from colloquy.plans import texts

    # All labels follow each other alike in c0 and c1, but that a is followed by b far more often in c1.
    walk = [x for i in "abcde" for j in "abcde" if i != j for x in (i, j)] * 2
    rows = [(c, f"{c}{k}", 10 * k + i, i, x) for c in ("c0", "c1") for k in range(12) for i, x in enumerate(walk + ["a", "b"] * (40 if c == "c1" else 0))]
    monkeypatch.setattr(texts, "spans", lambda *_: spark.createDataFrame(rows, "condition string, conv string, span int, ts int, label string"))
    got = texts.transition_fdr_2000(spark, "").collect()
    assert min(r.p for r in got) <= 0.1 / 20 and any(r.bh for r in got)


def test_model_selection_is_registered_whole(spark, monkeypatch):
    from colloquy.plans import catalogue

    asked = []
    monkeypatch.setattr(catalogue.S, "fit_hmm", lambda s, states, **more: asked.append((states, more)))
    catalogue.QUERIES["hmm_model_selection"](spark, "/root/testdata/sf0.001")
    assert asked == [([2, 3, 4, 5, 6, 7, 8], {"restarts": 20, "iterations": 500, "tolerance": 1e-4})]


def test_words_and_final_punctuation(spark):
    rows = spark.createDataFrame([("",), ("  ",), ("a b",), ('He said "x."',), ("no",)], "t string")
    got = rows.select(words(F.col("t")).alias("w"), final_punctuation(F.col("t")).alias("f")).collect()
    assert [r.w for r in got] == [0, 0, 2, 3, 1] and [r.f for r in got] == [False, False, False, True, False]


def test_conversation_keys_need_the_file(spark, tmp_path):
    from colloquy.sources.tables import conversation_exports

    message = '{"author": "u", "message_number": 1, "content": "hi"}'
    (tmp_path / "a.json").write_text(f'[{{"id": "1", "learn_counselling_messages": [{message}]}}]')
    (tmp_path / "b.json").write_text(f'{{"data": [{{"id": "1", "learn_counselling_messages": [{message}, {message}]}}]}}')
    got = conversation_exports(spark, str(tmp_path)).groupBy("conv_key").count().collect()
    assert {(r.conv_key, r["count"]) for r in got} == {("a.json::1", 1), ("b.json::1", 2)}


def test_silhouette_of_lone_zero_and_null_vectors(spark):
    rows = [(0, "p", [1.0, 0.0]), (1, "p", [2.0, 0.0]), (2, "q", [0.0, 1.0]), (3, "q", [0.0, 0.0]), (4, "q", None), (5, None, [1.0, 0.0])]
    got = V.silhouette(spark.createDataFrame(rows, "i int, g string, v array<double>"), "g", "v").collect()
    assert {r.i: r.silhouette for r in got} == {0: 1.0, 1: 1.0, 2: 0.0}


def test_spans_are_anchored_replaced_and_remapped(spark):
    from colloquy.functions import offsets as O

    rows = spark.createDataFrame([("Hi. Hi 😀! x",), ("",), (None,), ("...",), (" a \n b ",)], "text string")
    got = [r[0] and [(s["start"], s["end"], s["text"]) for s in r[0]] for r in rows.select(O.sentences(F.col("text"))).collect()]
    assert got == [[(0, 3, "Hi."), (4, 9, "Hi 😀!"), (10, 11, "x")], [], None, [], [(1, 2, "a"), (5, 6, "b")]]
    one = spark.createDataFrame([("call 12345 now 678",)], "text string").select("text", O.matches(F.col("text"), "[0-9]{3,}").alias("m"))
    m = F.col("m")
    row = one.select(O.replaced(F.col("text"), m, "[NUM]"), O.remapped(F.lit(7), m, 5, False), O.remapped(F.lit(7), m, 5, True), O.remapped(F.lit(16), m, 5, True)).first()
    assert tuple(row) == ("call [NUM] now [NUM]", 5, 10, 20)


def test_merged_intervals_keep_the_longer_label(spark):
    from colloquy.operators import intervals as I

    rows = [(1, 0, 5, "a", "x"), (1, 3, 12, "b", "y"), (1, 12, 14, "c", "x"), (2, 0, 1, "d", "x"), (2, 0, 1, "d", "x")]
    got = I.merged(spark.createDataFrame(rows, "k int, start int, end int, label string, source string"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 12, "b", "both"), (1, 12, 14, "c", "x"), (2, 0, 1, "d", "x")]


def test_text_columns(spark):
    from colloquy.functions import scalar as C

    row = spark.createDataFrame([("Größe, ÄPFEL!", "Anna: \"Hallo\"", "Therapist 10:02\nja", "2024-03-01", " Client ", 6)], "a string, b string, c string, d string, e string, f int")
    got = row.select(C.plain_key(F.col("a")), C.unquoted(F.col("b"), "Anna"), C.without_headers(F.col("c"), ["Therapist"]), F.date_format(C.timestamp_of(F.col("d")), "yyyy-MM"), C.role(F.col("e"), ["client"]), C.role(F.lit(None).cast("string"), ["client"]), C.pomp(F.col("f")), C.pomp(F.lit(1)), C.first_sentence(F.lit("One two. Three"), 5)).first()
    assert tuple(got) == ("groesse aepfel", "Hallo", "ja", "2024-03", "Client", "Counsellor", None, 100.0, "One…")


def test_contained_texts_must_be_unique(spark):
    from colloquy.operators import textjoins as J

    left = spark.createDataFrame([(1, 1, "ab"), (1, 2, "b"), (1, 3, ""), (1, 4, "zz")], "k int, id int, text string")
    right = spark.createDataFrame([(1, 10, "xaby"), (1, 11, "b")], "k int, id int, text string")
    assert [tuple(r) for r in J.contained(left, right, "k").collect()] == [(1, 1, 10)]


def test_p_values_against_known_ones(spark):
    """Values from published tables of the distributions."""
    from colloquy.operators import pvalues as P

    one = spark.range(1)
    got = one.select(P.normal_p(F.lit(1.959964)).alias("z"), P.student_p(F.lit(2.228139), F.lit(10)).alias("even"), P.student_p(F.lit(3.182446), F.lit(3)).alias("odd"), P.student_p(F.lit(12.7062), F.lit(1)).alias("one"), P.t_quantile(1.959963984540054, F.lit(30.0)).alias("q")).first()
    assert all(abs(got[k] - 0.05) < 1e-5 for k in ("z", "even", "odd", "one")) and abs(got.q - 2.042272) < 1e-4
    tea = spark.createDataFrame([(1, 3, 1, 1, 3), (2, 8, 2, 1, 5), (3, 0, 4, 0, 4)], "k int, a long, b long, c long, d long")
    p = {r.k: r.p for r in P.fisher(tea, "a", "b", "c", "d", "k").collect()}
    assert abs(p[1] - 0.4857142857) < 1e-9 and abs(p[2] - 0.0349650) < 1e-6 and p[3] == 1


def test_running_order_over_many_ranges(spark):
    from colloquy.operators import ordering as O

    rows = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "x int, y int").repartition(7)
    assert sorted((r.x, r.nth) for r in O.numbered(rows, "x").collect()) == [(k, k) for k in range(101)]
    assert O.numbered(rows.limit(0), "x").count() == 0
    assert sorted(r.x for r in O.shard(rows, 2, 10, "x").collect()) == list(range(2, 101, 10))
    assert [r.x for r in O.sliced(rows, ["x"], 5, 10, 3).collect()] == [5, 6, 7]


def test_asserted_lookup_fails_on_a_missing_entry(spark):
    from colloquy.operators import reshape

    rows, entries = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert reshape.asserted_lookup(rows.where("k = 1"), entries, ["k"], "v").collect()[0].v == "a"
    with pytest.raises(Exception, match="no v for 2"):
        reshape.asserted_lookup(rows, entries, ["k"], "v").collect()


def test_best_path_equals_enumeration():
    import itertools

    import numpy as np

    from colloquy.operators.phases import _best_path

    start, trans, emit = np.log([0.6, 0.4]), np.log([[0.7, 0.3], [0.4, 0.6]]), {"a": np.log([0.5, 0.1]), "b": np.log([0.5, 0.9])}
    for word in itertools.product("ab", repeat=5):
        def score(path):
            return start[path[0]] + sum(emit[s][q] for s, q in zip(word, path)) + sum(trans[p, q] for p, q in zip(path, path[1:]))

        best = _best_path(list(word), start, trans, emit)
        assert abs(score(best) - max(score(p) for p in itertools.product((0, 1), repeat=5))) < 1e-9
    assert _best_path([], start, trans, emit) == []


def test_masking(spark):
    from colloquy.operators import masking as M

    rows = spark.createDataFrame([(1, "Anna met Ann. Annabel", "met  Ann."), (2, None, "x"), (3, "", "")], "c int, t string, n string")
    got = {r.c: r.s for r in rows.select("c", M.tolerant_span(F.col("t"), F.col("n")).alias("s")).collect()}
    assert (got[1].start, got[1].end) == (5, 13) and got[2] is None and got[3] is None
    seeds = spark.createDataFrame([(1, "Ann"), (1, "Anna")], "c int, name string")
    masked = {r.c: (r.t, r.n_masked) for r in M.masked_consistently(rows, seeds, "c", "[X]", "t").collect()}
    assert masked == {1: ("[X] met [X]. Annabel", 2), 2: (None, 0), 3: ("", 0)}
    with pytest.raises(Exception, match="occurs 2 times"):
        spark.createDataFrame([("{a} {a}",)], "t string").select(M.spliced(F.col("t"), "{a}", F.lit("x"))).collect()


def test_sinks_resume_and_guard(spark, tmp_path):
    from colloquy.sources import files, sinks

    rows, path = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "k int, t string"), str(tmp_path / "out")
    for most in (2, 5, 5):
        sinks.resumable_append(rows.where(F.col("k") < most), path, ["k"])
    assert sorted(r.k for r in files.jsonl(spark, path, "k int, t string").collect()) == [0, 1, 2, 3, 4]
    guarded = str(tmp_path / "table")
    for n in (1, 3):
        sinks.guarded_rewrite(rows.limit(n), guarded, primary=True)
    assert spark.read.parquet(sinks.current(spark, guarded)).count() == 3
    with pytest.raises(ValueError):
        sinks.guarded_rewrite(rows, guarded, primary=False)


def test_fuzzy_clusters_and_alignment(spark):
    from colloquy.operators import textjoins as T

    rows = spark.createDataFrame([("s", 1, "the cat sat on the mat"), ("s", 2, "the cat sat on a mat"), ("s", 3, "nothing like it"), ("s", 4, "the cat sat on the mat"), ("r", 5, None)], "s string, k long, t string")
    assert {r.k: r.representative for r in T.fuzzy_clusters(rows, "s", "k", "t", 0.85).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    line = lambda ws: spark.createDataFrame([(1, k, w) for k, w in enumerate(ws)], "p long, k long, t string")
    assert sorted(tuple(r) for r in T.aligned_lines(line("abcd"), line("xbcy"), "p", "k", "t").collect()) == [(1, 1, 1), (1, 2, 2)]


def test_workbook_with_shared_strings_and_gaps(spark, tmp_path):
    """Shared and rich strings, cells that are left out, and a workbook without the sheet."""
    import zipfile

    from colloquy.sources import office

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    for file, sheet in (("a", "S"), ("b", "T")):
        with zipfile.ZipFile(tmp_path / f"{file}.xlsx", "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {ns} {link}><sheets><sheet name="{sheet}" r:id="r7"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r7" Target="/xl/worksheets/x.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>CASE</t></si><si><r><t>no</t></r><r><t>te</t></r><rPh><t>-</t></rPh></si></sst>")
            z.writestr("xl/worksheets/x.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c r="A2"><v>3</v></c><c r="AB2"><v>4.5</v></c></row><row/><row><c r="AB4" t="str"><v>x</v></c></row></sheetData></worksheet>')
    got = office.sheet(spark, str(tmp_path), "S", ["CASE", "note", "none"], "CASE").collect()
    assert [(r.place, r.CASE, r.note, r.none) for r in got] == [(0, "3", "4.5", None), (2, None, "x", None)]
    with pytest.raises(Exception, match="unlike declared"):
        office.sheet(spark, str(tmp_path), "S", ["CASE"], "CASE", labelled=True).collect()


def test_means_of_the_same_values_tie(spark):
    """F6, F7, F8: values summed in another order differ in the last bit, and so in rank."""
    from colloquy.functions.scalar import mean

    values = [0.1, 0.7, 0.3, 1e9, 0.2]
    rows = [(k, v) for k, order in enumerate([values, values[::-1], sorted(values)]) for v in order]
    df = spark.createDataFrame([*rows, (3, None)], "k int, v double").coalesce(1)
    got = {r.k: r.m for r in df.groupBy("k").agg(mean("v").alias("m")).collect()}
    assert got[0] == got[1] == got[2] == pytest.approx(sum(values) / 5) and got[3] is None


def test_queries_on_means_see_ties(spark, monkeypatch):
    from colloquy.plans import statistics

    # The same conversations in both conditions, their values in another order.
    values = lambda k: [0.1 * k, 0.7, 0.3 * k, 1e6, 0.2]
    rows = [(c, f"{c}{k}", v) for k in range(40) for c, order in (("c0", 1), ("c1", -1)) for v in values(k)[::order]]
    monkeypatch.setattr(statistics, "spans", lambda *_: spark.createDataFrame(rows, "condition string, conv string, value double").coalesce(1))
    got = statistics.mann_whitney(spark, "").first()
    assert (got.u, got.p) == (800.0, 1.0) and statistics.kruskal_p(spark, "").first().h == 0


def test_json_arrays_of_all_partitions_are_read_back(spark, tmp_path):
    """two arrays in one file, of which a reader takes the first alone."""
    from colloquy.sources import files, sinks

    rows = spark.range(100, numPartitions=20)
    path = sinks.json_arrays(rows, str(tmp_path / "arrays"))
    assert sorted(r.id for r in files.master_json(spark, path, "id long").collect()) == list(range(100))
    assert files.master_json(spark, sinks.json_arrays(rows.where("id < 0"), str(tmp_path / "none")), "id long").count() == 0


def test_outer_blanks_belong_to_a_tolerant_span(spark):
    """the blank that a needle ends with was left out of the span."""
    from colloquy.operators import masking as M

    rows = [("ab cd ef", "ab cd "), ("ab  cd  ef", "ab\n cd "), ("\n x y", "\nx"), ("a b", "b "), ("a  \n b", " \n "), ("a", " "), ("a b", "a b"), ("a b", ""), (None, "a")]
    got = spark.createDataFrame(rows, "t string, n string").select(M.tolerant_span(F.col("t"), F.col("n")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in got] == [(0, 6), (0, 7), (1, 3), None, (1, 4), None, (0, 3), None, None]


@pytest.mark.parametrize("text", ["Hello you. Bye", "One two t later", "Nine car  later", "Ten  cars  now", "\nstart of a text", "abcdefghi \n", "two  blanks  at", "ab cd efg hij", "no\u00a0break \u00a0x"])
def test_tolerant_locate_equals_its_sql_on_odd_blanks(spark, monkeypatch, text):
    import duckdb

    from colloquy.plans import catalogue, models

    rows = spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string")
    monkeypatch.setattr(models, "table", lambda *_: rows)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, text varchar)")
    con.execute("insert into conversations values (1, 0, ?)", [text])
    assert [tuple(r) for r in models.tolerant_locate(spark, "").collect()] == con.execute(catalogue.ORACLE_SQL["tolerant_locate"]).fetchall()


def test_sums_of_halves_equal_the_join_without_its_rows(spark):
    """a row for each unit, replicate and cell does not fit at size."""
    from colloquy.operators import resampling as R

    spans = spark.createDataFrame([(f"u{k}", "abc"[k % 3 * (j % 2)]) for k in range(31) for j in range(k)] + [("alone", None)], "conv string, label string")
    counts = spans.where("label is not null").groupBy("conv", "label").agg(F.count("*").alias("k"))
    got = R.half_counts(spans, counts, 120, "x", "label")
    want = R.halves(spans, 120, "x").join(counts, "conv").groupBy("b", "half", "label").agg(F.sum("k").alias("k"))
    rows = lambda df: sorted((r.b, r.half, r.label, r.k) for r in df.collect())
    assert rows(got) == rows(want)


def test_no_query_of_halves_makes_a_row_for_each_unit_and_replicate(spark):
    from colloquy.plans import statistics, texts

    for f in (statistics.band_percentile, texts.transition_fdr_2000):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan


def _greedy(texts, least):
    import difflib

    out = []
    for k, t in enumerate(texts):
        out.append(next((p for p in range(k) if out[p] == p and difflib.SequenceMatcher(None, texts[p], t, autojunk=False).ratio() >= least), k))
    return out


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 1.0])
def test_representatives_equal_a_plain_greedy_pass(least):
    import random

    from colloquy.operators import textjoins as T

    draw = random.Random(3)
    base = ["".join(draw.choices("etaoin shrdlu", k=draw.randint(0, 40))) for _ in range(40)]
    edit = lambda t: "".join(draw.choice([c, c, c, c, c, c, "", c + "x", "é"]) for c in t)
    wide = ["".join(chr(0x4E00 + draw.randint(0, 300)) for _ in range(30)) for _ in range(5)]
    texts = list(dict.fromkeys([*base, *map(edit, base * 3), *wide, *map(edit, wide), "", "aaaa" * 60, "aaaa" * 55 + "b"]))
    draw.shuffle(texts)
    want = _greedy(texts, least)
    assert T._represented(texts, least) == want and T._represented(texts, least, block=7, chunk=9) == want


def test_few_pairs_of_fuzzy_clusters_are_compared_as_sequences(monkeypatch):
    """the number of comparisons that are not in one product."""
    import random

    from colloquy.operators import textjoins as T

    draw, made = random.Random(5), []
    ratio = T.difflib.SequenceMatcher.ratio
    monkeypatch.setattr(T.difflib.SequenceMatcher, "ratio", lambda self: made.append(1) or ratio(self))
    texts = ["".join(draw.choices("etaoinshrdlucmfw ", k=60)) for _ in range(600)]
    assert T._represented(texts, 0.85) == list(range(600)) and len(made) < 60


def test_fits_are_dealt_out_to_many_tasks(spark):
    """their rows are few, so that adaptive execution put them into few tasks."""
    rows = spark.createDataFrame([("g", c, ["a", "b", "a", "a"]) for c in range(3)], "condition string, conv int, symbols array<string>")
    fitted = S.fit_hmm(rows, [2, 3], restarts=4, iterations=2)
    assert "REPARTITION_BY_NUM" in fitted._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in fitted.collect()) == [2, 3]


def test_equal_conversations_are_fitted_once_with_a_weight(spark):
    """copies of conversations made every round of every fit as much longer."""
    import numpy as np

    draw = np.random.default_rng(3)
    seqs = [draw.integers(0, 3, n) for n in (9, 9, 7, 6, 5, 2)]
    copies = [x for i, x in enumerate(seqs) for _ in range(i + 1)]
    whole, once = S._parts(copies), S._parts(seqs, list(range(1, 7)))
    assert sum(len(x) for x in once[0].x) == sum(map(len, seqs))
    plain, side = S._fits(whole, 2, 3, [42], 20, 1e-4)[0], S._fits(once, 2, 3, [41, 42, 43], 20, 1e-4)[1]
    assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(plain, side))
    assert np.allclose(whole[0].occupancy(*plain[1:]), once[0].occupancy(*side[1:]))
    rows = [("g", c, [str(o) for o in x]) for c, x in enumerate(copies)] + [("g", 99, ["7"]), ("short", 100, ["1"])]
    frame = spark.createDataFrame(rows, "condition string, conv int, symbols array<string>")
    got = {r.k: r for r in S.fit_hmm(frame, [2, 3], restarts=7, iterations=20, tolerance=1e-4).collect()}
    best = [max(S._baum_welch(copies, k, 3, 42 + r, 20, 1e-4)[0] for r in range(7)) for k in (2, 3)]
    assert sorted(got) == [2, 3] and [got[2].log_likelihood, got[3].log_likelihood] == pytest.approx(best, abs=1e-7)
    assert got[2].bic == pytest.approx(got[2].n_params * np.log(sum(map(len, copies))) - 2 * got[2].log_likelihood)
    # Parts of PART sequences add up.
    many = [draw.integers(0, 3, n) for n in draw.integers(2, 9, 1500)]
    assert len(S._parts(many)) == 2 and np.allclose(S._baum_welch(many, 2, 3, 1, 3, 0)[2], S._fits([S._Steps(many)], 2, 3, [1], 3, 0)[0][2])
