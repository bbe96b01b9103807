"""Queries over text spans, intervals, agreement and role repair, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import offsets as O
from colloquy.functions.scalar import macro_category
from colloquy.operators import agreement as A
from colloquy.operators import distributions as D
from colloquy.operators import intervals as I
from colloquy.operators import resampling as R
from colloquy.operators import sequences as S
from colloquy.operators import textjoins as J
from colloquy.plans.catalogue import CI, COUNTS, EMIT, JSD, ORACLE_SQL, SHARES, SIDES, SPANS, START, TRANS, _counts, _picks, query, r6
from colloquy.sources.tables import spans, table

CLAUSE = "[^.!?,\\n]+[.!?,]?"


def _cut(name: str, pattern: str, source: str = "conversations", key: str = "conv_id, turn") -> str:
    """SQL for the trimmed segments of a text with their offsets: ``key, i, s, e, text``."""
    blank = "' ' || chr(9) || chr(13) || chr(10)"
    return f"""{name}_m as (select {key}, text, regexp_extract_all(text, '({pattern})', 1) as m, string_split_regex(text, '{pattern}') as gap from {source}),
  {name}_u as (select {key}, text, m[i] as seg, i, coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(gap[1:i], lambda x: length(x))) as pos from {name}_m, lateral (select unnest(range(1, len(m) + 1)) as i)),
  {name} as (select {key}, text, i, (pos + length(seg) - length(ltrim(seg, {blank})))::int as s, (pos + length(seg) - length(ltrim(seg, {blank})) + length(trim(seg, {blank})))::int as e from {name}_u where trim(seg, {blank}) <> '')"""


@query(f"with {_cut('c', O.SENTENCE)} select conv_id, turn, s as start, e as \"end\", substr(text, s + 1, e - s) as sentence from c")
def sentence_split(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(O.sentences(F.col("text"))).alias("s"))
    return rows.select("conv_id", "turn", "s.start", "s.end", F.col("s.text").alias("sentence"))


VISIBLE = "length(regexp_replace(substr(text, 1, {}), '[ \\t\\r\\n]', '', 'g'))"


@query(f"""with {_cut('c', O.SENTENCE)}, {_cut('f', CLAUSE)},
  g as (select conv_id, turn, i = max(i) over (partition by conv_id, turn) as last, {VISIBLE.format('s')} as s, {VISIBLE.format('e')} as e from c),
  p as (select conv_id, turn, i = max(i) over (partition by conv_id, turn) as last, {VISIBLE.format('s')} as s, {VISIBLE.format('e')} as e from f),
  n as (select count(*) filter (where not g.last) as og, count(*) as spans, count(*) filter (where not g.last and exists (select 1 from p where p.conv_id = g.conv_id and p.turn = g.turn and p.e = g.e and not p.last)) as hits,
    count(*) filter (where exists (select 1 from p where p.conv_id = g.conv_id and p.turn = g.turn and p.e = g.e and p.s = g.s)) as exact from g),
  o as (select count(*) filter (where not last) as op, count(distinct (conv_id, turn)) as n from p), r as (select *, hits / greatest(op, 1) as pr, hits / greatest(og, 1) as re from n, o)
  select n, round(pr, 6) as precision, round(re, 6) as recall, round(2 * pr * re / nullif(pr + re, 0), 6) as f1, round(exact / spans, 6) as exact from r""")
def boundary_f1(spark, d):
    """Sentences against clauses."""
    t = F.col("text")
    rows = table(spark, d, "conversations").select(A.boundaries(t, O.sentences(t)).alias("g"), A.boundaries(t, O.trimmed(O.matches(t, CLAUSE))).alias("p"))
    return A.boundary_scores(rows, "g", "p").select("n", *r6("precision", "recall", "f1", "exact"))


@query("""with m as (select doc_id, text, regexp_extract_all(text, '([0-9]{3,})', 1) as m, string_split_regex(text, '[0-9]{3,}') as gap from documents),
  u as (select doc_id, length(text) // 2 as mid, coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(gap[1:i], lambda x: length(x))) as s, length(m[i]) as w from m, lateral (select unnest(range(1, len(m) + 1)) as i)),
  r as (select doc_id, count(*) as masked, sum(case when s + w <= mid then 5 - w else 0 end) as shift, max(case when s < mid and mid < s + w then s end) as inside from u group by 1)
  select doc_id, md5(regexp_replace(text, '[0-9]{3,}', '[NUM]', 'g')) as text_md5, coalesce(masked, 0)::int as masked, (coalesce(shift, 0) + coalesce(inside, length(text) // 2))::int as start, (coalesce(shift, 0) + coalesce(inside + 5, length(text) // 2))::int as "end" from documents left join r using (doc_id)""")
def mask_and_remap(spark, d):
    """Long numbers masked, and where the middle of the text lies then, as a span's start and as its end."""
    t, at = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    rows = table(spark, d, "documents").select("doc_id", "text", O.matches(t, "[0-9]{3,}").alias("m"))
    m = F.col("m")
    return rows.select("doc_id", F.md5(O.replaced(t, m, "[NUM]")).alias("text_md5"), F.size(m).alias("masked"), O.remapped(at, m, 5, False).alias("start"), O.remapped(at, m, 5, True).alias("end"))


IV = "iv as (select l_orderkey as k, l_linenumber as id, (l_linenumber * 6 + l_partkey % 9)::int as s, (l_linenumber * 6 + l_partkey % 9 + 1 + l_suppkey % 11)::int as e, l_returnflag as label, l_linestatus as source from lineitem)"


def _intervals(spark, d):
    start = F.col("l_linenumber") * 6 + F.col("l_partkey") % 9
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), start.cast("int").alias("start"), (start + 1 + F.col("l_suppkey") % 11).cast("int").alias("end"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("source"))


@query(f"""with recursive {IV}, o as (select *, row_number() over (partition by k order by s, e, label, source) as r from iv),
  f(k, r, island, s, e, label, source) as (select k, r, 1, s, e, label, source from o where r = 1
    union all select o.k, o.r, case when o.s < f.e then f.island else f.island + 1 end, case when o.s < f.e then f.s else o.s end, case when o.s < f.e then greatest(f.e, o.e) else o.e end,
      case when o.s < f.e and o.e - o.s <= f.e - f.s then f.label else o.label end, case when o.s >= f.e or f.source = o.source then o.source else 'both' end from f join o on o.k = f.k and o.r = f.r + 1)
  select k, s as start, e as "end", label, source from (select *, row_number() over (partition by k, island order by r desc) as z from f) where z = 1""")
def interval_merge(spark, d):
    return I.merged(_intervals(spark, d), "k")


@query(f"""with {IV}, p as (select a.k, a.id, b.id as right_id, least(a.e, b.e) - greatest(a.s, b.s) as overlap from iv a join iv b on a.k = b.k and a.id % 2 = 1 and b.id % 2 = 0 and a.s < b.e and b.s < a.e),
  t as (select *, row_number() over (partition by k, id order by overlap desc, right_id) as r, count(*) over (partition by k, id) as overlapping from p)
  select iv.k, iv.id, t.right_id, t.overlap, coalesce(t.overlapping, 0) as overlapping from iv left join t on t.k = iv.k and t.id = iv.id and r = 1 where iv.id % 2 = 1""")
def overlap_argmax_join(spark, d):
    rows = _intervals(spark, d)
    return I.best_overlap(rows.where("id % 2 = 1").select("k", "id", "start", "end"), rows.where("id % 2 = 0").select("k", "id", "start", "end"), "k")


SH = "(select {k}, w, len(w) as n from (select {k}, string_split_regex(trim(text), ' +') as w from {t})), lateral (select unnest(range(1, n - 3)) as i)"


@query(f"""with a as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as g from {SH.format(k='item_id', t='benchmark')}), b as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from {SH.format(k='doc_id', t='documents')}),
  na as (select item_id, count(*) as na from a group by 1), nb as (select doc_id, count(*) as nb from b group by 1), c as (select item_id, doc_id, count(*) as shared from a join b using (g) group by all),
  j as (select item_id, doc_id, round(shared / (na + nb - shared), 6) as jaccard from c join na using (item_id) join nb using (doc_id)), k as (select *, row_number() over (partition by item_id order by jaccard desc, doc_id) as place from j) select item_id, place::int as place, doc_id, jaccard from k where place <= 2""")
def shingle_jaccard_top2(spark, d):
    return J.jaccard_top(table(spark, d, "benchmark"), "item_id", table(spark, d, "documents"), "doc_id", 5, 2)


LN = f"{SPANS}, gp as (select * from (select conv, speaker, label as gold, lead(label) over (partition by conv order by ts, span) as pred, date_trunc('week', ts)::date as week from spans) where pred is not null)"
LADDER = [("exact", []), ("seen", [{"click", "view"}]), ("committed", [{"click", "view"}, {"purchase", "signup"}])]


def _next(spark, d):
    w = Window.partitionBy("conv").orderBy("ts", "span")
    return spans(spark, d).select("conv", "speaker", F.col("label").alias("gold"), F.lead("label").over(w).alias("pred"), F.date_trunc("week", "ts").cast("date").alias("week")).where("pred is not null")


@query(f"""{LN}, x as (select 'exact' as step, gold, pred from gp union all select 'seen', gold, case when gold in ('click', 'view') and pred in ('click', 'view') then gold else pred end from gp
    union all select 'committed', gold, case when (gold in ('click', 'view') and pred in ('click', 'view')) or (gold in ('purchase', 'signup') and pred in ('purchase', 'signup')) then gold else pred end from gp),
  n as (select step, count(*) as n, avg((gold = pred)::int) as po from x group by 1), e as (select step, sum(g * p) as gp from (select step, gold as l, count(*) as g from x group by all) join (select step, pred as l, count(*) as p from x group by all) using (step, l) group by 1)
  select step, n, round(po, 6) as agreement, round((po - gp / (n * n)) / nullif(1 - gp / (n * n), 0), 6) as kappa from n join e using (step)""")
def tolerant_ladder(spark, d):
    return A.tolerant_ladder(_next(spark, d), "gold", "pred", LADDER).select("step", "n", *r6("agreement", "kappa"))


@query(f"{LN}, s as (select conv, week, list(distinct gold) as g, min(pred) as p from gp group by all) select count(*) as units, round(avg(list_contains(g, p)::int), 6) as hit from s")
def lenient_hits(spark, d):
    return A.lenient_hits(_next(spark, d), ["conv", "week"], "gold", "pred").select("units", *r6("hit"))


@query(f"""{LN}, b as (select 'seen' as bucket, gold in ('click', 'view') as g, pred in ('click', 'view') as p from gp union all select 'committed', gold in ('purchase', 'signup'), pred in ('purchase', 'signup') from gp)
  select bucket, round(avg(g::int), 6) as share, round(count(*) filter (where g and p) / nullif(count(*) filter (where p), 0), 6) as precision, round(count(*) filter (where g and p) / nullif(count(*) filter (where g), 0), 6) as recall from b group by 1""")
def bucket_agreement(spark, d):
    return A.bucket_scores(_next(spark, d), "gold", "pred", {"seen": ["click", "view"], "committed": ["purchase", "signup"]}).select("bucket", *r6("share", "precision", "recall"))


@query("select case when starts_with(p_brand, 'Brand#11') then 'A' when starts_with(p_brand, 'Brand#1') then 'B' when starts_with(p_brand, 'Brand#2') then 'C' else 'Other' end as category, count(*) as n from part group by 1")
def macro_categories(spark, d):
    """The order of the prefixes decides."""
    c = macro_category(F.col("p_brand"), [("Brand#11", "A"), ("Brand#1", "B"), ("Brand#2", "C")], "Other")
    return table(spark, d, "part").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query(f"""{SPANS}, m as (select *, row_number() over (partition by conv order by ts, span) as i0 from spans), g as (select *, sum(case when label = 'signup' and i0 > 1 then 1 else 0 end) over (partition by conv order by ts, span) as segment, case when value > 50 then speaker end as signal from m),
  o as (select *, (row_number() over (partition by conv, segment order by ts, span) - 1) % 2 as odd from g), h as (select *, count(signal) over w as scored, count(*) filter (where signal = case when odd = 0 then 'Counsellor' else 'Client' end) over w as hits from o window w as (partition by conv, segment))
  select span, segment::bigint as segment, case when segment = 0 then 'Client' when (odd + case when scored - hits > hits then 1 else 0 end) % 2 = 0 then 'Counsellor' else 'Client' end as role from h""")
def role_parity_repair(spark, d):
    return S.repaired_roles(spans(spark, d), F.col("label") == "signup", F.when(F.col("value") > 50, F.col("speaker"))).select("span", "segment", "role")


@query(f"""with recursive s as (select user_id, event_type as sym, row_number() over (partition by user_id order by ts, event_id) as i from events),
  em(sym, e0, e1) as (values {', '.join(f"('{k}', ln({a}), ln({b}))" for k, (a, b) in EMIT.items())}),
  t(user_id, i, v0, v1) as (select user_id, i, ln(0.6) + e0, ln(0.4) + e1 from s join em using (sym) where i = 1
    union all select s.user_id, s.i, greatest(t.v0 + ln(0.7), t.v1 + ln(0.4)) + e0, greatest(t.v0 + ln(0.3), t.v1 + ln(0.6)) + e1 from t join s on s.user_id = t.user_id and s.i = t.i + 1 join em using (sym))
  select s.user_id, s.i::int as i, case when t.i is null then 1 when v0 >= v1 then 0 else 1 end::int as state from s left join t on t.user_id = s.user_id and t.i = s.i - 1""")
def hmm_prefix_state(spark, d):
    """The phase before each event, from the events before it."""
    seq = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("symbols"))
    states = seq.select("user_id", F.posexplode(S.viterbi_prefixes(F.col("symbols"), START, TRANS, EMIT, 1)).alias("i", "state"))
    return states.select("user_id", (F.col("i") + 1).alias("i"), "state")


@query(f"""{COUNTS}, ref as (select * from un where condition = 'c0'), h as (select conv, b, case when row_number() over (partition by b order by md5(b || '|' || conv || '|fdr'), conv) > floor(n / 2) then 0 else 1 end as side from ref, range(50) r(b)),
  pr as (select condition, conv, label as source, lead(label) over (partition by condition, conv order by ts, span) as target from spans where condition in ('c0', 'c1')), k as (select condition, conv, source, target, count(*) as k from pr where target is not null group by all),
  s as (select source, target, sum(case when condition = 'c1' then k else 0 end) as x, sum(case when condition = 'c0' then k else 0 end) as y from k group by all),
  c as (select source, target, x + y as n, coalesce(x / nullif(sum(x) over (partition by source), 0), 0) - coalesce(y / nullif(sum(y) over (partition by source), 0), 0) as delta from s),
  s2 as (select b, source, target, sum(case when side = 1 then k else 0 end) as x, sum(case when side = 0 then k else 0 end) as y from k join h using (conv) where condition = 'c0' group by all),
  c2 as (select b, source, target, coalesce(x / nullif(sum(x) over (partition by b, source), 0), 0) - coalesce(y / nullif(sum(y) over (partition by b, source), 0), 0) as nd from s2),
  e as (select c.*, r.b from c, range(50) r(b) where n >= 10 and source <> target), t as (select source, target, n, delta, (1 + count(*) filter (where round(abs(coalesce(nd, 0)), 9) >= round(abs(delta), 9))) / 51 as p from e left join c2 using (b, source, target) group by all),
  o as (select *, row_number() over (order by p, source || '>' || target) as i, count(*) over () as m from t)
  select source, target, n::bigint as n, round(delta, 6) as delta, round(p, 6) as p, i <= coalesce(max(case when p <= i / m * 0.1 then i end) over (), 0) as bh from o""")
def transition_fdr(spark, d):
    return S.transition_fdr(spans(spark, d), "c1", "c0", 50, "fdr").select("source", "target", "n", *r6("delta", "p"), "bh")


@query(ORACLE_SQL["transition_fdr"].replace("range(50)", "range(2000)").replace("/ 51 ", "/ 2001 "))
def transition_fdr_2000(spark, d):
    """With 2,000 replicates the smallest p is below what rank 1 of 20 cells needs; with 50 it is not."""
    return S.transition_fdr(spans(spark, d), "c1", "c0", 2000, "fdr").select("source", "target", "n", *r6("delta", "p"), "bh")


@query(f"""{COUNTS}, {_picks(100, 'pair')}, base as (select condition, b, label, k, w, case when condition = 'c0' then 0 else 1 end as side from pk join un using (condition, i) join cnt using (condition, conv) where condition in ('c0', 'c1')),
  x as (select 1 as src, b, label, side, k, w from base union all select 2, b, case when label = 'view' then 'click' else label end, side, k, w from base), s as (select src, b, label, {SIDES} from x group by all), t as ({SHARES % ('src, b', 'src, b')} s),
  j as (select src, b, {JSD} as j0 from t group by all), g as (select b, sum(case when src = 1 then j0 else -j0 end) as jsd from j group by 1) select {CI} from g""")
def paired_bootstrap(spark, d):
    """The same draws feed both label sources: labels as they are, and with two of them merged."""
    s = spans(spark, d).where("condition in ('c0', 'c1')")
    w = R.bootstrap(s, 100, "pair", "condition").join(_counts(spark, d, "condition", "conv"), ["condition", "conv"])
    merged = F.when(F.col("label") == "view", "click").otherwise(F.col("label"))
    both = w.withColumn("__x", F.explode(F.array(F.struct(F.lit(1).alias("src"), F.col("label").alias("l")), F.struct(F.lit(2).alias("src"), merged.alias("l"))))).withColumn("src", F.col("__x.src")).withColumn("label", F.col("__x.l"))
    j = R.weighted_jsd(both, F.when(F.col("condition") == "c0", 0).otherwise(1), F.col("weight"), "src", "b")
    g = j.groupBy("b").agg(F.sum(F.when(F.col("src") == 1, F.col("jsd")).otherwise(-F.col("jsd"))).alias("jsd"))
    return R.interval(g, "jsd").select(*r6("mean", "low", "p95", "high"))


@query(f"""{COUNTS}, {_picks(100, 'equal')}, cp as (select condition, conv, label, k / sum(k) over (partition by condition, conv) as k from cnt), x as (select b, label, case when condition = 'c0' then 0 else 1 end as side, k, w from pk join un using (condition, i) join cp using (condition, conv) where condition in ('c0', 'c1')),
  s as (select b, label, {SIDES} from x group by all), t as ({SHARES % ('b', 'b')} s), j as (select b, {JSD} as jsd from t group by all) select {CI} from j""")
def equal_weight_bootstrap(spark, d):
    """Every conversation counts alike, whatever its length."""
    s = spans(spark, d).where("condition in ('c0', 'c1')")
    shares = D.distribution(s, "condition", "conv").select("condition", "conv", "label", F.col("p").alias("k"))
    w = R.bootstrap(s, 100, "equal", "condition").join(shares, ["condition", "conv"])
    return R.interval(R.weighted_jsd(w, F.when(F.col("condition") == "c0", 0).otherwise(1), F.col("weight"), "b"), "jsd").select(*r6("mean", "low", "p95", "high"))


@query("""with e as (select quantile_cont(n_chars, 0.25) as a, quantile_cont(n_chars, 0.5) as b, quantile_cont(n_chars, 0.75) as c from documents), x as (select doc_id, lang, n_chars, case when n_chars <= a then 1 when n_chars <= b then 2 when n_chars <= c then 3 else 4 end as bin from documents, e where lang is not null),
  p as (select *, row_number() over (partition by lang, bin order by doc_id) - 1 as i, count(*) over (partition by lang, bin) as n from x), q as (select bin, count(*) as k from x where lang = 'en' group by 1),
  d as (select lang, bin, ('0x' || substr(md5(bin || '|' || j || '|length'), 1, 8))::bigint % n as i from (select distinct lang, bin, n from p) join q using (bin), lateral (select unnest(range(k)) as j))
  select lang, count(*) as n, round(avg(n_chars), 6) as mean from d join p using (lang, bin, i) group by 1""")
def length_matched_resample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    edges = docs.agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    rows = docs.where("lang is not null").join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda e: e < F.col("n_chars"))) + 1).drop("e")
    got = R.length_matched(rows, "lang", "en", "bin", "doc_id", "length")
    return got.groupBy("lang").agg(F.sum("weight").alias("n"), F.round(F.sum(F.col("n_chars") * F.col("weight")) / F.sum("weight"), 6).alias("mean"))
