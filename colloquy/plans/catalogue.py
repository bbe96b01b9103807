"""All registered queries of the library, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.scalar import bucket, draw, final_punctuation, hash_order, tier, words
from colloquy.operators import distributions as D
from colloquy.operators import resampling as R
from colloquy.operators import sequences as S
from colloquy.operators import tests as H
from colloquy.operators import vectors as V
from colloquy.sources.tables import spans, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CONDITIONS = ["c0", "c1", "c2"]

SPANS = """with spans as (select 'c' || (user_id % 3) as condition, user_id as conv,
  case when event_id % 2 = 0 then 'Client' else 'Counsellor' end as speaker, event_id as span, ts, event_type as label, value from events)"""
DIST = f"""{SPANS}, d0 as (select condition, speaker, label, count(*) as n from spans group by all),
  dist as (select *, sum(n) over (partition by condition, speaker)::bigint as total, n / sum(n) over (partition by condition, speaker) as p from d0)"""
PAIRS = f"""{DIST}, conds(c) as (values ('c0'), ('c1'), ('c2')), prs as (select x.c as a, y.c as b from conds x, conds y where x.c < y.c),
  al as (select prs.a, prs.b, speaker, label, sum(case when condition = prs.a then p else 0 end) as p, sum(case when condition = prs.b then p else 0 end) as q,
    sum(case when condition = prs.a then n else 0 end) as na, sum(case when condition = prs.b then n else 0 end) as nb
    from dist join prs on condition in (prs.a, prs.b) group by all)"""
KL = "0.5 * sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + 0.5 * sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)"
JSD = f"sqrt(greatest({KL}, 0))"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _dist(spark: SparkSession, d: str) -> DataFrame:
    return D.distribution(spans(spark, d), "condition", "speaker")


def _aligned(spark: SparkSession, d: str, value: str = "p") -> DataFrame:
    return D.aligned(_dist(spark, d), CONDITIONS, "speaker", value=value)


@query(f"{DIST} select condition, speaker, label, n, total, round(p, 6) as p from dist")
def label_distribution(spark, d):
    return _dist(spark, d).select("condition", "speaker", "label", "n", "total", *r6("p"))


@query(f"""{SPANS}, o as (select *, row_number() over (partition by condition, conv, speaker order by ts, span) - 1 as i, count(*) over (partition by condition, conv, speaker) as n from spans),
  e as (select condition, speaker, label, least(floor(case when n <= 1 then 0 else i / (n - 1) end * 10), 9)::int as decile from o)
  select condition, speaker, decile, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by condition, speaker, decile), 6) as p from e group by condition, speaker, decile, label""")
def temporal_decile_distribution(spark, d):
    rows = D.deciles(spans(spark, d), "condition", "conv", "speaker")
    return D.distribution(rows, "condition", "speaker", "decile").select("condition", "speaker", "decile", "label", "n", *r6("p"))


@query(f"{SPANS} select condition, conv, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by condition, conv), 6) as p from spans group by condition, conv, label")
def conv_distribution(spark, d):
    return D.distribution(spans(spark, d), "condition", "conv").select("condition", "conv", "label", "n", *r6("p"))


@query(f"""{SPANS}, cd as (select condition, conv, label, count(*) / sum(count(*)) over (partition by condition, conv) as p from spans group by condition, conv, label),
  w as (select condition, label, count(*) / sum(count(*)) over (partition by condition) as p from spans group by condition, label),
  u as (select condition, label, sum(p) / any_value(nc) as q from cd join (select condition, count(distinct conv) as nc from spans group by 1) using (condition) group by all)
  select condition, round({JSD}, 6) as jsd from w join u using (condition, label) group by 1""")
def weighted_vs_unweighted(spark, d):
    s = spans(spark, d)
    pooled = D.distribution(s, "condition").select("condition", "label", "p")
    mean = D.mean_distribution(D.distribution(s, "condition", "conv"), "condition", "conv").withColumnRenamed("p", "q")
    return D.distances(pooled.join(mean, ["condition", "label"]), "condition").select("condition", *r6("jsd"))


@query(f"{PAIRS} select a, b, speaker, round({JSD}, 6) as jsd from al group by all")
def jsd_pairwise(spark, d):
    return D.distances(_aligned(spark, d), "a", "b", "speaker").select("a", "b", "speaker", *r6("jsd"))


@query(f"{PAIRS} select a, b, speaker, round(sum(abs(p - q)), 6) as l1, round(sqrt(sum((p - q) * (p - q))), 6) as l2 from al group by all")
def l1_l2_pairwise(spark, d):
    return D.distances(_aligned(spark, d), "a", "b", "speaker").select("a", "b", "speaker", *r6("l1", "l2"))


@query(f"{PAIRS} select a, b, speaker, round(sum(abs(p - q)) / 2, 6) as tvd from al group by all")
def tvd_pairwise(spark, d):
    return D.distances(_aligned(spark, d), "a", "b", "speaker").select("a", "b", "speaker", *r6("tvd"))


@query(f"{PAIRS} select a, b, speaker, label, round(p - q, 6) as diff, round(2 * asin(sqrt(p)) - 2 * asin(sqrt(q)), 6) as h from al")
def cohen_h_effects(spark, d):
    return D.effects(_aligned(spark, d)).select("a", "b", "speaker", "label", *r6("diff", "h"))


@query(f"""{PAIRS}, m as (select *, sum(na) over w as sa, sum(nb) over w as sb, na + nb as nn from al window w as (partition by a, b, speaker))
  select a, b, speaker, count(*) as k, round(sqrt(sum(pow(na - nn * sa / (sa + sb), 2) / (nn * sa / (sa + sb)) + pow(nb - nn * sb / (sa + sb), 2) / (nn * sb / (sa + sb))) / any_value(sa + sb)), 6) as v from m group by all""")
def cramers_v(spark, d):
    return D.cramers_v(_aligned(spark, d, "n"), "a", "b", "speaker").select("a", "b", "speaker", "k", *r6("v"))


@query(f"""{PAIRS} select a, b, speaker, label, round(0.5 * case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + 0.5 * case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end, 6) as bits from al""")
def jsd_label_bits(spark, d):
    return D.effects(_aligned(spark, d)).select("a", "b", "speaker", "label", *r6("bits"))


@query(f"{PAIRS}, j as (select a, b, speaker, {JSD} as jsd from al group by all) select speaker, round(sum(case when b = 'c2' then jsd end) - sum(case when b = 'c1' then jsd end), 6) as gap from j where a = 'c0' group by 1")
def proximity_gap(spark, d):
    j = D.distances(D.aligned(_dist(spark, d), CONDITIONS, "speaker", pairs=[("c0", "c1"), ("c0", "c2")]), "a", "b", "speaker")
    side = lambda b: F.sum(F.when(F.col("b") == b, F.col("jsd")))
    return j.groupBy("speaker").agg(F.round(side("c2") - side("c1"), 6).alias("gap"))


@query(f"""{SPANS}, x as (select *, date_trunc('week', ts)::date as week from spans where condition in ('c0', 'c1')),
  n as (select condition, week, label, count(*) as n from x group by all), t as (select condition, week, sum(n) as t from n group by all),
  ok as (select week from t group by 1 having count(*) = 2 and min(t) >= 20),
  al as (select week, label, sum(case when condition = 'c0' then n / t else 0 end) as p, sum(case when condition = 'c1' then n / t else 0 end) as q from n join t using (condition, week) join ok using (week) group by all)
  select week, round({JSD}, 6) as jsd from al group by 1""")
def weekly_realness(spark, d):
    s = spans(spark, d).withColumn("week", F.date_trunc("week", "ts").cast("date")).where("condition in ('c0', 'c1')")
    dist = D.distribution(s, "condition", "week")
    enough = dist.groupBy("week", "condition").agg(F.max("total").alias("t")).groupBy("week").agg(F.count("*").alias("k"), F.min("t").alias("t")).where("k = 2 and t >= 20").select("week")
    return D.distances(D.aligned(dist.join(enough, "week", "left_semi"), ["c0", "c1"], "week"), "week").select("week", *r6("jsd"))


@query(f"""{SPANS}, cd as (select condition, conv, label, count(*) / sum(count(*)) over (partition by condition, conv) as p from spans group by condition, conv, label),
  nc as (select condition, count(distinct conv) as nc from spans group by 1),
  u as (select condition, label, sum(p) / any_value(nc) as q from cd join nc using (condition) group by all),
  g as (select condition, conv, u.label, coalesce(cd.p, 0) as p, q from (select distinct condition, conv from cd) k join u using (condition) left join cd using (condition, conv, label)),
  j as (select condition, conv, {JSD} as jsd from g group by all)
  select condition, round(quantile_cont(jsd, 0.5), 6) as median, round(quantile_cont(jsd, 0.25), 6) as q1, round(quantile_cont(jsd, 0.75), 6) as q3 from j group by 1""")
def within_condition_jsd(spark, d):
    cd = D.distribution(spans(spark, d), "condition", "conv").select("condition", "conv", "label", "p")
    mean = D.mean_distribution(cd, "condition", "conv").withColumnRenamed("p", "q")
    full = cd.select("condition", "conv").distinct().join(mean, "condition").join(cd, ["condition", "conv", "label"], "left").fillna(0.0, ["p"])
    j = D.distances(full, "condition", "conv")
    at = lambda q, n: F.round(F.percentile("jsd", F.lit(q)), 6).alias(n)
    return j.groupBy("condition").agg(at(0.5, "median"), at(0.25, "q1"), at(0.75, "q3"))


@query(f"""{SPANS}, l as (select distinct label as left_out from spans), n as (select left_out, condition, label, count(*) as n from spans, l where label <> left_out and condition in ('c0', 'c1') group by all),
  s as (select *, n / sum(n) over (partition by left_out, condition) as p0 from n), al as (select left_out, label, sum(case when condition = 'c0' then p0 else 0 end) as p, sum(case when condition = 'c1' then p0 else 0 end) as q from s group by all)
  select left_out, round({JSD}, 6) as jsd from al group by 1""")
def leave_one_out(spark, d):
    counts = D.distribution(spans(spark, d).where("condition in ('c0', 'c1')"), "condition").select("condition", "label", "n")
    labels = counts.select(F.col("label").alias("left_out")).distinct()
    kept = counts.join(labels, F.col("label") != F.col("left_out"))
    kept = kept.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("left_out", "condition")))
    return D.distances(D.aligned(kept, ["c0", "c1"], "left_out"), "left_out").select("left_out", *r6("jsd"))


@query(f"{PAIRS}, k as (select *, row_number() over (partition by a, b, speaker order by round(abs(p - q), 9) desc, label) as r from al) select a, b, speaker, label, round(p - q, 6) as diff from k where r <= 2")
def label_shift_topk(spark, d):
    w = Window.partitionBy("a", "b", "speaker").orderBy(F.desc(F.round(F.abs("diff"), 9)), "label")
    return D.effects(_aligned(spark, d)).withColumn("r", F.row_number().over(w)).where("r <= 2").select("a", "b", "speaker", "label", *r6("diff"))


@query(f"{SPANS}, cd as (select conv, label, count(*) / sum(count(*)) over (partition by conv) as p from spans group by conv, label) select conv, round(-sum(p * log2(p)), 6) as entropy, round(max(p), 6) as top_share from cd group by 1")
def entropy_by_conv(spark, d):
    return D.entropy(D.distribution(spans(spark, d), "conv"), "conv").select("conv", *r6("entropy", "top_share"))


@query(f"""{SPANS} select conv, count(*) as n, count(distinct label) as labels, round(count(*) filter (where speaker = 'Client') / count(*), 6) as client_share from spans group by 1
  having count(*) filter (where speaker = 'Client') >= 8 and count(*) filter (where speaker = 'Counsellor') >= 8""")
def conv_metrics_minsupport(spark, d):
    c = F.count_if(F.col("speaker") == "Client")
    got = spans(spark, d).groupBy("conv").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.round(c / F.count("*"), 6).alias("client_share"), c.alias("c"))
    return got.where("c >= 8 and n - c >= 8").drop("c")


@query(f"""{SPANS}, f as (select condition, conv, bool_or(label = 'purchase') as buys, bool_or(label = 'error') as errs, bool_or(label = 'signup') as signs from spans group by all)
  select condition, count(*) as convs, round(avg(buys::int), 6) as buys, round(avg(errs::int), 6) as errs, round(avg(signs::int), 6) as signs from f group by 1""")
def signature_shares(spark, d):
    any_of = lambda x: F.bool_or(F.col("label") == x).cast("int")
    f = spans(spark, d).groupBy("condition", "conv").agg(any_of("purchase").alias("buys"), any_of("error").alias("errs"), any_of("signup").alias("signs"))
    return f.groupBy("condition").agg(F.count("*").alias("convs"), *[F.round(F.avg(c), 6).alias(c) for c in ("buys", "errs", "signs")])


@query(f"{SPANS} select condition, round(count(*) filter (where label in ('click', 'view')) / nullif(count(*) filter (where label in ('purchase', 'error')), 0), 6) as ratio from spans group by 1")
def feedback_ratio(spark, d):
    n = lambda *ls: F.count_if(F.col("label").isin(*ls))
    return spans(spark, d).groupBy("condition").agg(F.round(F.try_divide(n("click", "view"), n("purchase", "error")), 6).alias("ratio"))


@query(f"""{SPANS}, b as (select label, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.9) as p90 from spans group by 1)
  select label, round(any_value(q1), 6) as q1, round(any_value(med), 6) as med, round(any_value(q3), 6) as q3, round(any_value(p90), 6) as p90,
  count(*) filter (where value > q3 + 1.5 * (q3 - q1) or value < q1 - 1.5 * (q3 - q1)) as outliers from spans join b using (label) group by 1""")
def iqr_outliers(spark, d):
    s = spans(spark, d)
    at = lambda q: F.percentile("value", F.lit(q))
    b = s.groupBy("label").agg(at(0.25).alias("q1"), at(0.5).alias("med"), at(0.75).alias("q3"), at(0.9).alias("p90"))
    out = F.count_if((F.col("value") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("value") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))))
    return s.join(b, "label").groupBy("label", "q1", "med", "q3", "p90").agg(out.alias("outliers")).select("label", *r6("q1", "med", "q3", "p90"), "outliers")


@query(f"{SPANS} select condition, speaker, label, grouping(condition, speaker, label)::bigint as level, count(*) as n, round(avg(value), 6) as mean from spans group by grouping sets ((condition), (speaker), (condition, speaker), (label), ())")
def grouping_sets_profile(spark, d):
    spans(spark, d).createOrReplaceTempView("colloquy_spans")
    return spark.sql("select condition, speaker, label, grouping_id(condition, speaker, label) as level, count(*) as n, round(avg(value), 6) as mean from colloquy_spans group by grouping sets ((condition), (speaker), (condition, speaker), (label), ())")


def _counts(spark, d, *by):
    return spans(spark, d).groupBy(*by, "label").agg(F.count("*").alias("k"))


SIDES = "sum(case when side = 0 then k * w else 0 end) as a, sum(case when side = 1 then k * w else 0 end) as c"
SHARES = f"select *, a / sum(a) over (partition by %s) as p, c / sum(c) over (partition by %s) as q from"
CI = "round(avg(jsd), 6) as mean, round(quantile_cont(jsd, 0.025), 6) as low, round(quantile_cont(jsd, 0.95), 6) as p95, round(quantile_cont(jsd, 0.975), 6) as high"
COUNTS = f"{SPANS}, cnt as (select condition, conv, label, count(*) as k from spans group by all), un as (select condition, conv, row_number() over (partition by condition order by conv) - 1 as i, count(*) over (partition by condition) as n from (select distinct condition, conv from spans))"


def _picks(n: int, purpose: str) -> str:
    return f"pk as (select condition, b, ('0x' || substr(md5(b || '|' || j || '|{purpose}'), 1, 8))::bigint % n as i, count(*) as w from (select condition, max(n) as n from un group by 1), range({n}) r1(b), lateral (select unnest(range(n)) as j) group by all)"


@query(f"""{COUNTS}, h as (select condition, conv, b, case when row_number() over (partition by condition, b order by md5(b || '|' || conv || '|band'), conv) > floor(n / 2) then 1 else 0 end as side from un, range(100) r(b)),
  s as (select condition, b, label, {SIDES} from (select *, 1 as w from h join cnt using (condition, conv)) group by all), t as ({SHARES % ('condition, b', 'condition, b')} s),
  j as (select condition, b, {JSD} as jsd from t group by all) select condition, {CI} from j group by 1""")
def split_half_band(spark, d):
    h = R.halves(spans(spark, d), 100, "band", "condition")
    j = R.weighted_jsd(h.join(_counts(spark, d, "condition", "conv"), ["condition", "conv"]), F.col("half"), F.lit(1), "condition", "b")
    return R.interval(j, "jsd", "condition").select("condition", *r6("mean", "low", "p95", "high"))


@query(f"""{COUNTS}, {_picks(100, 'boot')}, x as (select b, label, case when condition = 'c0' then 0 else 1 end as side, k, w from pk join un using (condition, i) join cnt using (condition, conv) where condition in ('c0', 'c1')),
  s as (select b, label, {SIDES} from x group by all), t as ({SHARES % ('b', 'b')} s), j as (select b, {JSD} as jsd from t group by all) select {CI} from j""")
def bootstrap_jsd_ci(spark, d):
    s = spans(spark, d).where("condition in ('c0', 'c1')")
    w = R.bootstrap(s, 100, "boot", "condition").join(_counts(spark, d, "condition", "conv"), ["condition", "conv"])
    j = R.weighted_jsd(w, F.when(F.col("condition") == "c0", 0).otherwise(1), F.col("weight"), "b")
    return R.interval(j, "jsd").select(*r6("mean", "low", "p95", "high"))


@query(f"""{COUNTS}, {_picks(100, 'boot')}, base as (select condition, b, label, k, w from pk join un using (condition, i) join cnt using (condition, conv)),
  x as (select *, 1 as pair, case when condition = 'c0' then 0 else 1 end as side from base where condition in ('c0', 'c1') union all select *, 2, case when condition = 'c0' then 0 else 1 end from base where condition in ('c0', 'c2')),
  s as (select pair, b, label, {SIDES} from x group by all), t as ({SHARES % ('pair, b', 'pair, b')} s), j as (select pair, b, {JSD} as jsd0 from t group by all),
  g as (select b, sum(case when pair = 2 then jsd0 else -jsd0 end) as jsd from j group by 1) select {CI}, round(avg((round(jsd, 9) > 0)::int), 6) as share_positive from g""")
def gap_bootstrap(spark, d):
    w = R.bootstrap(spans(spark, d), 100, "boot", "condition").join(_counts(spark, d, "condition", "conv"), ["condition", "conv"])
    in_pair = F.when(F.col("condition") == "c0", F.array(F.lit(1), F.lit(2))).when(F.col("condition") == "c1", F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    j = R.weighted_jsd(w.withColumn("pair", F.explode(in_pair)), F.when(F.col("condition") == "c0", 0).otherwise(1), F.col("weight"), "pair", "b")
    g = j.groupBy("b").agg(F.sum(F.when(F.col("pair") == 2, F.col("jsd")).otherwise(-F.col("jsd"))).alias("jsd"))
    share = g.agg(F.round(F.avg((F.round("jsd", 9) > 0).cast("int")), 6).alias("share_positive"))
    return R.interval(g, "jsd").select(*r6("mean", "low", "p95", "high")).join(share)


@query(f"""{COUNTS}, ref as (select * from un where condition = 'c0'), m as (select max(case when condition = 'c0' then n end) as n0, max(case when condition = 'c1' then n end) as n1 from un),
  pk as (select b, side, ('0x' || substr(md5(b || '|' || j || '|null' || side), 1, 8))::bigint % n0 as i, count(*) as w from m, range(100) r1(b), (values (0), (1)) s(side), lateral (select unnest(range(case when side = 0 then n1 else n0 end)) as j) group by all),
  s as (select b, label, {SIDES} from pk join ref using (i) join cnt using (condition, conv) group by all), t as ({SHARES % ('b', 'b')} s), j as (select b, {JSD} as jsd from t group by all) select {CI} from j""")
def size_matched_null(spark, d):
    own = R.units(spans(spark, d), "condition")
    m = own.agg(F.max(F.when(F.col("condition") == "c0", F.col("n"))).alias("n0"), F.max(F.when(F.col("condition") == "c1", F.col("n"))).alias("n1"))
    picks = m.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)))
    i = draw(F.col("n0"), F.col("b").cast("string"), F.col("j").cast("string"), F.concat(F.lit("null"), F.col("side")))
    picks = picks.withColumn("i", i).groupBy("b", "side", "i").agg(F.count("*").alias("w"))
    rows = picks.join(own.where("condition = 'c0'").select("i", "condition", "conv"), "i").join(_counts(spark, d, "condition", "conv"), ["condition", "conv"])
    return R.interval(R.weighted_jsd(rows, F.col("side"), F.col("w"), "b"), "jsd").select(*r6("mean", "low", "p95", "high"))


@query(f"""{SPANS}, cl as (select distinct condition, conv % 17 as cluster from spans), cu as (select condition, cluster, row_number() over (partition by condition order by cluster) - 1 as i, count(*) over (partition by condition) as n from cl),
  pk as (select condition, b, ('0x' || substr(md5(b || '|' || j || '|cluster'), 1, 8))::bigint % n as i, count(*) as w from (select condition, max(n) as n from cu group by 1), range(100) r1(b), lateral (select unnest(range(n)) as j) group by all),
  cnt as (select condition, conv % 17 as cluster, label, count(*) as k from spans group by all),
  x as (select b, label, case when condition = 'c0' then 0 else 1 end as side, k, w from pk join cu using (condition, i) join cnt using (condition, cluster) where condition in ('c0', 'c1')),
  s as (select b, label, {SIDES} from x group by all), t as ({SHARES % ('b', 'b')} s), j as (select b, {JSD} as jsd from t group by all) select {CI} from j""")
def clustered_bootstrap(spark, d):
    s = spans(spark, d).where("condition in ('c0', 'c1')").withColumn("cluster", F.col("conv") % 17)
    counts = s.groupBy("condition", "cluster", "label").agg(F.count("*").alias("k"))
    w = R.bootstrap(s, 100, "cluster", "condition", unit="cluster").join(counts, ["condition", "cluster"])
    return R.interval(R.weighted_jsd(w, F.when(F.col("condition") == "c0", 0).otherwise(1), F.col("weight"), "b"), "jsd").select(*r6("mean", "low", "p95", "high"))


@query(f"""{SPANS}, k as (select condition, span, row_number() over (partition by condition order by md5(span || '|strata'), span) as nth, count(*) over (partition by condition) as population from spans)
  select condition, span, nth::int as nth, population from k where nth <= 20""")
def stratified_sample_waves(spark, d):
    return R.stratified_sample(spans(spark, d), "condition", "span", 20, "strata").select("condition", "span", "nth", "population")


@query(f"""{SPANS}, c as (select condition, conv, count(*) filter (where label = 'purchase') as num, count(*) as den from spans group by all),
  k as (select b, condition, num, den, row_number() over (partition by b, condition order by md5(b || '|' || conv || '|sub'), conv) as r from c, range(50) x(b)),
  g as (select condition, b, sum(num) / sum(den) as jsd from k where r <= 4 group by all) select condition, {CI} from g group by 1""")
def subsample_ratio(spark, d):
    c = spans(spark, d).groupBy("condition", "conv").agg(F.count_if(F.col("label") == "purchase").alias("num"), F.count("*").alias("den"))
    k = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(49))))
    w = Window.partitionBy("b", "condition").orderBy(hash_order(F.col("b").cast("string"), F.col("conv").cast("string"), "sub"), "conv")
    g = k.withColumn("r", F.row_number().over(w)).where("r <= 4").groupBy("condition", "b").agg((F.sum("num") / F.sum("den")).alias("jsd"))
    return R.interval(g, "jsd", "condition").select("condition", *r6("mean", "low", "p95", "high"))


@query(f"""{SPANS}, c as (select conv, any_value(condition) as condition, avg(value) as v from spans where condition in ('c0', 'c1') group by 1), n as (select count(*) filter (where condition = 'c0') as n0 from c),
  o as (select abs(quantile_cont(v, 0.5) filter (where condition = 'c0') - quantile_cont(v, 0.5) filter (where condition = 'c1')) as obs from c),
  p as (select b, v, row_number() over (partition by b order by md5(b || '|' || conv || '|perm'), conv) <= n0 as first from c, n, range(100) x(b)),
  q as (select b, abs(quantile_cont(v, 0.5) filter (where first) - quantile_cont(v, 0.5) filter (where not first)) as diff from p group by 1)
  select round(any_value(obs), 6) as observed, round((1 + count(*) filter (where round(diff, 9) >= round(obs, 9))) / (count(*) + 1), 6) as p from q, o""")
def perm_test_median(spark, d):
    c = spans(spark, d).where("condition in ('c0', 'c1')").groupBy("conv").agg(F.max("condition").alias("condition"), F.avg("value").alias("v"))
    at = lambda when: F.percentile(F.when(when, F.col("v")), F.lit(0.5))
    obs = c.agg(F.abs(at(F.col("condition") == "c0") - at(F.col("condition") == "c1")).alias("obs"), F.count_if(F.col("condition") == "c0").alias("n0"))
    w = Window.partitionBy("b").orderBy(hash_order(F.col("b").cast("string"), F.col("conv").cast("string"), "perm"), "conv")
    p = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("r", F.row_number().over(w)).join(obs)
    q = p.groupBy("b").agg(F.max("obs").alias("obs"), F.abs(at(F.col("r") <= F.col("n0")) - at(F.col("r") > F.col("n0"))).alias("diff"))
    hits = F.count_if(F.round("diff", 9) >= F.round("obs", 9))
    return q.agg(F.round(F.max("obs"), 6).alias("observed"), F.round((1 + hits) / (F.count("*") + 1), 6).alias("p"))


TR = f"{SPANS}, pr as (select condition, label as source, lead(label) over (partition by condition, conv order by ts, span) as target from spans), tr as (select condition, source, target, count(*) as n from pr where target is not null group by all)"


@query(f"{TR} select condition, source, target, n, round(n / sum(n) over (partition by condition, source), 6) as p from tr")
def transition_matrix(spark, d):
    return S.transitions(spans(spark, d)).select("condition", "source", "target", "n", *r6("p"))


@query(f"""{SPANS}, pr as (select condition, speaker, label, lead(speaker) over w as s2, lead(label) over w as l2 from spans window w as (partition by condition, conv order by ts, span))
  select condition, round(avg((speaker = s2)::int), 6) as same_role, round(avg((speaker <> s2)::int), 6) as cross_role, round(avg((speaker = s2 and label = l2)::int), 6) as self from pr where s2 is not null group by 1""")
def transition_roles(spark, d):
    w = Window.partitionBy("condition", "conv").orderBy("ts", "span")
    pr = spans(spark, d).select("condition", "speaker", "label", F.lead("speaker").over(w).alias("s2"), F.lead("label").over(w).alias("l2")).where("s2 is not null")
    share = lambda e, n: F.round(F.avg(F.expr(e).cast("int")), 6).alias(n)
    return pr.groupBy("condition").agg(share("speaker = s2", "same_role"), share("speaker <> s2", "cross_role"), share("speaker = s2 and label = l2", "self"))


@query(f"{TR}, k as (select *, row_number() over (partition by condition order by n desc, source, target) as r from tr where n >= 2) select condition, source, target, n from k where r <= 5")
def top_transitions(spark, d):
    w = Window.partitionBy("condition").orderBy(F.desc("n"), "source", "target")
    return S.transitions(spans(spark, d)).where("n >= 2").withColumn("r", F.row_number().over(w)).where("r <= 5").select("condition", "source", "target", "n")


TURNS = f"""{SPANS}, c as (select *, case when speaker <> lag(speaker) over w then 1 else 0 end as new from spans window w as (partition by conv order by ts, span)),
  r as (select *, sum(new) over (partition by conv order by ts, span) as turn from c), t as (select conv, turn::bigint as turn, speaker, count(label) as n from r group by all),
  tt as (select *, row_number() over (partition by conv, speaker order by turn) as from_start, row_number() over (partition by conv, speaker order by turn desc) as from_end from t)"""


@query(f"{TURNS} select conv, turn, speaker, n, from_start::int as from_start, from_end::int as from_end from tt")
def turn_runs(spark, d):
    return S.turns(spans(spark, d)).select("conv", "turn", "speaker", "n", "from_start", "from_end")


@query(f"""{TURNS} select speaker, case when from_start <= 5 then '1-5' when from_start <= 15 then '6-15' else '16+' end as bin, count(*) as turns, round(avg(n), 6) as mean from tt group by all""")
def absolute_turn_bins(spark, d):
    bins = F.when(F.col("from_start") <= 5, "1-5").when(F.col("from_start") <= 15, "6-15").otherwise("16+")
    return S.turns(spans(spark, d)).groupBy("speaker", bins.alias("bin")).agg(F.count("*").alias("turns"), F.round(F.avg("n"), 6).alias("mean"))


@query(f"{SPANS}, c as (select condition, speaker, lag(speaker) over (partition by conv order by ts, span) as s0 from spans) select condition, round(avg((speaker = s0)::int), 6) as same from c where s0 is not null group by 1")
def same_speaker_lag(spark, d):
    w = Window.partitionBy("conv").orderBy("ts", "span")
    c = spans(spark, d).select("condition", "speaker", F.lag("speaker").over(w).alias("s0")).where("s0 is not null")
    return c.groupBy("condition").agg(F.round(F.avg((F.col("speaker") == F.col("s0")).cast("int")), 6).alias("same"))


@query(f"""{SPANS}, c as (select *, row_number() over (partition by conv order by ts, span) as i from spans), s as (select *, sum(case when label = 'signup' and i > 1 then 1 else 0 end) over (partition by conv order by ts, span) as segment from c)
  select conv, segment::bigint as segment, count(*) as n, min(span) as first_span from s group by all""")
def session_segments(spark, d):
    s = S.sessions(spans(spark, d), F.col("label") == "signup")
    return s.groupBy("conv", "segment").agg(F.count("*").alias("n"), F.min("span").alias("first_span"))


@query(f"{SPANS}, h as (select span, last_value(case when speaker = 'Counsellor' then label end ignore nulls) over (partition by conv order by ts, span rows between unbounded preceding and 1 preceding) as before from spans where true) select before, count(*) as n from h group by 1")
def previous_other_role(spark, d):
    return S.last_of_other(spans(spark, d), "label").groupBy("before").agg(F.count("*").alias("n"))


@query(f"{SPANS} select span, count(*) over w as n_before, count(*) filter (where label = 'error') over w as errors_before from spans window w as (partition by conv order by ts, span rows between unbounded preceding and 1 preceding)")
def prefix_history(spark, d):
    w = Window.partitionBy("conv").orderBy("ts", "span").rowsBetween(Window.unboundedPreceding, -1)
    return spans(spark, d).select("span", F.count("*").over(w).alias("n_before"), F.count_if(F.col("label") == "error").over(w).alias("errors_before"))


@query("""with m as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
  s as (select conv_id, case when n <= 8 then 0 else least(b * 6, n - 8) end as start, n from (select distinct conv_id, n from m), lateral (select unnest(range(greatest(1, ((n - 8 + 5) // 6) + 1))) as b)),
  u as (select distinct conv_id, start from s) select u.conv_id, u.start::bigint as start, count(*) as messages, sum(length(text))::bigint as chars from u join m on u.conv_id = m.conv_id and i >= u.start and i < u.start + 8 group by all""")
def message_blocks(spark, d):
    w = Window.partitionBy("conv_id")
    m = table(spark, d, "conversations").withColumn("i", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count("*").over(w))
    last = F.greatest(F.col("n") - 8, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(last / 6).cast("long")), lambda b: F.least(b * 6, last)))
    own = m.withColumn("start", F.explode(F.filter(starts, lambda s: (s <= F.col("i")) & (F.col("i") < s + 8))))
    return own.groupBy("conv_id", "start").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


RANKS = f"{SPANS}, x as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 as rk from spans where condition in ('c0', 'c1'))"


@query(f"{RANKS} select count(*) filter (where condition = 'c0') as n_a, count(*) filter (where condition = 'c1') as n_b, round(sum(rk) filter (where condition = 'c0') - n_a * (n_a + 1) / 2, 3) as u, round((sum(rk) filter (where condition = 'c0') - n_a * (n_a + 1) / 2) / (n_a * n_b), 6) as auc from x")
def rank_sum_u(spark, d):
    return H.rank_sum(spans(spark, d), "condition", "c0", "c1", "value").select("n_a", "n_b", F.round("u", 3).alias("u"), *r6("auc"))


@query(f"{RANKS} select round(2 * (sum(rk) filter (where condition = 'c0') - count(*) filter (where condition = 'c0') * (count(*) filter (where condition = 'c0') + 1) / 2) / (count(*) filter (where condition = 'c0') * count(*) filter (where condition = 'c1')) - 1, 6) as delta from x")
def cliffs_delta(spark, d):
    return H.rank_sum(spans(spark, d), "condition", "c0", "c1", "value").select(*r6("delta"))


@query(f"""{SPANS}, x as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 as rk from spans), g as (select condition, sum(rk) as r, count(*) as n from x group by 1),
  t as (select sum(pow(t, 3) - t) as ties from (select count(*) as t from spans group by value)), s as (select count(*) as groups, sum(n)::double as n, sum(r * r / n) as s from g)
  select groups, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)), 4) as h from s, t""")
def kruskal_h(spark, d):
    return H.kruskal(spans(spark, d), "condition", "value").select("groups", F.round("h", 4).alias("h"))


@query("""with x as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 as a, rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2 as b from orders) select round(corr(a, b), 6) as rho from x""")
def spearman_rho(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", "o_custkey")
    a = H.ranked(o, "o_totalprice").withColumnRenamed("rank", "a")
    return H.ranked(a, "o_custkey").agg(F.round(F.corr("a", "rank"), 6).alias("rho"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def pearson_r(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


PV = f"{SPANS}, pv as (select conv, 1 / (1 + count(*)) as p from spans group by 1), o as (select *, row_number() over (order by p, conv) as i, count(*) over () as m from pv)"


@query(f"{PV} select conv, round(least(1, max((m - i + 1) * p) over (order by p, conv rows unbounded preceding)), 6) as holm from o")
def holm_adjust(spark, d):
    pv = spans(spark, d).groupBy("conv").agg((1 / (1 + F.count("*"))).alias("p"))
    return H.adjusted(pv, "p", "conv").select("conv", *r6("holm"))


@query(f"{PV} select conv, i <= coalesce(max(case when p <= i / m * 0.1 then i end) over (), 0) as bh from o")
def bh_pass(spark, d):
    pv = spans(spark, d).groupBy("conv").agg((1 / (1 + F.count("*"))).alias("p"))
    return H.adjusted(pv, "p", "conv").select("conv", "bh")


@query(f"{SPANS} select label, value, round(max(cd), 6) as ecdf from (select label, value, cume_dist() over (partition by label order by value) as cd from spans) group by all")
def ecdf(spark, d):
    """The distribution function over distinct values; shared values are one row of the window."""
    counts = spans(spark, d).groupBy("label", "value").agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy("label").orderBy("value"), Window.partitionBy("label")
    return counts.select("label", "value", F.round(F.sum("n").over(up) / F.sum("n").over(whole), 6).alias("ecdf"))


@query(f"""{SPANS}, e as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.75) as c from spans)
  select case when value <= a then 1 when value <= b then 2 when value <= c then 3 else 4 end as bin, count(*) as n, round(min(value), 6) as low, round(max(value), 6) as high from spans, e group by 1""")
def quantile_bins(spark, d):
    s = spans(spark, d)
    edges = s.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    n = F.size(F.filter("e", lambda e: e < F.col("value"))) + 1
    return s.join(F.broadcast(edges)).groupBy(n.alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


AG = "with r as (select l.quality as gold, (d.n_chars >= 800)::int as pred, lang, source from labels l join documents d using (doc_id))"


def _agreement(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") >= 800).cast("int").alias("pred"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")).join(docs, "doc_id")


@query(f"""{AG}, n as (select count(*) as n, avg((gold = pred)::int) as po from r), e as (select sum(g * p) as pe from (select gold as l, count(*) / (select n from n) as g from r group by 1) join (select pred as l, count(*) / (select n from n) as p from r group by 1) using (l))
  select n, round(po, 6) as agreement, round((po - pe) / nullif(1 - pe, 0), 6) as kappa from n, e""")
def kappa(spark, d):
    return H.kappa(_agreement(spark, d), "gold", "pred").select("n", *r6("agreement", "kappa"))


@query(f"""{AG} select l as label, count(*) filter (where gold = l) as support, count(*) filter (where pred = l) as predicted,
  round(count(*) filter (where gold = l and pred = l) / nullif(count(*) filter (where pred = l), 0), 6) as precision, round(count(*) filter (where gold = l and pred = l) / nullif(count(*) filter (where gold = l), 0), 6) as recall from r, (values (0), (1)) v(l) group by 1""")
def prf_per_label(spark, d):
    return H.per_label(_agreement(spark, d), "gold", "pred").select("label", "support", F.col("predicted"), *r6("precision", "recall"))


@query(f"""{AG}, f as (select l, count(*) filter (where gold = l) as s, 2 * count(*) filter (where gold = l and pred = l) / nullif(count(*) filter (where gold = l) + count(*) filter (where pred = l), 0) as f1 from r, (values (0), (1)) v(l) group by 1)
  select round(avg(f1), 6) as macro_f1, round(sum(f1 * s) / sum(s), 6) as weighted_f1 from f where s > 0""")
def macro_weighted_f1(spark, d):
    f = H.per_label(_agreement(spark, d), "gold", "pred").where("support > 0")
    return f.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


@query(f"{AG} select lang, gold, pred, count(*) as n from r where gold <> pred group by all order by n desc, lang, gold, pred limit 40")
def confusion_topk(spark, d):
    return _agreement(spark, d).where("gold <> pred").groupBy("lang", "gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "gold", "pred").limit(40)


@query("select conv_id, turn, case when trim(text) = '' then 0 else len(string_split_regex(trim(text), ' +')) end::int as words, regexp_matches(text, '[.!?…][\"''»“”)\\]]*[ \\n]*$') as final from conversations")
def word_and_punct_stats(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", words(F.col("text")).alias("words"), final_punctuation(F.col("text")).alias("final"))


@query("select conv_id, turn, text from conversations where len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' and not starts_with(l, 'Th'))) = 0")
def boilerplate_filter(spark, d):
    """Messages of which every non-empty line starts with a marker."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("Th")))
    return table(spark, d, "conversations").where(F.size(lines) == 0).select("conv_id", "turn", "text")


@query("""with p as (select p_partkey, case when lower(p_name) like '%problem%' then 'Problem' when lower(p_name) like '%recommendation%' or lower(p_name) like '%solution%' then 'Solution' when lower(p_name) like '%request%' then 'Request' else 'Other' end as bucket, p_brand from part)
  select bucket, p_brand, count(*) as n from p group by all""")
def bucket_by_text(spark, d):
    return table(spark, d, "part").groupBy(bucket(F.col("p_name")).alias("bucket"), "p_brand").agg(F.count("*").alias("n"))


@query("with k as (select array_to_string(list_slice(string_split(replace(strftime(ts, '%Y-%m-%d'), '/', '-'), '-'), 1, 2), '-') as tier2, event_type from events) select tier2, event_type, count(*) as n from k group by all")
def hierarchical_tier(spark, d):
    return table(spark, d, "events").groupBy(tier(F.date_format("ts", "yyyy-MM-dd"), 2).alias("tier2"), "event_type").agg(F.count("*").alias("n"))


@query("select count(*) as messages, sum(case when role = 'user' then 1 else 0 end)::bigint as user_turns, count(distinct conv_id) as conversations, round(avg(length(text)), 6) as mean_chars from conversations")
def source_inventory(spark, d):
    return table(spark, d, "conversations").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_turns"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("select source, count(*) as n from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0) group by 1")
def drop_antijoin(spark, d):
    drops = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(drops, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("select source, count(*) as n from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id) group by 1")
def analysed_semijoin(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(f"{SPANS} select distinct label from spans where condition = 'c0' and value > 50 intersect select label from spans where condition = 'c1' and value > 50")
def shared_support_intersect(spark, d):
    s = spans(spark, d).where("value > 50")
    return s.where("condition = 'c0'").select("label").intersect(s.where("condition = 'c1'").select("label"))


@query(f"{SPANS}, u as (select condition, label, value from spans where condition = 'c0' union all select 'replay', label, value from spans where condition = 'c0' and value > 50) select condition, label, count(*) as n from u group by all")
def union_arms(spark, d):
    s = spans(spark, d).where("condition = 'c0'").select("condition", "label", "value")
    return s.unionByName(s.where("value > 50").withColumn("condition", F.lit("replay"))).groupBy("condition", "label").agg(F.count("*").alias("n"))


@query("select text, min(doc_id) as doc_id, count(*) as copies from documents group by 1 having count(*) > 1")
def dedup_first(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query("""with t as (select sha1(text) as key, min(doc_id) as first_doc, count(*) as uses, count(distinct source) as sources from documents group by text) select key, row_number() over (order by first_doc)::int as template_id, uses, sources from t where uses > 1""")
def template_registry(spark, d):
    """Repeated texts by hash, numbered by first use."""
    t = table(spark, d, "documents").groupBy(F.sha1("text").alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"), F.countDistinct("source").alias("sources")).where("uses > 1")
    return t.withColumn("template_id", F.row_number().over(Window.orderBy("first_doc"))).select("key", "template_id", "uses", "sources")


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as len from v)
  select vec_id, round(len, 4) as length, round(list_sum(list_transform(e, lambda x: x / len)), 4) as total from n""")
def l2_normalise(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    v = v.withColumn("len", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))
    total = F.aggregate(F.transform("e", lambda x: x / F.col("len")), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.round("len", 4).alias("length"), F.round(total, 4).alias("total"))


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
  m as (select x.vec_id, x.label, y.label as other, avg(1 - list_cosine_similarity(x.e, y.e)) as d from v x join v y on x.vec_id <> y.vec_id group by all),
  ab as (select vec_id, label, max(case when other = label then d end) as a, min(case when other <> label then d end) as b from m group by all)
  select label, count(*) as n, round(avg(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab group by label""")
def cosine_silhouette(spark, d):
    s = V.silhouette(table(spark, d, "embeddings"), "label", "embedding")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


START, TRANS = [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]]
EMIT = {"click": [0.3, 0.1], "view": [0.3, 0.2], "purchase": [0.1, 0.3], "signup": [0.2, 0.2], "error": [0.1, 0.2]}
LN = "ln({})"


@query(f"""with recursive s as (select user_id, event_type as sym, row_number() over (partition by user_id order by ts, event_id) as i from events),
  em(sym, e0, e1) as (values {', '.join(f"('{k}', ln({a}), ln({b}))" for k, (a, b) in EMIT.items())}),
  t(user_id, i, v0, v1) as (select user_id, i, ln(0.6) + e0, ln(0.4) + e1 from s join em using (sym) where i = 1
    union all select s.user_id, s.i, greatest(t.v0 + ln(0.7), t.v1 + ln(0.4)) + e0, greatest(t.v0 + ln(0.3), t.v1 + ln(0.6)) + e1 from t join s on s.user_id = t.user_id and s.i = t.i + 1 join em using (sym))
  select user_id, round(greatest(v0, v1), 6) as score, (case when v0 >= v1 then 0 else 1 end)::int as state from t where i = (select max(i) from s where s.user_id = t.user_id)""")
def hmm_viterbi_fixed(spark, d):
    seq = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("symbols"))
    return seq.select("user_id", S.viterbi(F.col("symbols"), START, TRANS, EMIT).alias("v")).select("user_id", F.round("v.score", 6).alias("score"), F.col("v.state").alias("state"))


@query()
def hmm_model_selection(spark, d):
    """Fitted models by state count: rows only, as random starts are not SQL."""
    s = spans(spark, d).groupBy("condition", "conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "span", "label"))), lambda x: x["label"]).alias("symbols"))
    return S.fit_hmm(s, list(range(2, 9)), restarts=20, iterations=500, tolerance=1e-4)
