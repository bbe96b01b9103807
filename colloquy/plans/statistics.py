"""Queries of tests, effect sizes, resampling and agreement beyond the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.scalar import hash_order, mean, pomp, tier
from colloquy.operators import distributions as D
from colloquy.operators import pvalues as P
from colloquy.operators import resampling as R
from colloquy.operators import tests as H
from colloquy.plans.catalogue import AG, CI, COUNTS, DIST, JSD, PAIRS, PV, RANKS, SHARES, SIDES, SPANS, _agreement, _aligned, _counts, _dist, _picks, query, r6
from colloquy.plans.texts import LN, _next
from colloquy.sources.tables import spans, table

#: The error function in SQL, by the same series; the argument replaces {x}.
ERF = "(1.1283791670955126 * exp(-pow(least({x}, 6), 2)) * list_sum(list_transform(range(0, 121), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(greatest(least({x}, 6), 1e-300)) - lgamma(2 * n + 2) + lgamma(n + 1)))))"


def _t_tail(t: str, df: str) -> str:
    """Student's two-sided p in SQL, by the same finite sums."""
    s, c = f"sin(atan(abs({t}) / sqrt({df})))", f"cos(atan(abs({t}) / sqrt({df})))"
    even = f"{s} * list_sum(list_transform(range(0, greatest(({df})::bigint // 2, 1)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow({c}, 2 * k)))"
    odd = f"0.6366197723675814 * (atan(abs({t}) / sqrt({df})) + case when {df} > 1 then {s} * list_sum(list_transform(range(0, greatest((({df})::bigint - 1) // 2, 1)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow({c}, 2 * k + 1))) else 0 end)"
    return f"(1 - case when ({df}) % 2 = 0 then {even} else {odd} end)"


# -- tests ------------------------------------------------------------------------------------------------

MEANS = f"{SPANS}, m as (select condition, conv, avg(value) as value, count(*) as n from spans group by all)"


def _means(spark, d):
    return spans(spark, d).groupBy("condition", "conv").agg(mean("value").alias("value"), F.count("*").alias("n"))


@query(f"""{MEANS}, x as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 as rk from m where condition in ('c0', 'c1')), t as (select coalesce(sum(pow(k, 3) - k), 0) as ties from (select count(*) as k from x group by value)),
  s as (select count(*) filter (where condition = 'c0') as n_a, count(*) filter (where condition = 'c1') as n_b, sum(rk) filter (where condition = 'c0') as r from x), u as (select n_a, n_b, r - n_a * (n_a + 1) / 2 as u, ties from s, t),
  z as (select *, greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))) / sqrt(2) as z from u)
  select n_a, n_b, round(u, 3) as u, round(1 - {ERF.format(x='z')}, 6) as p from z""")
def mann_whitney(spark, d):
    m = _means(spark, d).where("condition in ('c0', 'c1')")
    ties = m.groupBy("value").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.pow("k", F.lit(3)) - F.col("k")), F.lit(0.0)).alias("ties"))
    got = H.rank_sum(m, "condition", "c0", "c1", "value").join(ties)  # one row each
    p = P.mann_whitney_p(F.col("u"), F.col("n_a"), F.col("n_b"), F.col("ties"))
    return got.select("n_a", "n_b", F.round("u", 3).alias("u"), F.round(p, 6).alias("p"))


@query(f"""{MEANS}, x as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 as rk from m), g as (select condition, sum(rk) as r, count(*) as n from x group by 1), s as (select sum(n)::double as n, sum(r * r / n) as s from g),
  t as (select coalesce(sum(pow(k, 3) - k), 0) as ties from (select count(*) as k from x group by value)), h as (select (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) as h from s, t)
  select round(h, 6) as h, round(exp(-h / 2), 6) as p from h""")
def kruskal_p(spark, d):
    """Three groups have two degrees of freedom, whose tail is exponential."""
    return H.kruskal(_means(spark, d), "condition", "value").select(F.round("h", 6).alias("h"), F.round(F.exp(-F.col("h") / 2), 6).alias("p"))


@query(f"""{MEANS}, x as (select condition, rank() over (partition by condition order by value) + (count(*) over (partition by condition, value) - 1) / 2 as a, rank() over (partition by condition order by n) + (count(*) over (partition by condition, n) - 1) / 2 as b, value, n from m),
  r as (select condition, count(*) as n, corr(a, b) as rho0, corr(value, x.n) as r0 from x group by 1)
  select condition, n, round(rho0, 6) as rho, round({_t_tail('(rho0 * sqrt((n - 2) / (1 - rho0 * rho0)))', '(n - 2)')}, 5) as rho_p, round(r0, 6) as r, round({_t_tail('(r0 * sqrt((n - 2) / (1 - r0 * r0)))', '(n - 2)')}, 5) as r_p from r""")
def correlations_p(spark, d):
    """Spearman's and Pearson's correlation of a conversation's mean value and length, with p."""
    m = _means(spark, d)
    a = H.ranked(m, "value", "condition").withColumnRenamed("rank", "a")
    both = H.ranked(a, "n", "condition")
    got = both.groupBy("condition").agg(F.count("*").alias("n"), F.corr("a", "rank").alias("rho"), F.corr("value", F.col("n").cast("double")).alias("r"))
    # p first: inside a lambda, a rounded column of the same select would stand for its unrounded namesake.
    got = got.withColumn("rho_p", P.correlation_p(F.col("rho"), F.col("n"))).withColumn("r_p", P.correlation_p(F.col("r"), F.col("n")))
    return got.select("condition", "n", *r6("rho", "r"), F.round("rho_p", 5).alias("rho_p"), F.round("r_p", 5).alias("r_p"))


FISHER = f"""{SPANS}, f as (select condition, conv, count(*) filter (where label = 'error') * 6 > count(*) as hit from spans group by all), o as (select count(*) filter (where condition = 'c0' and hit) as a, count(*) filter (where condition = 'c0' and not hit) as b from f),
  t as (select condition, any_value(a) as a, any_value(b) as b, count(*) filter (where hit) as c, count(*) filter (where not hit) as d from f, o where condition <> 'c0' group by 1),
  x as (select *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) as x from t),
  l as (select *, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) as ln from x), w as (select *, exp(ln - max(ln) over (partition by condition)) as w from l),
  v as (select *, max(case when x = a then w end) over (partition by condition) as own from w), fp as (select condition, any_value(a) as a, any_value(b) as b, any_value(c) as c, any_value(d) as d, sum(case when w <= own * (1 + 1e-7) then w else 0 end) / sum(w) as p from v group by 1)"""


def _fisher(spark, d):
    f = spans(spark, d).groupBy("condition", "conv").agg((F.count_if(F.col("label") == "error") * 6 > F.count("*")).alias("hit"))
    sums = f.groupBy("condition").agg(F.count_if("hit").alias("c"), F.count_if(~F.col("hit")).alias("d"))
    own = sums.where("condition = 'c0'").select(F.col("c").alias("a"), F.col("d").alias("b"))
    t = sums.where("condition <> 'c0'").join(own)  # one row
    return t.join(P.fisher(t, "a", "b", "c", "d", "condition"), "condition")


@query(f"{FISHER} select condition, a, b, c, d, round(p, 6) as p from fp")
def fisher_exact(spark, d):
    return _fisher(spark, d).select("condition", "a", "b", "c", "d", *r6("p"))


@query(f"{PV} select conv, round(least(1, m * p), 6) as bonferroni from o")
def bonferroni(spark, d):
    pv = spans(spark, d).groupBy("conv").agg((1 / (1 + F.count("*"))).alias("p"))
    n = pv.agg(F.count("*").alias("m"))  # one row
    return pv.join(n).select("conv", F.round(F.least(F.lit(1.0), F.col("m") * F.col("p")), 6).alias("bonferroni"))


ITEMS = "with s as (select c_custkey as person, c_nationkey % 3 as course, [c_custkey % 7, (c_custkey // 7) % 6, (c_custkey // 3) % 5 + 1] as items from customer), p as (select person, course, list_avg(list_transform(list_filter(items, lambda x: x between 1 and 5), lambda x: (5 - x) / 4 * 100)) as score from s)"


def _items(spark, d):
    k = F.col("c_custkey")
    items = F.array(k % 7, F.floor(k / 7) % 6, F.floor(k / 3) % 5 + 1)
    valid = F.filter(F.transform(items, lambda x: pomp(x)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(valid, F.lit(0.0), lambda s, x: s + x), F.size(valid))
    return table(spark, d, "customer").select(k.alias("person"), (F.col("c_nationkey") % 3).alias("course"), mean.alias("score"))


@query(f"{ITEMS} select person, round(score, 6) as score from p")
def pomp_scores(spark, d):
    """Answers 1 to 5 as percent of the scale, others missing; a person's mean skips missing answers."""
    return _items(spark, d).select("person", *r6("score"))


Z975 = 1.959963984540054


@query(f"""{ITEMS}, g as (select course, count(score) as n, avg(score) as mean, stddev_samp(score) as sd from p group by 1),
  q as (select *, n - 1 as df from g), h as (select *, {Z975} + (pow({Z975}, 3) + {Z975}) / 4 / df + (5 * pow({Z975}, 5) + 16 * pow({Z975}, 3) + 3 * {Z975}) / 96 / (df * df) + (3 * pow({Z975}, 7) + 19 * pow({Z975}, 5) + 17 * pow({Z975}, 3) - 15 * {Z975}) / 384 / (df * df * df) as t from q)
  select course, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - t * sd / sqrt(n), 6) as low, round(mean + t * sd / sqrt(n), 6) as high from h""")
def mean_t_interval(spark, d):
    g = _items(spark, d).groupBy("course").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    half = P.t_quantile(Z975, (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    return g.select("course", "n", *r6("mean", "sd"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"))


@query(f"""{ITEMS}, j as (select p.*, c_acctbal as y from p join customer on c_custkey = person), n as (select course, count(*) as n from j group by 1), least_c as (select arg_min(course, (n, course)) as c from n),
  v as (select 'all' as kept, score, y from j union all select 'without smallest', score, y from j, least_c where course <> c), r as (select kept, count(score) as n, corr(score, y) as r from v where score is not null group by 1)
  select kept, n, round(r, 6) as r from r""")
def association_sensitivity(spark, d):
    """A correlation across courses, with all of them and without the smallest."""
    j = _items(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_acctbal").alias("y")), "person")
    smallest = j.groupBy("course").agg(F.count("*").alias("n")).agg(F.min_by("course", F.struct("n", "course")).alias("c"))  # one row
    rest = j.join(smallest).where("course <> c").select(F.lit("without smallest").alias("kept"), "score", "y")
    both = j.select(F.lit("all").alias("kept"), "score", "y").unionByName(rest).where("score is not null")
    return both.groupBy("kept").agg(F.count("score").alias("n"), F.round(F.corr("score", "y"), 6).alias("r"))


# -- effects and distances --------------------------------------------------------------------------------


@query(f"""{PAIRS}, m as (select *, sum(na) over w as sa, sum(nb) over w as sb, na + nb as nn from al window w as (partition by a, b, speaker)),
  v as (select a, b, speaker, sqrt(sum(pow(na - nn * sa / (sa + sb), 2) / (nn * sa / (sa + sb)) + pow(nb - nn * sb / (sa + sb), 2) / (nn * sb / (sa + sb))) / any_value(sa + sb)) as v from m group by all)
  select a, b, speaker, case when v < 0.1 then 'negligible' when v < 0.3 then 'small' when v < 0.5 then 'medium' else 'large' end as size from v""")
def v_benchmark(spark, d):
    """Benchmarks of Cramer's V for two groups, whose smaller dimension less one is 1."""
    v = D.cramers_v(_aligned(spark, d, "n"), "a", "b", "speaker")
    return v.select("a", "b", "speaker", F.when(F.col("v") < 0.1, "negligible").when(F.col("v") < 0.3, "small").when(F.col("v") < 0.5, "medium").otherwise("large").alias("size"))


@query(f"""{SPANS}, n as (select condition, conv % 4 as model, label, count(*) as n from spans group by all), c as (select 'm' || model as name, label, sum(n) as n from n where condition = 'c2' group by all union all select condition, label, sum(n) from n where condition <> 'c2' group by all),
  p as (select name, label, n / sum(n) over (partition by name) as p0, sum(n) over (partition by name) as t from c), prs as (select x.name as model, y.name as baseline from (select distinct name from p where t >= 20) x, (values ('c0'), ('c1')) y(name) where starts_with(x.name, 'm')),
  al as (select model, baseline, label, sum(case when name = model then p0 else 0 end) as p, sum(case when name = baseline then p0 else 0 end) as q from p join prs on name in (model, baseline) group by all)
  select model, baseline, round({JSD}, 6) as jsd from al group by all""")
def realness_two_baselines(spark, d):
    """How far each model with enough spans is from either baseline."""
    s = spans(spark, d)
    name = F.when(F.col("condition") == "c2", F.concat(F.lit("m"), F.col("conv") % 4)).otherwise(F.col("condition"))
    dist = D.distribution(s.withColumn("condition", name), "condition")
    enough = dist.where("total >= 20")
    pairs = [(f"m{k}", c) for k in range(4) for c in ("c0", "c1")]
    there = enough.select("condition").distinct().withColumnRenamed("condition", "a")
    j = D.distances(D.aligned(enough.unionByName(dist.where("condition in ('c0', 'c1') and total < 20")), [*{x for p in pairs for x in p}], pairs=pairs), "a", "b")
    return j.join(there, "a", "left_semi").select(F.col("a").alias("model"), F.col("b").alias("baseline"), *r6("jsd"))


@query(f"""{SPANS}, cd as (select condition, conv, label, count(*) / sum(count(*)) over (partition by condition, conv) as p from spans group by condition, conv, label), g as (select c.condition, c.conv, l.label, coalesce(cd.p, 0) as p from (select distinct condition, conv from spans where condition in ('c0', 'c1')) c cross join (select distinct label from spans) l left join cd using (condition, conv, label)),
  m as (select label, quantile_cont(p, 0.5) filter (where condition = 'c0') as med_a, quantile_cont(p, 0.5) filter (where condition = 'c1') as med_b from g group by 1),
  x as (select *, rank() over (partition by label order by p) + (count(*) over (partition by label, p) - 1) / 2 as rk from g), u as (select label, sum(rk) filter (where condition = 'c0') as r, count(*) filter (where condition = 'c0') as na, count(*) filter (where condition = 'c1') as nb from x group by 1)
  select label, round(med_a, 6) as median_a, round(med_b, 6) as median_b, round((r - na * (na + 1) / 2) / (na * nb), 6) as auc, round((select avg((p > med_b)::int) from g where g.label = m.label and condition = 'c0'), 6) as above_b, round((select avg((p < med_a)::int) from g where g.label = m.label and condition = 'c1'), 6) as below_a from m join u using (label)""")
def persistence(spark, d):
    """Per label: medians of the conversations' shares, and how often one condition lies beyond the other's median."""
    s = spans(spark, d)
    cd = D.distribution(s, "condition", "conv").select("condition", "conv", "label", "p")
    labels = s.select("label").distinct().agg(F.collect_set("label").alias("ls"))  # one row: the label dimension
    convs = s.where("condition in ('c0', 'c1')").select("condition", "conv").distinct()
    g = convs.join(labels).select("condition", "conv", F.explode("ls").alias("label")).join(cd, ["condition", "conv", "label"], "left").fillna(0.0, ["p"])
    med = lambda c: F.percentile(F.when(F.col("condition") == c, F.col("p")), F.lit(0.5))
    m = g.groupBy("label").agg(med("c0").alias("median_a"), med("c1").alias("median_b"))
    x = H.ranked(g, "p", "label").join(m, "label")
    of = lambda c, e: F.when(F.col("condition") == c, e)
    got = x.groupBy("label", "median_a", "median_b").agg(F.sum(of("c0", F.col("rank"))).alias("r"), F.count(of("c0", F.lit(1))).alias("na"), F.count(of("c1", F.lit(1))).alias("nb"), F.avg(of("c0", (F.col("p") > F.col("median_b")).cast("int"))).alias("above_b"), F.avg(of("c1", (F.col("p") < F.col("median_a")).cast("int"))).alias("below_a"))
    auc = (F.col("r") - F.col("na") * (F.col("na") + 1) / 2) / (F.col("na") * F.col("nb"))
    return got.select("label", *r6("median_a", "median_b"), F.round(auc, 6).alias("auc"), *r6("above_b", "below_a"))


MERGED = "case when label = 'view' then 'click' when label = 'signup' and value > 50 then 'purchase' else label end"
TWO = f"""{SPANS}, two as (select 'a' as source, condition, label from spans union all select 'b', condition, {MERGED} from spans), n as (select source, condition, label, count(*) as n from two group by all), ds as (select *, n / sum(n) over (partition by source, condition) as p0 from n)"""


def _two(spark, d):
    merged = F.when(F.col("label") == "view", "click").when((F.col("label") == "signup") & (F.col("value") > 50), "purchase").otherwise(F.col("label"))
    both = F.explode(F.array(F.struct(F.lit("a").alias("source"), F.col("label").alias("l")), F.struct(F.lit("b").alias("source"), merged.alias("l"))))
    return spans(spark, d).select("condition", both.alias("x")).select("condition", F.col("x.source").alias("source"), F.col("x.l").alias("label"))


@query(f"""{TWO}, prs as (select x as a, y as b from (values ('c0', 'c1'), ('c0', 'c2'), ('c1', 'c2')) v(x, y)), al as (select source, a, b, label, sum(case when condition = a then p0 else 0 end) as p, sum(case when condition = b then p0 else 0 end) as q from ds join prs on condition in (a, b) group by all),
  j as (select source, a, b, {JSD} as jsd from al group by all) select a, b, round(max(case when source = 'a' then jsd end), 6) as jsd_a, round(max(case when source = 'b' then jsd end), 6) as jsd_b, round(abs(max(case when source = 'a' then jsd end) - max(case when source = 'b' then jsd end)), 6) as change from j group by all""")
def segmentation_ablation(spark, d):
    """The same distances under two sources of spans, and how much they differ."""
    j = D.distances(D.aligned(D.distribution(_two(spark, d), "source", "condition"), ["c0", "c1", "c2"], "source"), "source", "a", "b")
    side = lambda s: F.max(F.when(F.col("source") == s, F.col("jsd")))
    return j.groupBy("a", "b").agg(F.round(side("a"), 6).alias("jsd_a"), F.round(side("b"), 6).alias("jsd_b"), F.round(F.abs(side("a") - side("b")), 6).alias("change"))


@query(f"""{TWO}, al as (select condition, label, sum(case when source = 'b' then p0 else -p0 end) as shift from ds group by all), k as (select *, row_number() over (partition by condition order by round(abs(shift), 9) desc, label) as r from al) select condition, label, round(shift, 6) as shift from k where r <= 3""")
def segmentation_shifts(spark, d):
    ds = D.distribution(_two(spark, d), "source", "condition")
    al = ds.groupBy("condition", "label").agg(F.sum(F.when(F.col("source") == "b", F.col("p")).otherwise(-F.col("p"))).alias("shift"))
    w = Window.partitionBy("condition").orderBy(F.desc(F.round(F.abs("shift"), 9)), "label")
    return al.withColumn("r", F.row_number().over(w)).where("r <= 3").select("condition", "label", *r6("shift"))


@query(f"""{SPANS}, l as (select distinct label as left_out from spans), n as (select left_out, condition, label, count(*) as n from spans, l where label <> left_out group by all), s as (select *, n / sum(n) over (partition by left_out, condition) as p0 from n),
  prs as (select * from (values ('c0', 'c1'), ('c0', 'c2')) v(a, b)), al as (select left_out, a, b, label, sum(case when condition = a then p0 else 0 end) as p, sum(case when condition = b then p0 else 0 end) as q from s join prs on condition in (a, b) group by all), j as (select left_out, b, {JSD} as jsd from al group by all)
  select left_out, round(sum(case when b = 'c2' then jsd else -jsd end), 6) as gap from j group by 1""")
def leave_one_out_gap(spark, d):
    """The proximity gap without each category in turn."""
    counts = D.distribution(spans(spark, d), "condition").select("condition", "label", "n")
    labels = counts.agg(F.collect_set("label").alias("ls"))  # one row: the label dimension
    kept = counts.join(labels).select("*", F.explode("ls").alias("left_out")).where("label <> left_out").drop("ls")
    kept = kept.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("left_out", "condition")))
    j = D.distances(D.aligned(kept, ["c0", "c1", "c2"], "left_out", pairs=[("c0", "c1"), ("c0", "c2")]), "left_out", "b")
    return j.groupBy("left_out").agg(F.round(F.sum(F.when(F.col("b") == "c2", F.col("jsd")).otherwise(-F.col("jsd"))), 6).alias("gap"))


@query(f"""{SPANS}, g as (select condition, speaker, count(*) as n, avg((label = 'error')::int) as rate from spans where condition in ('c0', 'c1') group by all), s as (select *, n / sum(n) over (partition by condition) as share from g),
  w as (select speaker, max(case when condition = 'c0' then share end) as sa, max(case when condition = 'c1' then share end) as sb, max(case when condition = 'c0' then rate end) as ra, max(case when condition = 'c1' then rate end) as rb from s group by 1)
  select round(sum(sb * rb - sa * ra), 6) as gap, round(sum((sb - sa) * (ra + rb) / 2), 6) as composition, round(sum((rb - ra) * (sa + sb) / 2), 6) as rate from w""")
def rate_gap_decomposition(spark, d):
    """A gap of rates as a part from the groups' composition and a part from their rates."""
    g = spans(spark, d).where("condition in ('c0', 'c1')").groupBy("condition", "speaker").agg(F.count("*").alias("n"), F.avg((F.col("label") == "error").cast("int")).alias("rate"))
    s = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("condition")))
    of = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x)))
    w = s.groupBy("speaker").agg(of("c0", "share").alias("sa"), of("c1", "share").alias("sb"), of("c0", "rate").alias("ra"), of("c1", "rate").alias("rb"))
    total = lambda e, n: F.round(F.sum(F.expr(e)), 6).alias(n)
    return w.agg(total("sb * rb - sa * ra", "gap"), total("(sb - sa) * (ra + rb) / 2", "composition"), total("(rb - ra) * (sa + sb) / 2", "rate"))


BUCKETS = {"narrow": ["error"], "wide": ["error", "signup"], "broad": ["error", "signup", "purchase"]}


@query(f"{SPANS}, b(name, label) as (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{x}{chr(39)})' for k, v in BUCKETS.items() for x in v)}), s as (select name, condition, avg(case when b2.hit then 1 else 0 end) as share from (select distinct name from b) n cross join spans sp left join (select name as bn, label as bl, true as hit from b) b2 on bn = n.name and bl = sp.label group by all) select name, round(max(case when condition = 'c1' then share end) - max(case when condition = 'c0' then share end), 6) as contrast, round(max(share), 6) as largest from s group by 1")
def bucket_contrasts(spark, d):
    """Contrasts of two conditions under alternate definitions of a bucket."""
    hits = [F.avg(F.col("label").isin(v).cast("int")).alias(k) for k, v in BUCKETS.items()]
    long = spans(spark, d).groupBy("condition").agg(*hits).unpivot(["condition"], list(BUCKETS), "name", "share")
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("share")))
    return long.groupBy("name").agg(F.round(of("c1") - of("c0"), 6).alias("contrast"), F.round(F.max("share"), 6).alias("largest"))


@query(f"{PAIRS}, j as (select a, b, {JSD} as jsd from al where speaker = 'Client' group by all), x as (select max(case when a = 'c0' and b = 'c1' then jsd end) as ab, max(case when a = 'c0' and b = 'c2' then jsd end) as ac, max(case when a = 'c1' then jsd end) as bc from j) select round(ab, 6) as bx, round((ab * ab + ac * ac - bc * bc) / (2 * ab), 6) as cx, round(sqrt(greatest(ac * ac - pow((ab * ab + ac * ac - bc * bc) / (2 * ab), 2), 0)), 5) as cy from x")
def planar_embedding(spark, d):
    """Three conditions in the plane by their pairwise distances: the first at 0, the second on the axis."""
    j = D.distances(_aligned(spark, d).where("speaker = 'Client'"), "a", "b")
    of = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("jsd")))
    x = j.agg(of("c0", "c1").alias("ab"), of("c0", "c2").alias("ac"), of("c1", "c2").alias("bc"))
    cx = F.expr("(ab * ab + ac * ac - bc * bc) / (2 * ab)")
    return x.select(F.round("ab", 6).alias("bx"), F.round(cx, 6).alias("cx"), F.round(F.sqrt(F.greatest(F.col("ac") * F.col("ac") - cx * cx, F.lit(0.0))), 5).alias("cy"))


# -- resampling -------------------------------------------------------------------------------------------

N = 1000  # replicates


@query(f"""{COUNTS}, h as (select conv, b, case when row_number() over (partition by b order by md5(b || '|' || conv || '|band'), conv) > floor(n / 2) then 1 else 0 end as side from un, range({N}) r(b) where condition = 'c0'),
  s as (select b, label, {SIDES} from (select *, 1 as w from h join cnt using (conv) where condition = 'c0') group by all), t as ({SHARES % ('b', 'b')} s), j as (select b, {JSD} as jsd from t group by all), ds as (select condition, label, n / sum(n) over (partition by condition) as p0 from (select condition, label, sum(k) as n from cnt group by all)),
  al as (select o, label, sum(case when condition = 'c0' then p0 else 0 end) as p, sum(case when condition = o then p0 else 0 end) as q from ds, (values ('c1'), ('c2')) v(o) where condition in ('c0', o) group by all), ob as (select o as condition, {JSD} as seen from al group by 1)
  select condition, round(seen, 6) as seen, round(avg((round(jsd, 9) < round(seen, 9))::int), 6) as percentile, round(quantile_cont(jsd, 0.95), 6) as p95 from ob, j group by condition, seen""")
def band_percentile(spark, d):
    """Where the distance to each condition lies in the noise band of 1,000 split halves of the reference (strictly below)."""
    s = spans(spark, d)
    ref = s.where("condition = 'c0'")
    sums = R.half_counts(ref, _counts(spark, d, "condition", "conv").where("condition = 'c0'"), N, "band", "label")
    j = R.weighted_jsd(sums, F.col("half"), F.lit(1), "b")
    seen = D.distances(D.aligned(D.distribution(s, "condition"), ["c0", "c1", "c2"], pairs=[("c0", "c1"), ("c0", "c2")]), "b").select(F.col("b").alias("condition"), F.col("jsd").alias("seen"))
    got = j.select("jsd").join(F.broadcast(seen)).groupBy("condition", "seen")  # two rows
    below = F.avg((F.round("jsd", 9) < F.round("seen", 9)).cast("int"))
    return got.agg(F.round(below, 6).alias("percentile"), F.round(F.percentile("jsd", F.lit(0.95)), 6).alias("p95")).select("condition", F.round("seen", 6).alias("seen"), "percentile", "p95")


DROPS = {"none": [], "S1": ["error"], "S2": ["error", "signup"]}


@query(f"""{COUNTS}, {_picks(N, 'sets')}, ex(name, label) as (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{x}{chr(39)})' for k, v in DROPS.items() for x in (v or ['']))}), nm as (select distinct name from ex),
  x as (select name, b, cnt.label, case when condition = 'c0' then 0 else 1 end as side, k, w from pk join un using (condition, i) join cnt using (condition, conv), nm where condition in ('c0', 'c1') and not exists (select 1 from ex where ex.name = nm.name and ex.label = cnt.label)),
  s as (select name, b, label, {SIDES} from x group by all), t as ({SHARES % ('name, b', 'name, b')} s), j as (select name, b, {JSD} as jsd from t group by all) select name, {CI} from j group by 1""")
def exclusion_bootstrap(spark, d):
    """The same draws under growing exclusion sets: the sets differ, not the random numbers."""
    s = spans(spark, d).where("condition in ('c0', 'c1')")
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.lit(x) for x in v]).cast("array<string>").alias("out")) for k, v in DROPS.items()]))
    counts = _counts(spark, d, "condition", "conv").select("*", sets.alias("e")).where(~F.array_contains("e.out", F.col("label"))).withColumn("name", F.col("e.name"))
    w = R.bootstrap(s, N, "sets", "condition").join(counts, ["condition", "conv"])
    return R.interval(R.weighted_jsd(w, F.when(F.col("condition") == "c0", 0).otherwise(1), F.col("weight"), "name", "b"), "jsd", "name").select("name", *r6("mean", "low", "p95", "high"))


RATIO = "num as (select {by}, conv, count(*) filter (where label = 'purchase') as num, count(*) as den from spans group by all)"


def _shares(spark, d, *by):
    return spans(spark, d).groupBy(*by, "conv").agg(F.count_if(F.col("label") == "purchase").alias("num"), F.count("*").alias("den"))


@query(f"""{COUNTS}, {_picks(N, 'ratio')}, {RATIO.format(by='condition')}, g as (select condition, b, sum(num * w) / sum(den * w) as jsd from pk join un using (condition, i) join num using (condition, conv) group by all) select condition, {CI} from g group by 1""")
def ratio_bootstrap(spark, d):
    """A bucket's share under resampled conversations, with the same stream for every condition."""
    w = R.bootstrap(spans(spark, d), N, "ratio", "condition").join(_shares(spark, d, "condition"), ["condition", "conv"])
    g = w.groupBy("condition", "b").agg((F.sum(F.col("num") * F.col("weight")) / F.sum(F.col("den") * F.col("weight"))).alias("jsd"))
    return R.interval(g, "jsd", "condition").select("condition", *r6("mean", "low", "p95", "high"))


@query(f"""{SPANS}, st as (select distinct condition, conv % 3 as stratum, conv from spans), un as (select *, row_number() over (partition by condition, stratum order by conv) - 1 as i, count(*) over (partition by condition, stratum) as n from st),
  pk as (select condition, stratum, b, ('0x' || substr(md5(b || '|' || j || '|strat'), 1, 8))::bigint % n as i, count(*) as w from (select condition, stratum, max(n) as n from un group by all), range({N}) r(b), lateral (select unnest(range(n)) as j) group by all),
  {RATIO.format(by='condition')}, g as (select condition, b, sum(num * w) / sum(den * w) as jsd from pk join un using (condition, stratum, i) join num using (condition, conv) group by all) select condition, {CI} from g group by 1""")
def stratified_bootstrap(spark, d):
    """Every stratum is resampled to its own size."""
    s = spans(spark, d).withColumn("stratum", F.col("conv") % 3)
    w = R.bootstrap(s, N, "strat", "condition", "stratum").join(_shares(spark, d, "condition"), ["condition", "conv"])
    g = w.groupBy("condition", "b").agg((F.sum(F.col("num") * F.col("weight")) / F.sum(F.col("den") * F.col("weight"))).alias("jsd"))
    return R.interval(g, "jsd", "condition").select("condition", *r6("mean", "low", "p95", "high"))


@query(f"""{MEANS}, cl as (select distinct condition, conv % 17 as cluster from m), cu as (select condition, cluster, row_number() over (partition by condition order by cluster) - 1 as i, count(*) over (partition by condition) as n from cl),
  pk as (select condition, b, ('0x' || substr(md5(b || '|' || j || '|med'), 1, 8))::bigint % n as i, count(*) as w from (select condition, max(n) as n from cu group by 1), range(200) r1(b), lateral (select unnest(range(n)) as j) group by all),
  x as (select b, condition, value, unnest(range(w)) as copy from pk join cu using (condition, i) join m on m.condition = pk.condition and m.conv % 17 = cu.cluster where pk.condition in ('c0', 'c1')),
  g as (select b, quantile_cont(value, 0.5) filter (where condition = 'c0') - quantile_cont(value, 0.5) filter (where condition = 'c1') as jsd from x group by 1) select {CI} from g""")
def cluster_median_bootstrap(spark, d):
    """The difference of two medians under resampled clusters of conversations (200 replicates, as medians need the rows)."""
    m = _means(spark, d).where("condition in ('c0', 'c1')").withColumn("cluster", F.col("conv") % 17)
    w = R.bootstrap(m, 200, "med", "condition", unit="cluster").join(m, ["condition", "cluster"])
    at = lambda c: F.percentile(F.when(F.col("condition") == c, F.col("value")), F.lit(0.5), F.col("weight"))
    return R.interval(w.groupBy("b").agg((at("c0") - at("c1")).alias("jsd")), "jsd").select(*r6("mean", "low", "p95", "high"))


@query(f"""{AG}, u as (select distinct source from r), un as (select source, row_number() over (order by source) - 1 as i, count(*) over () as n from u), pk as (select b, ('0x' || substr(md5(b || '|' || j || '|kappa'), 1, 8))::bigint % n as i, count(*) as w from (select max(n) as n from un), range({N}) r1(b), lateral (select unnest(range(n)) as j) group by all),
  c as (select source, sum((gold = 1 and pred = 1)::int) as a, sum((gold = 1 and pred = 0)::int) as b1, sum((gold = 0 and pred = 1)::int) as c, sum((gold = 0 and pred = 0)::int) as d from r group by 1),
  s as (select b, sum(w * a) as a, sum(w * b1) as b1, sum(w * c) as c, sum(w * d) as d from pk join un using (i) join c using (source) group by 1), n as (select *, a + b1 + c + d as n from s),
  k as (select b, ((a + d) / n - ((a + b1) * (a + c) + (c + d) * (b1 + d)) / (n * n)) / nullif(1 - ((a + b1) * (a + c) + (c + d) * (b1 + d)) / (n * n), 0) as jsd from n) select {CI} from k""")
def kappa_bootstrap(spark, d):
    """Cohen's kappa under resampled sources."""
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") >= 800).cast("int").alias("pred"))
    r = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")).join(docs, "doc_id")
    cell = lambda g, p, n: F.count_if((F.col("gold") == g) & (F.col("pred") == p)).alias(n)
    cells = r.groupBy("source").agg(cell(1, 1, "a"), cell(1, 0, "b1"), cell(0, 1, "c"), cell(0, 0, "d")).withColumn("one", F.lit(1))
    w = R.bootstrap(cells, N, "kappa", "one", unit="source").join(cells.drop("one"), "source")
    s = w.groupBy("b").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("a", "b1", "c", "d")]).withColumn("n", F.expr("a + b1 + c + d"))
    chance = F.expr("((a + b1) * (a + c) + (c + d) * (b1 + d)) / (n * n)")
    k = s.select("b", F.try_divide(F.expr("(a + d) / n") - chance, 1 - chance).alias("jsd"))
    return R.interval(k, "jsd").select(*r6("mean", "low", "p95", "high"))


@query(f"""{SPANS}, k as (select condition, span, row_number() over (partition by condition order by md5(span || '|waves'), span) as nth, count(*) over (partition by condition) as population from spans)
  select condition, span, case when nth <= 10 then 1 else 2 end as wave, population, row_number() over (partition by case when nth <= 10 then 1 else 2 end order by md5(span || '|shuffle'), span)::int as place from k where nth <= 30""")
def two_wave_sample(spark, d):
    """A stratified sample in two waves, shuffled within each, with the population for weights."""
    picked = R.stratified_sample(spans(spark, d), "condition", "span", 30, "waves").withColumn("wave", F.when(F.col("nth") <= 10, 1).otherwise(2))
    w = Window.partitionBy("wave").orderBy(hash_order(F.col("span").cast("string"), "shuffle"), "span")  # 30 rows a stratum
    return picked.select("condition", "span", "wave", "population", F.row_number().over(w).alias("place"))


# -- agreement --------------------------------------------------------------------------------------------

CODES = f"{SPANS}, gp as (select speaker, label || '-' || (span % 2) || '-' || (span % 3) as gold, label || '-' || (span % 2) || '-' || (span % 5 % 3) as pred0, value from spans), g2 as (select speaker, gold, case when value > 80 then 'view-0-0' else pred0 end as pred from gp)"


def _codes(spark, d):
    code = lambda e: F.concat_ws("-", "label", (F.col("span") % 2).cast("string"), e.cast("string"))
    pred = F.when(F.col("value") > 80, "view-0-0").otherwise(code(F.col("span") % 5 % 3))
    return spans(spark, d).select("speaker", code(F.col("span") % 3).alias("gold"), pred.alias("pred"))


@query(f"""{CODES}, n as (select speaker, count(*) as n, avg((gold = pred)::int) as accuracy, avg((string_split(gold, '-')[1] = string_split(pred, '-')[1])::int) as tier1, avg((array_to_string(string_split(gold, '-')[1:2], '-') = array_to_string(string_split(pred, '-')[1:2], '-'))::int) as tier2 from g2 group by 1),
  s as (select speaker, l, sum(g) as g, sum(p) as p from (select speaker, gold as l, 1 as g, 0 as p from g2 union all select speaker, pred, 0, 1 from g2) group by all), e as (select speaker, sum(g * p) as gp, max(g) as top, sum(abs(g - p)) / 2 as moved from s group by 1)
  select speaker, n, round(accuracy, 6) as accuracy, round((accuracy - gp / (n * n)) / nullif(1 - gp / (n * n), 0), 6) as kappa, round(top / n, 6) as majority, round(tier1, 6) as tier1, round(tier2, 6) as tier2, round(moved / n, 6) as tvd from n join e using (speaker)""")
def score_block(spark, d):
    """Accuracy, kappa, majority baseline, accuracies of the upper tiers, and the distance of the two distributions."""
    c = _codes(spark, d)
    hit = lambda k: F.avg((tier(F.col("gold"), k) == tier(F.col("pred"), k)).cast("int"))
    n = c.groupBy("speaker").agg(F.count("*").alias("n"), hit(3).alias("accuracy"), hit(1).alias("tier1"), hit(2).alias("tier2"))
    sides = F.explode(F.array(F.struct(F.col("gold").alias("l"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("l"), F.lit(0).alias("g"), F.lit(1).alias("p"))))
    s = c.select("speaker", sides.alias("x")).groupBy("speaker", "x.l").agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"))
    e = s.groupBy("speaker").agg(F.sum(F.col("g") * F.col("p")).alias("gp"), F.max("g").alias("top"), (F.sum(F.abs(F.col("g") - F.col("p"))) / 2).alias("moved"))
    chance = F.col("gp") / (F.col("n") * F.col("n"))
    return n.join(e, "speaker").select("speaker", "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.try_divide(F.col("accuracy") - chance, 1 - chance), 6).alias("kappa"), F.round(F.col("top") / F.col("n"), 6).alias("majority"), *r6("tier1", "tier2"), F.round(F.col("moved") / F.col("n"), 6).alias("tvd"))


@query(f"""{CODES}, k as (select case when gold = pred then '1 exact' when string_split(gold, '-')[1] = string_split(pred, '-')[1] then '2 same tier 1' when pred = 'view-0-0' then '3 folded' else '4 other' end as kind from g2) select kind, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from k group by 1""")
def residual_breakdown(spark, d):
    """What kinds of disagreement are left, as shares of all units."""
    gold, pred = F.col("gold"), F.col("pred")
    kind = F.when(gold == pred, "1 exact").when(tier(gold, 1) == tier(pred, 1), "2 same tier 1").when(pred == "view-0-0", "3 folded").otherwise("4 other")
    n = _codes(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # four rows


@query(f"""{AG}, l as (select gold, pred, case when n_chars <= 500 then '0-500' when n_chars <= 1000 then '501-1000' when n_chars <= 2000 then '1001-2000' else '2001-' end as bin from labels l join documents d using (doc_id) join lateral (select l.quality as gold, (d.n_chars >= 800)::int as pred) x on true)
  select bin, count(*) as n, round(count(*) filter (where gold = 1 and pred = 1) / nullif(count(*) filter (where gold = 1), 0), 6) as recall from l group by 1""")
def length_binned_recall(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    bins = F.when(n <= 500, "0-500").when(n <= 1000, "501-1000").when(n <= 2000, "1001-2000").otherwise("2001-")
    r = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")).join(docs, "doc_id").withColumn("pred", (n >= 800).cast("int"))
    return r.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if((F.col("gold") == 1) & (F.col("pred") == 1)), F.count_if(F.col("gold") == 1)), 6).alias("recall"))


@query(f"""{LN}, two as (select 'gold' as src, conv, gold as label from gp union all select 'pred', conv, pred from gp), n as (select src, case when conv % 2 = 0 then 'x' else 'y' end as side, label, count(*) as n from two group by all), ds as (select *, n / sum(n) over (partition by src, side) as p0 from n),
  al as (select src, label, sum(case when side = 'x' then p0 else 0 end) as p, sum(case when side = 'y' then p0 else 0 end) as q from ds group by all), j as (select src, {JSD} as jsd from al group by 1)
  select round(max(case when src = 'gold' then jsd end), 6) as expert, round(max(case when src = 'pred' then jsd end), 6) as model, round(max(case when src = 'pred' then jsd end) / nullif(max(case when src = 'gold' then jsd end), 0), 6) as kept from j""")
def distance_attenuation(spark, d):
    """The same contrast by expert and by model labels, and the share of the distance that the model keeps."""
    both = F.explode(F.array(F.struct(F.lit("gold").alias("src"), F.col("gold").alias("label")), F.struct(F.lit("pred").alias("src"), F.col("pred").alias("label"))))
    x = _next(spark, d).select(F.when(F.col("conv") % 2 == 0, "x").otherwise("y").alias("condition"), both.alias("z")).select("condition", "z.*")
    j = D.distances(D.aligned(D.distribution(x, "src", "condition"), ["x", "y"], "src"), "src")
    of = lambda s: F.max(F.when(F.col("src") == s, F.col("jsd")))
    return j.agg(F.round(of("gold"), 6).alias("expert"), F.round(of("pred"), 6).alias("model"), F.round(F.try_divide(of("pred"), of("gold")), 6).alias("kept"))


@query(f"{SPANS}, s as (select condition, label as stored, case when value < 20 then 'error' when value < 40 then 'view' else label end as again from spans) select condition, count(*) as n, round(avg((stored = again)::int), 6) as agreement, count(*) filter (where stored <> again) as changed from s group by 1")
def stored_vs_recomputed(spark, d):
    v = F.col("value")
    again = F.when(v < 20, "error").when(v < 40, "view").otherwise(F.col("label"))
    s = spans(spark, d).select("condition", (F.col("label") == again).alias("same"))
    return s.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg(F.col("same").cast("int")), 6).alias("agreement"), F.count_if(~F.col("same")).alias("changed"))
