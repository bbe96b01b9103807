"""Queries of projections, lookups, accounting, reshaping and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.scalar import first_sentence, final_punctuation, plain_key, role, role_prefixed, speaker_origin, timestamp_of, unquoted, without_headers, words
from colloquy.operators import ordering as O
from colloquy.operators import reshape
from colloquy.operators import sequences as S
from colloquy.plans.catalogue import SPANS, TR, query, r6
from colloquy.sources.tables import spans, table


# -- projections and filters ------------------------------------------------------------------------------


@query("select case when starts_with(source, 'src') then 'web' else 'other' end as kind, case when contains(source, '_') then string_split(source, '_')[2] else source end as arm, count(*) as n from documents group by all")
def condition_mapping(spark, d):
    """A condition is mapped by its prefix, and an arm is what follows the separator."""
    kind = F.when(F.startswith("source", F.lit("src")), "web").otherwise("other")
    arm = F.when(F.contains("source", F.lit("_")), F.split("source", "_")[1]).otherwise(F.col("source"))
    return table(spark, d, "documents").groupBy(kind.alias("kind"), arm.alias("arm")).agg(F.count("*").alias("n"))


@query("""with r as (select case when lower(trim(role)) in ('user') then 'Client' else 'Counsellor' end as speaker, case when conv_id % 2 = 0 then 'human_human' else 'human_llm' end as grp, text from conversations)
  select speaker, case when grp <> 'human_human' and speaker = 'Client' then 'llm' else 'human' end as origin, count(*) as n, sum(length(speaker || ': ' || text))::bigint as chars from r group by all""")
def roles_and_origin(spark, d):
    rows = table(spark, d, "conversations").select(role(F.col("role"), ["user"]).alias("speaker"), F.when(F.col("conv_id") % 2 == 0, "human_human").otherwise("human_llm").alias("grp"), "text")
    rows = rows.withColumn("origin", speaker_origin(F.col("grp"), F.col("speaker"))).withColumn("chars", F.length(role_prefixed(F.col("text"), F.col("speaker"))))
    return rows.groupBy("speaker", "origin").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(f"""{SPANS}, m as (select condition, conv, ts::date as day, arg_min(label, span) as label from spans group by all), u as (select 'span' as unit, condition, label from spans union all select 'message', condition, label from m)
  select unit, condition, label, count(*) as n from u group by all""")
def unit_switch(spark, d):
    """Labels of messages or of their spans, from one nested table."""
    messages = reshape.nested(spans(spark, d).withColumn("day", F.col("ts").cast("date")), ["condition", "conv", "day"], ["span", "label"])
    out = None
    for unit in ("span", "message"):
        labels = F.col("records.label") if unit == "span" else F.array(F.col("records")[0]["label"])
        rows = messages.select(F.lit(unit).alias("unit"), "condition", F.explode(labels).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("unit", "condition", "label").agg(F.count("*").alias("n"))


SETS = {"S1": ["error"], "S2": ["error", "signup"], "S3": ["error", "signup", "purchase", "view"]}


@query(f"{SPANS}, sets(name, label) as (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{x}{chr(39)})' for k, v in SETS.items() for x in v)}), names as (select distinct name from sets), kept as (select name, condition, conv, s.label from spans s, names where not exists (select 1 from sets where sets.name = names.name and sets.label = s.label)) select name, condition, count(distinct conv) as convs, count(*) as n from kept group by all")
def category_exclusion(spark, d):
    """What is left of each condition under growing exclusion sets; conversations left empty drop out."""
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.lit(x) for x in v]).alias("labels")) for k, v in SETS.items()]))
    kept = spans(spark, d).select("condition", "conv", "label", sets.alias("s")).where(~F.array_contains("s.labels", F.col("label")))
    return kept.groupBy(F.col("s.name").alias("name"), "condition").agg(F.countDistinct("conv").alias("convs"), F.count("*").alias("n"))


@query(f"""{SPANS}, k as (select t, condition, speaker, count(*) as n from spans, (values (0.0), (0.7), (0.9), (0.99)) v(t) where value / 100 >= t group by all), ok as (select t from k group by 1 having count(*) = 6 and min(n) >= 5)
  select t::double as threshold, condition, speaker, n from k join ok using (t)""")
def confidence_thresholds(spark, d):
    """Cells under rising confidence thresholds; a threshold with a missing or small cell is left out whole."""
    at = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.7, 0.9, 0.99)]))
    k = spans(spark, d).select("condition", "speaker", "value", at.alias("threshold")).where("value / 100 >= threshold").groupBy("threshold", "condition", "speaker").agg(F.count("*").alias("n"))
    ok = k.groupBy("threshold").agg(F.count("*").alias("cells"), F.min("n").alias("least")).where("cells = 6 and least >= 5")
    return k.join(ok.select("threshold"), "threshold")


@query(f"{SPANS}, failed as (select conv, span from spans where speaker = 'Client' and value < 5) select condition, speaker, count(*) as n from spans s where not exists (select 1 from failed f where f.conv = s.conv and f.span = s.span) group by all")
def drop_ungenerated(spark, d):
    s = spans(spark, d)
    failed = s.where("speaker = 'Client' and value < 5").select("conv", "span")
    return s.join(failed, ["conv", "span"], "left_anti").groupBy("condition", "speaker").agg(F.count("*").alias("n"))


FLAGS = {"brief": "(?i)(kurz|brief|short|court|corto)", "german": "(?i)(^|[^a-z])(der|die|und|nicht)([^a-z]|$)", "meta": "(?i)(as an ai|language model|persona)"}


@query(f"select lang, {', '.join(f'count(*) filter (where regexp_matches(text, {chr(39)}{v}{chr(39)})) as {k}' for k, v in FLAGS.items())} from documents group by 1")
def text_flags(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(*[F.count_if(F.col("text").rlike(v)).alias(k) for k, v in FLAGS.items()])


SIGNS = ("steel", "tin", "brass", "copper", "nickel", "small", "large", "promo")


@query(f"select p_brand, {', '.join(f'bool_or(contains(lower(p_name), {chr(39)}{s}{chr(39)})) as has_{s}' for s in SIGNS)}, count(*) as n from part group by 1")
def signature_predicates(spark, d):
    """Eight predicates on a label's text, and whether any row of a group has them."""
    name = F.lower("p_name")
    return table(spark, d, "part").groupBy("p_brand").agg(*[F.bool_or(F.contains(name, F.lit(s))).alias(f"has_{s}") for s in SIGNS], F.count("*").alias("n"))


TEXTS = {"click": "Clicked", "view": "Viewed a page", "purchase": "Bought"}


@query(f"select coalesce(map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in TEXTS.items())}}}[event_type], upper(event_type)) as shown, count(*) as n from events group by 1")
def label_text(spark, d):
    """A code's display text; codes without one are shown in capitals."""
    texts = F.create_map(*[F.lit(x) for kv in TEXTS.items() for x in kv])
    return table(spark, d, "events").groupBy(F.coalesce(F.try_element_at(texts, F.col("event_type")), F.upper("event_type")).alias("shown")).agg(F.count("*").alias("n"))


@query(f"{SPANS}, f as (select conv, min(span) as first from spans group by 1) select conv, 'C' || lpad(row_number() over (order by first)::varchar, 3, '0') as code from f")
def stable_codes(spark, d):
    """Codes by first appearance, numbered without a single task's sort."""
    first = spans(spark, d).groupBy("conv").agg(F.min("span").alias("first"))
    return O.numbered(first, "first").select("conv", F.concat(F.lit("C"), F.lpad((F.col("nth") + 1).cast("string"), 3, "0")).alias("code"))


@query("select source, count(*) filter (where length(text) = 0) as empty, count(*) filter (where regexp_matches(text, '[.!?…][\"''»“”)\\]]*[ \\n]*$')) as ended, sum(length(trim(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))))::bigint as key_chars from documents group by 1")
def text_keys(spark, d):
    rows = table(spark, d, "documents").select("source", "text")
    return rows.groupBy("source").agg(F.count_if(F.length("text") == 0).alias("empty"), F.count_if(final_punctuation(F.col("text"))).alias("ended"), F.sum(F.length(plain_key(F.col("text")))).alias("key_chars"))


@query("""with s as (select conv_id, turn, trim(regexp_extract(text, '^([^.!?\n]*[.!?]?)', 1)) as s, text from conversations)
  select conv_id, turn, case when length(s) > 40 then rtrim(substring(s, 1, 39)) || '…' else s end as head, length(array_to_string(list_filter(string_split(text, chr(10)), lambda l: not starts_with(l, 'The')), chr(10)))::int as kept,
  regexp_replace(regexp_replace(trim('Client: "' || s || '"'), '^Client\\s*:\\s*', ''), '^["“„]|["”“]$', '', 'g') as bare from s""")
def text_cleanup(spark, d):
    rows = table(spark, d, "conversations")
    s = F.trim(F.regexp_extract("text", "^([^.!?\n]*[.!?]?)", 1))
    said = F.concat(F.lit('Client: "'), s, F.lit('"'))
    return rows.select("conv_id", "turn", first_sentence(F.col("text"), 40).alias("head"), F.length(without_headers(F.col("text"), ["The"])).alias("kept"), unquoted(said, "Client").alias("bare"))


@query("""select event_id, strftime(ts, '%Y-%m') as month, strftime(ts, '%d.%m.%Y %H:%M') as shown from events""")
def timestamp_formats(spark, d):
    """Time stamps written in several formats and read back with fallbacks."""
    e = table(spark, d, "events").select("event_id", "ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm"))
    read = timestamp_of(text)
    return e.select("event_id", F.date_format(read, "yyyy-MM").alias("month"), F.date_format(read, "dd.MM.yyyy HH:mm").alias("shown"))


@query("""select event_id, json_extract_string(props, '$.k')::int as k, '["' || event_type || '","' || user_id || '"]' as packed, 2 as items from events""")
def json_columns(spark, d):
    """A JSON column read, and a list column written and read back."""
    e = table(spark, d, "events")
    packed = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), packed.alias("packed"), F.size(F.from_json(packed, "array<string>")).alias("items"))


# -- lookups ----------------------------------------------------------------------------------------------


@query("with m as (select c_custkey as id, c_mktsegment as persona from customer where c_custkey % 3 <> 0) select coalesce(persona, '') as persona, count(*) as n from (select distinct user_id from events) e left join m on m.id = e.user_id group by 1")
def persona_metadata_join(spark, d):
    """Conversations with their persona; those without one get the empty text."""
    meta = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("persona"))
    convs = table(spark, d, "events").select("user_id").distinct()
    return convs.join(meta, "user_id", "left").groupBy(F.coalesce("persona", F.lit("")).alias("persona")).agg(F.count("*").alias("n"))


@query("select lang, count(*) as n, round(avg(length(c.text)), 6) as chars, round(avg(n_chars), 6) as doc_chars from conversations c left join documents on doc_id = conv_id group by 1")
def prompt_meta_on_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang", "n_chars")
    got = table(spark, d, "conversations").join(docs, "conv_id", "left").groupBy("lang")
    return got.agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("chars"), F.round(F.avg("n_chars"), 6).alias("doc_chars"))


@query(f"""{SPANS}, l as (select condition, conv, span, label from spans where value > 30) select s.condition, coalesce(l.label, 'none') as attached, count(*) as n from spans s left join l on s.condition = l.condition and s.conv = l.conv and s.span = l.span group by all""")
def label_attach(spark, d):
    s = spans(spark, d)
    labels = s.where("value > 30").select("condition", "conv", "span", F.col("label").alias("attached"))
    return s.select("condition", "conv", "span").join(labels, ["condition", "conv", "span"], "left").groupBy("condition", F.coalesce("attached", F.lit("none")).alias("attached")).agg(F.count("*").alias("n"))


@query("select n_name as course, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def lookup_asserted(spark, d):
    """A lookup that fails when a key has no entry."""
    found = reshape.asserted_lookup(table(spark, d, "customer"), table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("course")), ["c_nationkey"], "course")
    return found.groupBy("course").agg(F.count("*").alias("n"))


@query(f"{SPANS}, sheet as (select span as unit, label as coded from spans where span % 7 = 0), hidden as (select span as unit, condition, case when value > 50 then 'click' else label end as gold from spans where span % 14 = 0) select condition, count(*) as n, count(*) filter (where coded = gold) as hits from sheet join hidden using (unit) group by 1")
def blind_key_join(spark, d):
    s = spans(spark, d)
    sheet = s.where("span % 7 = 0").select(F.col("span").alias("unit"), F.col("label").alias("coded"))
    hidden = s.where("span % 14 = 0").select(F.col("span").alias("unit"), "condition", F.when(F.col("value") > 50, "click").otherwise(F.col("label")).alias("gold"))
    return sheet.join(hidden, "unit").groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("coded") == F.col("gold")).alias("hits"))


@query("select l.doc_id, quality, (n_chars >= 800)::int as pred from labels l left join documents d on d.doc_id = l.doc_id and lang <> 'de'")
def reattach_predictions(spark, d):
    pred = table(spark, d, "documents").where("lang <> 'de'").select("doc_id", (F.col("n_chars") >= 800).cast("int").alias("pred"))
    return table(spark, d, "labels").select("doc_id", "quality").join(pred, "doc_id", "left")


@query(f"""{SPANS}, g as (select condition as arm, conv, span, case when value > 90 then null else 'new ' || label end as made from spans where speaker = 'Client' and value > 20)
  select condition, case when speaker <> 'Client' then 'kept' when g.span is null then 'missing' when made is null then 'failed' else 'replaced' end as status, count(*) as n, count(*) filter (where coalesce(made, label) <> label) as changed
  from spans s left join g on g.arm = s.condition and g.conv = s.conv and g.span = s.span group by all""")
def replay_replacement(spark, d):
    """A generated turn replaces the original; the status says what became of each."""
    s = spans(spark, d)
    made = s.where("speaker = 'Client' and value > 20").select("condition", "conv", "span", F.when(F.col("value") <= 90, F.concat(F.lit("new "), "label")).alias("made"), F.lit(True).alias("tried"))
    status = F.when(F.col("speaker") != "Client", "kept").when(F.col("tried").isNull(), "missing").when(F.col("made").isNull(), "failed").otherwise("replaced")
    got = s.join(made, ["condition", "conv", "span"], "left").withColumn("status", status)
    return got.groupBy("condition", "status").agg(F.count("*").alias("n"), F.count_if(F.coalesce("made", "label") != F.col("label")).alias("changed"))


@query(f"{SPANS}, a as (select condition, count(*) as n from spans group by 1), b as (select condition, round(avg(value), 6) as mean from spans where speaker = 'Client' group by 1) select condition, n, mean, round(mean / n, 9) as ratio from a join b using (condition)")
def report_lookup(spark, d):
    s = spans(spark, d)
    a = s.groupBy("condition").agg(F.count("*").alias("n"))
    b = s.where("speaker = 'Client'").groupBy("condition").agg(F.round(F.avg("value"), 6).alias("mean"))
    return a.join(b, "condition").withColumn("ratio", F.round(F.col("mean") / F.col("n"), 9))


# -- accounting -------------------------------------------------------------------------------------------


@query("with k as (select lang, quality as gold, (n_chars >= 800)::int as pred from labels join documents using (doc_id)), c as (select lang, gold, pred, count(*) as n from k where gold <> pred group by all) select lang, gold, pred, n, round(n / sum(n) over (), 6) as share from c order by n desc, lang, gold, pred limit 40")
def confusion_share(spark, d):
    """The most frequent confusions, and their share of all errors."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") >= 800).cast("int").alias("pred"))
    wrong = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")).join(docs, "doc_id").where("gold <> pred")
    c = wrong.groupBy("lang", "gold", "pred").agg(F.count("*").alias("n"))  # a row a cell: the window is as small
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6)).orderBy(F.desc("n"), "lang", "gold", "pred").limit(40)


@query("select source, array_to_string(list_sort(list(distinct lang)), ',') as langs, arg_min(doc_id, doc_id) as first_doc, max(n_chars) as longest, arg_max(doc_id, (n_chars, -doc_id)) as longest_doc from documents group by 1")
def set_first_max(spark, d):
    longest = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return table(spark, d, "documents").groupBy("source").agg(F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("langs"), F.min("doc_id").alias("first_doc"), F.max("n_chars").alias("longest"), longest.alias("longest_doc"))


@query("""with s as (select d.source, case when length(trim(d.text)) = 0 then '1 empty' when l.quality = 0 then '2 poor' when l.toxic = 1 then '3 toxic' when n_chars < 100 then '4 short' else '5 kept' end as step from documents d left join (select distinct doc_id, quality, toxic from labels) l using (doc_id))
  select source, step, count(*) as n, (sum(count(*)) over (partition by source order by step desc))::bigint as reached from s group by source, step""")
def exclusion_accounting(spark, d):
    """How many documents of each source each step removes, in order, and how many reached it."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic").distinct()
    step = F.when(F.length(F.trim("text")) == 0, "1 empty").when(F.col("quality") == 0, "2 poor").when(F.col("toxic") == 1, "3 toxic").when(F.col("n_chars") < 100, "4 short").otherwise("5 kept")
    n = table(spark, d, "documents").join(labels, "doc_id", "left").groupBy("source", step.alias("step")).agg(F.count("*").alias("n"))
    return n.withColumn("reached", F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("step"))))


@query(f"{SPANS} select label, min(strftime(ts, '%Y-%m-%d')) as first_day, count(distinct conv) as convs from spans group by 1")
def first_seen(spark, d):
    return spans(spark, d).groupBy("label").agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("first_day"), F.countDistinct("conv").alias("convs"))


@query(f"""{SPANS}, k as (select condition, label, row_number() over (partition by condition order by md5(span || '|strata'), span) as nth, count(*) over (partition by condition) as population from spans),
  s as (select condition, label, population / 20 as w from k where nth <= 20) select label, count(*) as sampled, round(sum(w), 6) as weighted from s group by 1""")
def stratum_weighted(spark, d):
    """Counts of a stratified sample, weighted back to the population."""
    from colloquy.operators import resampling as R

    s = spans(spark, d)
    picked = R.stratified_sample(s, "condition", "span", 20, "strata").select("condition", "span", "population")
    return s.join(picked, ["condition", "span"]).groupBy("label").agg(F.count("*").alias("sampled"), F.round(F.sum(F.col("population") / 20), 6).alias("weighted"))


SEGMENTS = """with s as (select role, conv_id, turn, unnest(list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '')) as span from conversations), w as (select *, len(string_split_regex(span, ' +')) as n from s)"""


def _segments(spark, d):
    pieces = F.filter(F.transform(F.split("text", "\\. "), F.trim), lambda x: x != "")
    return table(spark, d, "conversations").select("role", "conv_id", "turn", F.explode(pieces).alias("span")).withColumn("n", words(F.col("span")))


@query(f"{SEGMENTS} select role, round(count(*) / count(distinct conv_id || '-' || turn), 6) as spans_a_message, round(avg(n), 6) as words_a_span, round(avg((n <= 1)::int), 6) as single, round(avg(regexp_matches(span, '^[a-z]')::int), 6) as lower_start from w group by 1")
def segmentation_profile(spark, d):
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    per = F.count("*") / F.countDistinct(F.concat_ws("-", "conv_id", "turn"))
    return _segments(spark, d).groupBy("role").agg(F.round(per, 6).alias("spans_a_message"), F.round(F.avg("n"), 6).alias("words_a_span"), share(F.col("n") <= 1, "single"), share(F.col("span").rlike("^[a-z]"), "lower_start"))


@query("select role, round(avg((case when trim(text) = '' then 0 else len(string_split_regex(trim(text), ' +')) end > 20)::int), 6) as wordy, round(avg(contains(text, chr(10))::int), 6) as paragraphs, round(avg(regexp_matches(text, '(?i)(persona|language model)')::int), 6) as meta, round(avg(starts_with(text, 'The')::int), 6) as echo from conversations group by 1")
def compliance_shares(spark, d):
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    t = F.col("text")
    return table(spark, d, "conversations").groupBy("role").agg(share(words(t) > 20, "wordy"), share(F.contains(t, F.lit("\n")), "paragraphs"), share(t.rlike("(?i)(persona|language model)"), "meta"), share(F.startswith(t, F.lit("The")), "echo"))


@query(f"{SPANS}, r as (select condition, value / 100 as conf, label = lag(label) over (partition by conv order by ts, span) as again from spans), m as (select condition, avg(coalesce(again, false)::int) as repeated, avg(conf) as conf from r group by 1) select condition, round(repeated, 6) as repeated, round(conf, 6) as confidence, round(2 * (1 - repeated) * conf / (1 - repeated + conf), 6) as score from m")
def repeat_confidence(spark, d):
    """The rate at which a label repeats the one before, mean confidence, and the harmonic mean of both."""
    again = F.coalesce(F.col("label") == F.lag("label").over(Window.partitionBy("conv").orderBy("ts", "span")), F.lit(False)).cast("int")
    m = spans(spark, d).select("condition", (F.col("value") / 100).alias("conf"), again.alias("again")).groupBy("condition").agg(F.avg("again").alias("repeated"), F.avg("conf").alias("confidence"))
    fresh = 1 - F.col("repeated")
    return m.withColumn("score", F.round(2 * fresh * F.col("confidence") / (fresh + F.col("confidence")), 6)).select("condition", *r6("repeated", "confidence"), "score")


PII = {"mail": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+", "phone": "[+]?[0-9][0-9 ()/-]{7,}[0-9]", "url": "https?://[^ ]+"}


@query("select source, " + ", ".join(f"sum(len(regexp_extract_all(text, '{v}')))::bigint as {k}" for k, v in PII.items()) + " from documents group by 1")
def pii_statistics(spark, d):
    found = [F.sum(F.size(F.regexp_extract_all("text", F.lit(v), F.lit(0)))).alias(k) for k, v in PII.items()]
    return table(spark, d, "documents").groupBy("source").agg(*found)


@query(f"""{SPANS}, o as (select *, row_number() over (partition by condition, conv, speaker order by ts, span) - 1 as i, count(*) over (partition by condition, conv, speaker) as n from spans),
  e as (select condition, label, least(floor(case when n <= 1 then 0 else i / (n - 1) end * 10), 9)::int as decile from o), s as (select condition, decile, avg((label in ('click', 'view'))::int) as share from e group by all)
  select condition, round(max(share), 6) as peak, arg_max(decile, (round(share, 9), -decile)) as peak_decile from s group by 1""")
def peak_decile(spark, d):
    from colloquy.operators import distributions as D

    rows = D.deciles(spans(spark, d), "condition", "conv", "speaker")
    s = rows.groupBy("condition", "decile").agg(F.avg(F.col("label").isin("click", "view").cast("int")).alias("share"))
    return s.groupBy("condition").agg(F.round(F.max("share"), 6).alias("peak"), F.max_by("decile", F.struct(F.round("share", 9), -F.col("decile"))).alias("peak_decile"))


@query("with e as (select user_id % 4 as run, date_trunc('day', ts)::date as epoch, avg(value) as score from events group by all) select run, arg_max(epoch, (round(score, 9), -epoch_us(epoch::timestamp))) as best_epoch, round(max(score), 6) as score from e group by 1")
def best_epoch(spark, d):
    """The epoch with the best evaluation; the earliest among equals."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("run"), F.to_date("ts").alias("epoch")).agg(F.avg("value").alias("score"))
    return e.groupBy("run").agg(F.max_by("epoch", F.struct(F.round("score", 9), -F.unix_date("epoch"))).alias("best_epoch"), F.round(F.max("score"), 6).alias("score"))


# -- order, limits, sets ----------------------------------------------------------------------------------


@query(f"""{TR}, c as (select *, max(n) over (partition by condition) >= 1000000 as enough from tr), k as (select *, row_number() over (partition by condition order by n desc, source, target) as r from c where n >= case when enough then 1000000 else 1 end) select condition, source, target, n from k where r <= 3""")
def top_transitions_fallback(spark, d):
    """Top transitions from a least count; a condition that has none falls back to all."""
    rows = S.transitions(spans(spark, d))
    enough = F.max("n").over(Window.partitionBy("condition")) >= 1_000_000
    kept = rows.withColumn("enough", enough).where("n >= if(enough, 1000000, 1)")
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("condition").orderBy(F.desc("n"), "source", "target"))).where("r <= 3").select("condition", "source", "target", "n")


@query("(select 'largest' as kind, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5) union all (select 'smallest', o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 5)")
def largest_smallest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    end = lambda kind, by: o.orderBy(by, "o_orderkey").limit(5).select(F.lit(kind).alias("kind"), "*")
    return end("largest", F.desc("o_totalprice")).unionByName(end("smallest", F.asc("o_totalprice")))


@query("""with m as (select conv_id, turn, case when turn % 4 = 3 then 'x' else turn::varchar end as num, role from conversations)
  select conv_id, turn, row_number() over (partition by conv_id order by coalesce(try_cast(num as int), 1000000000), role, turn)::int as place from m""")
def message_order(spark, d):
    """Messages by number; those without a readable number come last, by a second key."""
    num = F.when(F.col("turn") % 4 == 3, "x").otherwise(F.col("turn").cast("string"))
    w = Window.partitionBy("conv_id").orderBy(F.coalesce(num.try_cast("int"), F.lit(10**9)), "role", "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"))


@query("select user_id as key, count(*) as n from events group by 1 having count(*) > 1")
def duplicate_keys(spark, d):
    return reshape.duplicates(table(spark, d, "events"), "user_id").select(F.col("user_id").alias("key"), "n")


@query("select event_id, user_id, event_type from (select * from events order by ts, event_id limit 200 offset 50) order by ts, event_id limit 120")
def slice_then_cap(spark, d):
    """Offset, then limit, then a cap; the order of the steps counts."""
    return O.sliced(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["ts", "event_id"], offset=50, limit=200, cap=120).select("event_id", "user_id", "event_type")


@query("select event_id, nth from (select event_id, row_number() over (order by ts, event_id) - 1 as nth from events) where nth % 5 = 2")
def shard_rows(spark, d):
    """Every fifth row from the third on, by distributed row numbers."""
    return O.shard(table(spark, d, "events").select("event_id", "ts"), 2, 5, "ts", "event_id").select("event_id", "nth")


# -- reshaping --------------------------------------------------------------------------------------------

LABELS = ["click", "error", "purchase", "signup", "view"]


@query(f"{SPANS} select condition, speaker, " + ", ".join(f"round(coalesce(avg(value) filter (where label = '{x}'), 0), 6) as {x}" for x in LABELS) + " from spans group by all")
def pivot_means(spark, d):
    return reshape.pivoted(spans(spark, d), ["condition", "speaker"], "label", LABELS, lambda: F.round(F.avg("value"), 6))


@query(f"{SPANS} select conv, " + ", ".join(f"count(*) filter (where label = '{x}') as {x}" for x in LABELS) + " from spans group by 1")
def unstack_counts(spark, d):
    return reshape.pivoted(spans(spark, d), ["conv"], "label", LABELS, lambda: F.count(F.lit(1)))


@query(f"{SPANS}, l(label) as (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) select c.condition, l.label, count(s.span) as n from (select distinct condition from spans) c cross join l left join spans s on s.condition = c.condition and s.label = l.label group by all")
def stack_long(spark, d):
    wide = reshape.pivoted(spans(spark, d), ["condition"], "label", LABELS, lambda: F.count(F.lit(1)))
    return reshape.stacked(wide, ["condition"], LABELS, "label", "n")


@query(f"{SPANS} select conv, ts::date as day, count(*)::int as n, array_to_string(list(label order by ts, span), '>') as path from spans group by all")
def nested_records(spark, d):
    """Spans grouped back under their message, in order."""
    rows = reshape.nested(spans(spark, d).withColumn("day", F.col("ts").cast("date")), ["conv", "day"], ["ts", "span", "label"])
    return rows.select("conv", "day", F.size("records").alias("n"), F.concat_ws(">", F.col("records.label")).alias("path"))


@query(f"{SPANS}, c as (select distinct label from spans), k as (select label, row_number() over (order by label) as code from c) select s.condition, s.conv, array_to_string(list(k.code::varchar order by ts, span), ' ') as sheet from spans s join k using (label) group by all")
def reference_sheet(spark, d):
    """Conversations as sequences of dictionary codes."""
    codes = O.numbered(spans(spark, d).select("label").distinct(), "label").select("label", (F.col("nth") + 1).cast("string").alias("code"))
    rows = reshape.nested(spans(spark, d).join(codes, "label"), ["condition", "conv"], ["ts", "span", "code"])
    return rows.select("condition", "conv", F.concat_ws(" ", F.col("records.code")).alias("sheet"))


@query("""with e as (select vec_id, label, embedding from embeddings), x as (select label, unnest(range(1, 65)) as i, unnest(embedding)::double as v from e) select label, i::int as i, round(avg(v), 5) as mean from x group by all""")
def mean_pool(spark, d):
    """Mean pooling of vectors by group."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    return x.groupBy("label", (F.col("p") + 1).alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query("""with a as (select conv_id, turn, list_transform(string_split(text, '. '), lambda x: length(x)) as o from conversations), b as (select conv_id, turn, list_transform(string_split(replace(text, '! ', '. '), '. '), lambda x: length(x)) as o from conversations)
  select round(avg((a.o = b.o)::int), 6) as identical, count(*) as n from a join b using (conv_id, turn)""")
def segmentation_reproducible(spark, d):
    """The share of messages that two segmentations cut at the same places."""
    c = table(spark, d, "conversations")
    cut = lambda t: F.transform(F.split(t, "\\. "), F.length)
    a, b = cut(F.col("text")), cut(F.replace("text", F.lit("! "), F.lit(". ")))
    return c.agg(F.round(F.avg((a == b).cast("int")), 6).alias("identical"), F.count("*").alias("n"))
