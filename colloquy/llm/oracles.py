"""DuckDB SQL of the corpus queries that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

from colloquy.llm import jaccard, quality

WORDS = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""with d as (select row_number() over () as row, doc_id, lang, coalesce(text, '') as t from documents),
  w as (select *, regexp_extract_all(t, '{WORDS}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) as l from d),
  windows as (select row, unnest(range(1, len(w) - 1)) as i, unnest(list_zip(w[:-3], w[2:-2], w[3:])) as g from w where len(w) >= 3),
  again as (select row, i from (select row, i, count(*) over (partition by row, g) as n from windows) where n > 1),
  covered as (select row, count(distinct i + k) as n from again, range(3) r(k) group by 1),
  c as (select row, doc_id, lang, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines
    from w left join covered using (row)),
  b as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from c),
  v as (select row, lang, base_failed, unnest(['symbols', 'lines', 'words']) as rule, unnest([n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1)]) as v from b),
  good as (select v.lang, rule, v from v join b using (row) join labels l on l.doc_id = b.doc_id where not v.base_failed and quality = 1),
  grid as (select unnest({list(quality.GRID)}::double[]) as cutoff, unnest(range({len(quality.GRID)})) as place),
  k as (select lang, rule, place, cutoff, count(*) as n, count(*) filter (where v > cutoff) as k from good, grid group by all),
  level as (select {quality.DELTA} / (3 * greatest(1, count(*))) as level from (select distinct lang from good)),
  p as (select {quality.RISK} / 3 as p),
  tail as (select lang, rule, place, cutoff, k <= n * p and list_sum(list_transform(range(case when k <= n * p then k + 1 else 1 end), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)))) <= level as ok from k, level, p),
  stopped as (select *, coalesce(min(place) filter (where not ok) over (partition by lang, rule), 99) as stop from tail),
  cut as (select lang, rule, min(cutoff) as cutoff from stopped where place < stop group by all),
  rejected as (select distinct row from v join cut on v.rule = cut.rule and v.lang is not distinct from cut.lang where v > cutoff)
  select doc_id, n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and row not in (select row from rejected) as kept from b"""

#: Equal sets are joined once, as one class; links between classes are counted by their common shingles.
JACCARD = rf"""with recursive w as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
  s as (select row, doc_id, case when len(w) = 0 then [] when len(w) < {jaccard.SHINGLE} then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(list_zip({', '.join(f'w[{i + 1}:{i - jaccard.SHINGLE}]' for i in range(jaccard.SHINGLE - 1))}, w[{jaccard.SHINGLE}:]), lambda x: {" || ' ' || ".join(f'x[{i + 1}]' for i in range(jaccard.SHINGLE))}))) end as s from w),
  class as (select s, row_number() over () as c, min(doc_id) as low from s where len(s) > 0 group by s),
  g as (select c, len(s) as n, unnest(s) as g from class),
  links as (select a.c as a, b.c as b from g a join g b using (g) where a.c <> b.c group by a.c, b.c, a.n, b.n having 100 * count(*) >= {jaccard.PERCENT} * (a.n + b.n - count(*))),
  reach as (select c as a, c as b from class union select r.a, l.b from reach r join links l on r.b = l.a),
  root as (select a as c, min(low) as component_id from reach join class on class.c = reach.b group by 1)
  select doc_id, len(s)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id from s left join class using (s) left join root using (c)"""

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": QUALITY, "op10_ngram_jaccard": JACCARD}
