"""DuckDB form of the quality rules, from the same word lists and thresholds."""

from __future__ import annotations

from tipoff.llm.rules import COMMON_WORDS, LANGS, Rules


def _words() -> str:
    rows = []
    for lang in LANGS:
        words = COMMON_WORDS.get(lang) or tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
        rows += [f"('{lang}', '{form}', {slot})" for slot, w in enumerate(words) for form in dict.fromkeys((w, w.capitalize()))]
    return ", ".join(rows)


def _distance(name: str, counts: str) -> str:
    """Distance of a document's counts (r, slot, n) to its language's, over all slots."""
    return f"""{name}_q as (select lang, slot, sum(n) as n from {counts} join b using (r) join d using (r) group by lang, slot),
{name}_s as (select d.r, q.slot, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) over (partition by d.r) as p, q.n / sum(q.n) over (partition by d.r) as q
  from d join {name}_q q using (lang) left join {counts} c on c.r = d.r and c.slot = q.slot where d.n_words >= {Rules.guard_words}),
{name} as (select r, round(sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)), 6) as distance from {name}_s group by r)"""


SQL = rf"""
with l(lang, x, slot) as (values {_words()}),
w as (select row_number() over () as r, doc_id, coalesce(text, '') as t, case when lang in ('en', 'de', 'fr', 'es') then lang else 'other' end as lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
d as (select r, doc_id, lang, ws, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, t from w),
g as (select r, i, array_to_string(ws[i : i + 4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
u as (select r, g from g group by r, g having count(*) > 1),
v as (select r, count(distinct i + k) as n from g join u using (r, g), (select unnest(range(0, 5)) as k) group by r),
b as (select r from d left join v using (r) where not (n_words < {Rules.min_words} or 100 * coalesce(v.n, 0) > {Rules.repeat_percent} * n_words)),
k as (select r, length(t) as a, length(regexp_replace(t, '[^a-z]', '', 'g')) as c0, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as c1, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as cl,
  length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) as c3, length(regexp_replace(t, '[^\t\x0B\x0C\r \x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')) as c4, length(regexp_replace(t, '[^\n]', '', 'g')) as c5,
  length(regexp_replace(t, '[^\p{{P}}]', '', 'g')) as cp, length(regexp_replace(t, '[^#*%&]', '', 'g')) as cx, length(regexp_replace(t, '[^\p{{S}}]', '', 'g')) as cs from d),
cc as (select r, unnest(range(0, 9)) as slot, unnest([c0, c1, cl - c0 - c1, c3, c4, c5, cp - cx, cs + cx, a - cl - c3 - c4 - c5 - cp - cs]) as n from k),
wf as (select r, slot, count(*) as n from (select r, lang, unnest(ws) as x from d) join l using (lang, x) group by r, slot),
wc as (select r, slot, n from wf union all select d.r, 1000, n_words - coalesce(sum(n), 0) from d left join wf on wf.r = d.r group by d.r, n_words),
{_distance("dc", "cc")},
{_distance("dw", "wc")}
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(v.n, 0) as bigint) as n_repeat_words,
  n_words < {Rules.min_words} or 100 * coalesce(v.n, 0) > {Rules.repeat_percent} * n_words as base_failed,
  not (n_words < {Rules.min_words} or 100 * coalesce(v.n, 0) > {Rules.repeat_percent} * n_words) and coalesce(dc.distance, 0) <= {Rules.max_class_distance} and coalesce(dw.distance, 0) <= {Rules.max_word_distance} as kept,
  cast(coalesce(dc.distance, 0) as double) as class_distance, cast(coalesce(dw.distance, 0) as double) as word_distance
from d left join v using (r) left join dc using (r) left join dw using (r)
"""
