"""DuckDB forms of the operators on words: decontamination, search and phrases."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
b as (
    select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
),
x as (
    select distinct item, least(10, len(w)) as k, array_to_string(w[i : i + 9], ' ') as t
    from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
),
s as (
    select r, i, k, array_to_string(w[i : i + k - 1], ' ') as t
    from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from x) where len(w) >= k)
),
o as (select r, i, k, item from s join x using (k, t)),
h as (select r, count(distinct i + j) as n_hit from o, (select unnest(range(0, 10)) as j) where j < k group by r),
n as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from o) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join n using (r)
"""

SEARCH = rf"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
),
q as (
    select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark
),
c as (select count(*) as docs, cast(sum(len(w)) as bigint) as words from d where len(w) > 0),
p as (
    select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from d)
    where t in (select t from q) group by r, doc_id, n, t
),
f as (select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as weight from p, c group by t, docs),
s as (
    select item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) as bigint) as score
    from p join f using (t) join q using (t), c group by item_id, r, doc_id
)
select item_id, cast(rank as int) as rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
where rank <= 10
"""

PHRASES = rf"""
with p as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents
),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (
    select lang, k, w[i : i + k - 1] as words
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest([1, 2, 3]) as k) where len(w) >= k)
),
f as (select lang, k, words, count(*) as f from g group by lang, k, words having count(*) >= 10),
n as (select lang, count(*) as n from g where k = 1 group by lang),
cuts as (
    select c.lang, c.words, c.k as length, c.f as a, x.f as l, y.f as r, x.k as cut,
           cast(1000000 as hugeint) * c.f * c.f // (cast(x.f as hugeint) * y.f) as score
    from f c join f x on x.lang = c.lang and x.k < c.k and x.words = c.words[1 : x.k]
    join f y on y.lang = c.lang and y.k = c.k - x.k and y.words = c.words[x.k + 1 : c.k]
),
best as (select * from cuts qualify row_number() over (partition by lang, words order by score, cut) = 1),
part as (select lang, words[j : j + 1] as words, f from (select *, unnest([1, 2]) as j from f where k = 3)),
gone as (select lang, words, max(f) as most from part group by lang, words),
kept as (
    select best.*, array_to_string(best.words, ' ') as phrase from best left join gone on gone.lang = best.lang and gone.words = best.words
    where not (length = 2 and most is not null and 100 * most >= 50 * a)
)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) join n using (lang)
where rank <= 2000
"""
