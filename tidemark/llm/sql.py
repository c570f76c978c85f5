"""SQL twins, for DuckDB, of the queries that SQL can express."""

from tidemark.llm.quality_rules import BARS, BOILERPLATE

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight from s
), l as (
  select *, 2.0::double * source_size as lim, 2.0::double * source_size / weight as level from w
), c as (
  select *, 1.5::double * (select sum(source_size) from s) as total,
    coalesce(sum(lim) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(weight) over () - coalesce(sum(weight) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0) as light
  from l
), h as (
  select *, max(case when (total - filled) / light <= level then (total - filled) / light end) over () as height from c
), t as (
  select source, source_size, least(lim, coalesce(height * weight, lim)) as target from h
), r as (
  select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    ('0x' || substr(md5('mix:' || coalesce(d.source, '\null')), 1, 8))::bigint::double / 4294967296.0::double as u,
    row_number() over (
      partition by d.source
      order by length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint, size, doc_id
    ) as place
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (floor(rate * place + u) - floor(rate * (place - 1) + u))::bigint * size as taken
from r
"""

_BAD_LINE = rf"""
(
  (len(l) - len(replace(l, '!!', ''))) / 2 >= 3 and (len(l) - len(replace(l, '!!', ''))) >= n
  or s >= 3 and s >= n
  or n < 4 and not regexp_matches(l, '[.!?:;,)\]"''”’»…。！？][\x20\x09-\x0D]*$')
  or len(regexp_extract_all(l, '{BARS}')) >= 2 and 3 * len(regexp_extract_all(l, '{BARS}')) >= n
  or regexp_matches(lower(l), '{"|".join(BOILERPLATE)}')
)
"""

OP8 = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents
), g as (
  select r, unnest(range(1, len(words) - 1)) as i, words from d where len(words) >= 3
), k as (
  select r, i, count(*) over (partition by r, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as c from g
), p as (
  select r, count(distinct j)::bigint as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from k where c > 1) group by r
), x as (
  select r, unnest(string_split(t, chr(10))) as l from d
), y as (
  select r, l, len(regexp_extract_all(l, '{WORD}')) as n, len(regexp_extract_all(l, '[#*$%&<>]')) as s from x
), z as (
  select r, (count(*) - count(distinct l))::bigint as n_dup_lines, sum(len(l)) as chars, coalesce(sum(len(l)) filter (where {_BAD_LINE}), 0) as lost
  from y where n > 0 group by r
), b as (
  select doc_id, len(words)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(2 * lost > chars, false) as lost_much
  from d left join p using (r) left join z using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not lost_much as kept
from b
"""

OP11 = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents
), o as (
  select r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
), k as (
  select lang, term, count(*)::hugeint as lang_n from o group by lang, term having count(distinct r) >= 10
), l as (
  select lang, sum(lang_n)::hugeint as lang_total, count(*)::hugeint as v from k group by lang
), c as (
  select o.lang, source, term, count(*)::hugeint as n from o join k using (lang, term) group by o.lang, source, term
), g as (
  select lang, source, coalesce(total, 0)::hugeint as total from (select distinct lang, source from d) left join (select lang, source, sum(n) as total from c group by lang, source) using (lang, source)
), p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v) as p, 1 + (1000000000::hugeint * (lang_n + 2)) // (lang_total + 2 * v) as q
  from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
  ) s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 10
"""

OP12 = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), x as (
  select r, doc_id, string_split(t, chr(10)) as ls from d
), y as (
  select r, doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as l from x
), k as (
  select *, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from y
), c as (
  select key from k where key <> '' group by key having count(distinct r) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped, sha256(coalesce(string_agg(l, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
from k left join c on k.key = c.key group by r, doc_id
"""
