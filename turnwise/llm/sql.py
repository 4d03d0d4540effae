"""SQL counterparts of the text queries."""

from __future__ import annotations

from turnwise.llm.quality_rules import RULES

# the engine that checks wants a flag to replace all matches, and single backslashes
_REJECTS = " or ".join(f"({r.condition})" for r in RULES).replace(", '')", ", '', 'g')").replace("\\\\p", "\\p")

QUALITY_RULES = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
win as (select r, i, array_to_string(words[i:i+4], ' ') as win
  from (select r, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
rep as (select r, i from win qualify count(*) over (partition by r, win) > 1),
cov as (select r, count(distinct i + k) as n_repeat_words
  from rep, (values (0), (1), (2), (3), (4)) t(k) group by r),
m as (select w.doc_id, w.text, cast(len(words) as bigint) as n_words,
  cast(length(array_to_string(words, '')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(lines) as bigint) as n_lines
  from w left join cov using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({_REJECTS}) as kept from b"""

DECONTAMINATION = """
with d as (select row_number() over () as r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
b as (select cast(item_id as varchar) as item,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark where text is not null and item_id is not null),
bw as (select distinct item, least(13, len(words)) as m,
  array_to_string(words[i:i + least(13, len(words)) - 1], ' ') as win
  from (select item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) as i from b where len(words) > 0)),
sizes as (select distinct m from bw),
dw as (select r, m, i, array_to_string(words[i:i + m - 1], ' ') as win
  from (select r, words, m, unnest(range(1, len(words) - m + 2)) as i from d, sizes where len(words) >= m)),
hit as (select dw.r, dw.m, dw.i, bw.item from dw join bw using (m, win)),
words_hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as joined
  from (select distinct r, item from hit) group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(joined, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join words_hit using (r) left join items using (r)"""


def _clustering(rounds: int = 10) -> str:
    """The rounds of the clustering one after the other, each a few common table expressions."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (p[i] - c[i]) * (p[i] - c[i])))"
    parts = ["""v as materialized (select row_number() over () as r, vec_id,
  list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as p from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
             """c0 as materialized (select j, c from (select p as c, row_number() over (
  order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), p) - 1 as j from v) where j < 8)"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} as materialized (select r, any_value(vec_id) as vec_id, any_value(p) as p,
  min({{'d': {gap}, 'j': j}}) as near from v, c{k} group by r)""")
        if k < rounds:
            parts.append(f"""s{k} as (select near.j as j, i, sum(p[i]) as s, count(*) as n
  from (select near, p, unnest(range(1, 65)) as i from a{k}) group by 1, 2)""")
            parts.append(f"""c{k + 1} as materialized (select c{k}.j, coalesce(m.c, c{k}.c) as c from c{k} left join (
  select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{k} group by j) m using (j))""")
    return "with " + ",\n".join(parts) + f"""
select vec_id, cast(near.j as integer) as cluster, cast(near.d as bigint) as distance,
  cast(sum(near.d) over (partition by near.j) as bigint) as cluster_inertia, cast(sum(near.d) over () as bigint) as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} on j = near.j"""


CLUSTERING = _clustering()

FILL_IN_MIDDLE = """
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
  sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (select *, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as x,
  cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as y, cast('0x' || substr(h, 17, 8) as bigint) % 100 as z,
  cast('0x' || substr(h, 25, 8) as bigint) % 100 as w from t),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or z >= 90
  then 'plain' when w < 20 then 'spm' else 'psm' end as form,
  array_to_string(u[1:least(x, y)], '') as a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as b,
  array_to_string(u[greatest(x, y) + 1:], '') as c from k)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(b) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b
    else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256, sha256(text) as restored_sha256
from f"""
