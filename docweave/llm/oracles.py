"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from docweave.llm.secret_scan import BASE, RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(rank: int, rule) -> str:
    pattern = _quoted(("(?i)" if rule.any_case else "") + rule.regex)
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x))), 0), 'n': length(w[i]), 't': length(g[i])}})) as m
from (select doc_id, regexp_split_to_array(t, {pattern}) as p, regexp_extract_all(t, {pattern}) as w, regexp_extract_all(t, {pattern}, {rule.group}) as g from d)"""


SECRETS = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, rank, kind, m.a::bigint as a, (m.a + m.n)::bigint as b from ({" union all ".join(f"select * from ({_rule(i, r)}) where m.t >= {r.least}" for i, r in enumerate(RULES))})),
o as (select doc_id, {", ".join(f"count(*) filter (rank = {i}) as n_{r.kind}" for i, r in enumerate(BASE))}, string_agg(kind || ':' || a || ':' || b, ',' order by a, rank) filter (rank < {len(BASE)}) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, rank, b) as spans from s group by 1)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join o using (doc_id)"""

SPACED = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
#: A-Z in lower case and nothing else.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = f"""with w as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
g as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g join (select doc_id, g from g group by 1, 2 having count(*) > 1) using (doc_id, g)) group by 1),
l as (select *, translate(array_to_string(regexp_extract_all(line, {SPACED}), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key, len(regexp_extract_all(line, {SPACED})) as size from (select doc_id, source, i, string_split(t, chr(10))[i] as line from (select doc_id, source, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) as i from w)) where regexp_matches(line, {SPACED})),
dup as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from l group by 1),
whole as (select w.doc_id, w.source, coalesce(string_agg(key, chr(10) order by i), '') as all_lines from w left join l using (doc_id) group by 1, 2),
hosts as (select source, count(distinct all_lines) as documents from whole group by 1),
common as (select c.source, key from (select l.source, l.key, count(distinct all_lines) as n from l join whole using (doc_id) group by 1, 2) c join hosts h on c.source is not distinct from h.source where n >= 20 and n >= documents * 0.01),
lost as (select l.doc_id, sum(size)::bigint as n_common_words from l join common c on l.source is not distinct from c.source and l.key = c.key group by 1),
b as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_common_words, 0) as n_common_words from w left join r using (doc_id) left join dup using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select *, not base_failed and n_words - n_common_words >= n_words * 0.3 as kept from f"""

DECONTAMINATE = f"""with d as (select doc_id, regexp_extract_all({LOWER}, {PLAIN}) as w from documents), b as (select item_id, regexp_extract_all({LOWER}, {PLAIN}) as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select doc_id, i, n, item_id from dw join bw using (n, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by 1),
x as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (doc_id) left join x using (doc_id)"""

NEAR = f"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, {SPACED}) as w from documents),
s as (select distinct doc_id, g from (select doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0))),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as a, doc_id as b from d union select r.a, u.b from r join u on u.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id, min(r.b) = d.doc_id as kept from d left join n using (doc_id) join r on r.a = d.doc_id group by d.doc_id, n.n"""

REPEATED = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
o as (select g, min(doc_id) as first from x group by 1),
c as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 50)) as p from x join o using (g) where first < doc_id) group by 1),
k as (select d.doc_id, string_agg(word, ' ' order by p) as kept from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) d left join (select doc_id, unnest(gone) as p, true as lost from c) c using (doc_id, p) where lost is null group by 1)
select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join c using (doc_id) left join k using (doc_id)"""

ORACLES = {"op1_secrets": SECRETS, "op2_quality": QUALITY, "op5_decontaminate": DECONTAMINATE, "op6_near_dup": NEAR, "op8_phrases": REPEATED}
