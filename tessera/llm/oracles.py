"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

OP1 = r"""
with d as (
  select doc_id, source, size, place, (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null') || case when place > 0 then '#' || place else '' end), 1, 12) as bigint) + cast(0.5 as double)) / cast(281474976710656 as double) as u
  from (select *, row_number() over (partition by doc_id, source, size) - 1 as place
    from (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents))
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from d group by source
), w as (
  select *, [3, 1, 2][(k - 1) % 3 + 1] as weight, cast(sum(source_size) over () as double) as total from s
), f as (
  select *, cast(coalesce(sum(2 * source_size) over (order by source_size / weight, k rows between unbounded preceding and 1 preceding), 0) as double) as filled,
    cast(sum(weight) over (order by source_size / weight, k rows between current row and unbounded following) as double) as weight_left
  from w
), l as (
  select *, (cast(1.5 as double) * total - filled) / weight_left as level from f
), t as (
  select source, source_size, least(cast(2 as double) * source_size, coalesce(weight * max(case when weight * level <= 2 * source_size then level end) over (), cast(2 as double) * source_size)) as target from l
), g as (
  select *, cast(floor(case when source_size > 0 then target / source_size else 0 end) as bigint) as whole from t
), r as (
  select *, target - whole * source_size as rest from g
), z as (
  select source, size, count(*) as n from d where size > 0 group by source, size
), y as (
  select source, size, coalesce(sum(n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0) as before,
    cast(sum(n * size * size) over (partition by source order by size desc rows between current row and unbounded following) as double) as squares
  from z
), c as (
  select y.source, arg_max((rest - cast(before as double)) / squares, size) as scale, max(size) as open_size
  from y join r on y.source is not distinct from r.source where (rest - cast(before as double)) / squares * size < 1 group by y.source
), p as (
  select d.*, r.source_size, r.target, r.whole, r.rest, case when c.scale is null or d.size > c.open_size then cast(1 as double) else greatest(cast(0 as double), least(cast(1 as double), c.scale * d.size)) end as p
  from d join r on d.source is not distinct from r.source left join c on d.source is not distinct from c.source
), o as (
  select *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) as rank from p where size > 0
), q as (
  select *, sum(size) over (partition by source order by rank, doc_id, place, size rows between unbounded preceding and current row) as upto from o
), last as (
  select source, max(upto) filter (where upto <= rest or (upto - size < rest and abs(upto - rest) < abs(upto - size - rest))) as last_upto, max(upto) >= max(rest) as reached from q group by source
)
select p.doc_id, p.size, p.source_size, p.target,
  cast(case when p.size = 0 then 0 else (p.whole + case when p.rest > 0 and p.whole < 2 and (not last.reached or coalesce(q.upto <= last.last_upto, false)) then 1 else 0 end) * p.size end as bigint) as taken
from p left join q on q.doc_id is not distinct from p.doc_id and q.size = p.size and q.place = p.place and q.source is not distinct from p.source left join last on last.source is not distinct from p.source
"""

OP4 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, u.turn, u.role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) u(turn, role)
), f as (
  select *, case when role = 'assistant' then text else '' end as learned,
    length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))
    + length('<s>[INST][/INST]</s>') as chars
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(length(learned)) as bigint) as loss_chars,
  sha256(string_agg(learned, '' order by turn nulls first, role, text)) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from f group by conv_id
"""

OP7 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s
  from w
), e as (
  select doc_id, len(s) as n, unnest(s) as g from s
), p as (
  select x.doc_id as a, y.doc_id as b, x.n as n, y.n as m, count(*) as c
  from e x join e y on x.g = y.g and x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  group by all
), l as (
  select a, b from p where 100 * c >= 90 * (n + m - c)
), d as (
  select a, b from l union select b, a from l
), r as (
  select doc_id as node, doc_id as reach from documents
  union
  select d.b, r.reach from r join d on d.a = r.node
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.reach) as component_id
from s join r on r.node = s.doc_id group by s.doc_id, len(s.s)
"""

OP9 = """
with v as (
  select *, row_number() over (order by vec_id, v) as r from (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
  )
), q as (
  select vec_id, v, r from v where vec_id % 100 = 0 qualify row_number() over (partition by vec_id order by r) = 1
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from q join v c on q.r <> c.r and len(q.v) = len(c.v)
)
select query_id, cast(r as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 10
"""

OP11 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, payload_bytes, translate(concat(
      lpad(to_base(cast('0x' || substr(h, 1, 10) as bigint), 32), 8, '0'), lpad(to_base(cast('0x' || substr(h, 11, 10) as bigint), 32), 8, '0'),
      lpad(to_base(cast('0x' || substr(h, 21, 10) as bigint), 32), 8, '0'), lpad(to_base(cast('0x' || substr(h, 31, 10) as bigint), 32), 8, '0')),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest
  from p
), r as (
  select *, row_number() over (partition by payload_digest order by page_id nulls last) as k, first_value(page_id) over (partition by payload_digest order by page_id nulls last) as original from d
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then original end as refers_to
from r
"""

OP12 = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), o as (
  select id, lang, source, unnest(terms) as term from d
), k as (
  select lang, term, count(*) as c from o group by lang, term having count(distinct id) >= 30
), l as (
  select lang, cast(count(*) as hugeint) as v, cast(sum(c) as hugeint) as n from k group by lang
), q as (
  select lang, term, 1 + (1000000000 * (cast(c as hugeint) + 5)) // (n + 5 * v) as q from k join l using (lang)
), s as (
  select distinct lang, source from d
), c as (
  select o.lang, o.source, o.term, count(*) as c from o join k on o.lang = k.lang and o.term = k.term group by all
), n as (
  select lang, source, cast(sum(c) as hugeint) as n from c group by all
), p as (
  select s.lang, s.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (cast(coalesce(c.c, 0) as hugeint) + 5)) // (coalesce(n.n, 0) + 5 * l.v) as p
  from s join k on s.lang = k.lang join l on l.lang = s.lang
    left join n on n.lang = s.lang and n.source = s.source left join c on c.lang = s.lang and c.source = s.source and c.term = k.term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(sum(abs(x.p - y.p)), 0) as bigint) as value
  from s a join s b on a.lang = b.lang and a.source <> b.source
    left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all
), terms as (
  select p.lang, p.source, 'term' as part, p.term as item, cast(p.p - q.q as bigint) as value
  from p join q on p.lang = q.lang and p.term = q.term where p.c > 0 and p.p > q.q
)
select lang, source, part, item, value, cast(r as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from (select * from pairs union all select * from terms))
where part = 'pair' or r <= 50
"""

ORACLES: dict[str, str] = {"op1_pareto_mixing": OP1, "op4_chat_format": OP4, "op7_partenum_join": OP7, "op9_pivot_topk": OP9, "op11_warc_revisits": OP11, "op12_source_divergence": OP12}
