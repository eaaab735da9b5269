"""DuckDB SQL of the training-data queries that SQL can express, by brute force."""

_FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

TOPK = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where vec_id is not null and {_FINITE}),
 s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
 select query_id, rank::int as rank, vec_id, score from r where rank <= 10"""

NEARDUP = f"""with recursive v as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings where label is not null and {_FINITE}),
 l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
 r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), c as (select a, min(b) as m from r group by a), k as (select a, count(*) as n from l group by a)
 select vec_id, coalesce(k.n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id <= coalesce(m, vec_id) as kept from embeddings left join c on c.a = vec_id left join k on k.a = vec_id"""

JACCARD = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 d as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
 x as (select doc_id, len(s) as n, unnest(s) as s from d), p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from x a join x b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from p where 100 * i >= 90 * (na + nb - i)), r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), c as (select a, min(b) as m from r group by a)
 select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id from d left join c on c.a = doc_id"""

#: JACCARD with the number of links of each document.
JACCARD_LINKS = JACCARD.replace("\n select doc_id, len(s)::bigint", ",\n k as (select a, count(*) as n from l group by a)\n select doc_id, coalesce(k.n, 0) as n_links, len(s)::bigint") + " left join k on k.a = doc_id"

#: Spans are runs of starts at most 50 bytes apart; what is kept lies between them.
REPEATS = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents), i as (select doc_id, b, unnest(range(1, octet_length(b) - 48)) as pos from d),
 w as (select doc_id, pos, array_slice(b, pos, pos + 49) as s from i), f as (select s, min(doc_id) as owner from w group by s having count(*) > 1),
 r as (select distinct doc_id, pos from w join f using (s) where doc_id > owner),
 o as (select doc_id, pos, pos - lag(pos) over (partition by doc_id order by pos) <= 50 as joined from r),
 g as (select doc_id, pos, sum(case when joined then 0 else 1 end) over (partition by doc_id order by pos) as nth from o),
 p as (select doc_id, nth, min(pos) as a, max(pos) + 50 as z from g group by doc_id, nth),
 k as (select doc_id, list(a order by nth) as starts, list(z order by nth) as ends, sum(z - a)::bigint as n_removed, count(*) as n_spans from p group by doc_id),
 e as (select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, hex(b) as h, list_append(coalesce(starts, []), octet_length(b) + 1) as starts, list_prepend(1, coalesce(ends, [])) as ends from d left join k using (doc_id))
 select doc_id, n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(ends) + 1), lambda x: substr(h, 2 * ends[x] - 1, 2 * (starts[x] - ends[x]))), ''))) as kept_sha256 from e"""

FILTER_AUDIT = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 e as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
 g as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
 m as (select part, mask, count(*) as n, count(*) filter (where good = 1) as good, count(*) filter (where toxic = 1) as toxic from e left join g using (doc_id) group by part, mask),
 x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s as (select filter_order, step, (1 << (ascii(filter_order[step]) - 65)) as own, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) as before from o, (select unnest(range(1, 6)) as step)),
 r as (select part, filter_order, step, n, good, toxic, mask, own, mask & own <> 0 as fails, mask & coalesce(before, 0)::int <> 0 as earlier from m, s)
 select part, filter_order, step::int as step, coalesce(sum(n) filter (where not fails and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (where fails and not earlier), 0)::bigint as removed, coalesce(sum(n) filter (where fails and earlier), 0)::bigint as redundant,
  coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails, coalesce(sum(good) filter (where fails and not earlier), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where fails and not earlier), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) filter (where fails), 0)::bigint as shapley from r group by part, filter_order, step"""

LINE_DEDUP = """with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), l as (select doc_id, i, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
 k as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 h as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
 g as (select k.doc_id, i, line, coalesce(k.doc_id < keeper, false) as gone from k left join h using (key))
 select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from g group by doc_id"""
