"""SQL that gives the rows of queries of this subpackage."""

from __future__ import annotations

VECTOR_SQL = """
with recursive good as (
  select vec_id, label, embedding from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding)
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, least(a, min(b)) as component_id from reach group by a),
degree as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(d.n_links, 0)::bigint as n_links, coalesce(l.component_id, e.vec_id)::bigint as component_id,
  coalesce(l.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join degree d on d.a = e.vec_id left join least l on l.a = e.vec_id
"""

WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRING_SQL = f"""
with words as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
windows as (
  select doc_id, p, sha256(array_to_string(w[p : p + 34], ' ')) as h
  from words, lateral (select unnest(range(1, len(w) - 33)) as p)),
repeated as (select h from windows group by h having count(*) > 1),
gone as (
  select distinct doc_id, p + k as p from windows join repeated using (h), lateral (select unnest(range(0, 35)) as k)),
each as (select doc_id, p, w[p] as word from words, lateral (select unnest(range(1, len(w) + 1)) as p)),
kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.p) filter (g.p is null) as text, count(g.p) as n_removed
  from each e left join gone g on g.doc_id = e.doc_id and g.p = e.p group by e.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from words w left join kept k using (doc_id)
"""

JACCARD_SQL = f"""
with recursive words as (
  select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sets as (
  select distinct doc_id, array_to_string(w[p : p + 4], ' ') as s
  from words, lateral (select unnest(range(1, greatest(len(w) - 3, 2))) as p) where len(w) > 0),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as o from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, least(a, min(b)) as component_id from reach group by a)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(l.component_id, w.doc_id)::bigint as component_id
from words w left join sizes s using (doc_id) left join least l on l.a = w.doc_id
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPLIT_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"

LEXICAL_SQL = f"""
with words as (select doc_id, {SPLIT_TERMS} as w from documents where text is not null),
size as (select count(*) as n_docs, sum(len(w))::bigint as total from words where len(w) > 0),
times as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) group by all),
df as (select term, count(*) as df from times group by term),
asked as (select item_id, term, count(*) as repeats from (select item_id, unnest({SPLIT_TERMS}) as term from benchmark where text is not null) group by all),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as weight from df, size),
lengths as (select doc_id, 75 + (25 * len(w) * n_docs) // total as m from words, size),
scores as (
  select item_id, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join times using (term) join weights using (term) join lengths using (doc_id) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 20
"""

INFILL_SQL = """
with given as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
draws as (
  select doc_id, t, length(t)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
    ('0x' || h[25:32])::bigint as h4
  from given),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as z,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from draws),
parts as (select *, substring(t, 1, a) as p, substring(t, a + 1, z - a) as m, substring(t, z + 1) as s from cuts)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then z - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""

TOP_SQL = """
with good as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from good q join good c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from scores)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20
"""
