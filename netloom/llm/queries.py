"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from netloom.llm import chat, decontaminate, embedding_dedup, jaccard_join, quality, secret_scan, sentencepiece, sharding, substring_dedup, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        sharding.op2_sharding,
        url_filter.op3_url_filter,
        jaccard_join.op4_ngram_jaccard_join,
        embedding_dedup.op5_embedding_near_dedup,
        sentencepiece.op6_sentencepiece,
        quality.op7_quality_classifier,
        decontaminate.op8_benchmark_decontamination,
        secret_scan.op9_secret_scan,
        chat.op10_chat_format,
    )
}
OP1_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i+12], ' ') as s from w, unnest(range(1, len(ws) - 11)) u(i)),
f as (select s, min(doc_id) as m from win group by s),
hit as (select distinct doc_id, i + k as p from win join f using (s), range(13) r(k) where m < doc_id),
gone as (select doc_id, count(*) as n_removed, list(p) as ps from hit group by doc_id),
pos as (select doc_id, i, ws[i] as word from w, unnest(range(1, len(ws) + 1)) u(i)),
kept as (select p.doc_id, string_agg(word, ' ' order by i) as t from pos p anti join hit h on h.doc_id = p.doc_id and h.p = p.i group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join gone using (doc_id) left join kept using (doc_id)
"""
OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i+3], ' ') as t from w, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [1] else range(1, len(ws) - 2) end) u(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (t) where a.doc_id < b.doc_id group by 1, 2),
l0 as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
l as (select a, b from l0 union all select b, a from l0),
r(id, root) as (select doc_id, doc_id from documents union select l.b, r.root from r join l on l.a = r.id)
select c.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from (select id as doc_id, min(root) as component_id from r group by id) c left join n using (doc_id)
"""
ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op5_embedding_near_dedup": embedding_dedup.OP5_SQL,
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op10_chat_format": chat.OP10_SQL,
}
