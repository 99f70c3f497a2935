"""DuckDB SQL for the queries of quern.queries_index."""

from __future__ import annotations

from .functions.text import MARKED, QUERY_STOPWORDS, UNMARKED
from .oracle import _AT, _CENTERED, _NEAR, _WINDOWS, _list, _normalized, _top
from .oracle import oracle_sql as first

_KEPT = "content_type in ('fr', 'de') and source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')"
_FOUND = "select chunk_id, document_id, round(score, 9) as score, rank from bm"


_TOKENS = f"regexp_extract_all(translate(lower({{0}}), '{MARKED}', '{UNMARKED}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
# Items have no phrase of several words.
_ITEMS = f"""{_WINDOWS},
tok as (select chunk_id, document_id, {_TOKENS.format("text")} as terms from chunk),
st as (select count(*) as n_all, avg(len(terms)) as mean from tok),
po as (select chunk_id, document_id, n as length, term, count(*)::double as tf from (select chunk_id, document_id, len(terms) as n, unnest(terms) as term from tok) group by chunk_id, document_id, n, term),
ask as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TOKENS.format("w")}) as term from
  (select item_id, unnest(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}''\\-]+'), lambda w: not list_contains({_list(QUERY_STOPWORDS)}, lower(w)))) as w from benchmark)) group by item_id, term),
df as (select term, count(*) as n from po group by term),
sc as (select query_id, chunk_id, document_id, round(sum(times * (case when ln((n_all - n + 0.5::double) / (n + 0.5::double)) > 0 then ln((n_all - n + 0.5::double) / (n + 0.5::double)) else 1e-6::double end)
  * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))), 9) as score from ask join df using (term) join po using (term), st group by query_id, chunk_id, document_id),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc) where rank <= 50),
v0 as (select q.vec_id as query_id, e.vec_id * 1000000 as chunk_id, e.vec_id as document_id, list_distance(e.embedding::double[], q.embedding::double[]) as distance
  from embeddings e, embeddings q where q.vec_id in (select item_id from benchmark)),
ve as (select * from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from v0) where rank <= 50),
fu as (select coalesce(bm.query_id, ve.query_id) as query_id, coalesce(bm.chunk_id, ve.chunk_id) as chunk_id, coalesce(bm.document_id, ve.document_id) as document_id,
  coalesce(1.0::double / (60 + bm.rank), 0.0::double) + coalesce(1.0::double / (60 + ve.rank), 0.0::double) as score from bm full join ve on bm.chunk_id = ve.chunk_id and bm.query_id = ve.query_id),
hy as (select *, row_number() over (partition by query_id order by score desc, document_id)::int as rank from
  (select query_id, document_id, max(score) as score, least(count(*), 3)::int as n_chunks from fu group by query_id, document_id)),
hits as (select * from hy where rank <= 10)"""
_RUNS = "(select distinct {0} as {1}, unnest(list_transform(generate_series(1, len(ws) - 7), lambda i: array_to_string(ws[i:i + 7], ' '))) as run from (select {0}, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as ws from {2}))"
_JUDGED = f"""
j as (select distinct query_id, id from {_RUNS.format("doc_id", "id", "documents")} d join {_RUNS.format("item_id", "query_id", "benchmark")} q using (run)),
sz as (select query_id, count(*) as num_relevant from j group by query_id),
h as (select hits.query_id, rank, (j.id is not null) as hit from hits left join j on j.query_id = hits.query_id and j.id = hits.document_id),
g as (select query_id, count(*) as seen, count(*) filter (hit) as found, sum(case when hit then 1.0::double / log2(rank + 1.0::double) else 0 end) as dcg, min(rank) filter (hit) as first from h group by query_id)"""


# The tables' documents are one paragraph each: windows of 384 words, 48 of them shared, each cut at 3,500 bytes. A step of the recursion is a piece; upto: bytes of a
# window's words, and of a space after each, summed up.
_CHUNKED = """
ws as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as ws from documents),
wi as (select doc_id, unnest(generate_series(0, case when len(ws) <= 384 then 0 else ceil((len(ws) - 384) / 336.0)::int end)) as nr, ws from ws where len(ws) > 0),
wo as (select doc_id, nr, ws[336 * nr + 1 : 336 * nr + 384] as w from wi),
up as (select doc_id, nr, w, list_transform(generate_series(1, len(w)), lambda k: list_sum(list_transform(w[1 : k], lambda x: strlen(x) + 1))::bigint) as upto from wo),
pc as (
  select doc_id, nr, 0 as piece, 1::bigint as a, len(list_filter(upto, lambda x: x - 1 <= 3500))::bigint as e, w, upto from up
  union all
  select doc_id, nr, piece + 1, a, len(list_filter(upto, lambda x: x - before - 1 <= 3500))::bigint, w, upto
  from (select *, case when a = 1 then 0 else upto[a - 1] end as before from
    (select doc_id, nr, piece, w, upto, case when upto[e + 1] - (case when st = 1 then 0 else upto[st - 1] end) - 1 > 3500 then e + 1 else st end as a
     from (select *, greatest(a, len(list_filter(upto, lambda x: x <= upto[e] - 218)) + 1)::bigint as st from pc where e < len(w))))),
ch as (select doc_id, nr, piece, e - a + 1 as token_count, array_to_string(w[a : e], ' ') as text from pc)
select doc_id, (row_number() over (partition by doc_id order by nr, piece) - 1)::int as ord, token_count::int as token_count, strlen(text)::int as bytes, md5(text) as text_md5 from ch"""
# Label propagation node by node: a step of the recursion is a node of a sweep, and its state the labels of all nodes.
_PROPAGATED = f"""{_CENTERED},
v as (select id, list(x order by pl) as v from u group by id),
w as (select a.id as src, b.id as dst, list_inner_product(a.v, b.v) as w from v a join v b on a.id <> b.id),
k as (select src, dst, w from (select *, row_number() over (partition by src order by w desc, dst) as r from w where w >= 0.3) where r <= 10),
e as (select src, dst, max(w) as w from (select src, dst, w from k union all select dst, src, w from k) group by src, dst),
ix as (select id, row_number() over (order by id) as i from (select distinct src as id from e)),
nb as (select a.i, list(b.i order by b.i) as near, list(e.w order by b.i) as ws from e join ix a on a.id = e.src join ix b on b.id = e.dst group by a.i),
cn as (select count(*)::bigint as n from ix),
lp as (
  select 0::bigint as t, (select list(i order by i) from ix) as labels, false as changed
  union all
  select t + 1, list_concat(labels[1 : i - 1], [new], labels[i + 1 : ]), (t % n > 0 and changed) or new <> labels[i]
  from (select t, n, i, labels, changed, list_sort(list_transform(list_distinct(said), lambda x: {{'v': -list_sum(list_transform(list_filter(list_zip(said, ws), lambda y: y[1] = x), lambda y: y[2])), 'x': x}}))[1].x as new
        from (select lp.t, cn.n, nb.i, lp.labels, lp.changed, nb.ws, list_transform(nb.near, lambda j: lp.labels[j]) as said from lp, cn, nb where nb.i = lp.t % cn.n + 1 and lp.t < 20 * cn.n and (lp.t % cn.n > 0 or lp.t = 0 or lp.changed)))),
z as (select id, (select labels from lp order by t desc limit 1)[i] as root from ix),
g as (select root, row_number() over (order by count(*) desc, min(id)) - 1 as label from z group by root having count(*) >= 3)
select e.vec_id as id, coalesce(g.label, -1)::int as label from embeddings e left join z on z.id = e.vec_id left join g on g.root = z.root"""


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_blocks": f"with {_top()} {_FOUND}",
        "bm25_blocks_filtered": f"with {_top("content_type in ('fr', 'de')")} {_FOUND}",
        # each page of the tables has an article, whose elements are p, b, br and h1
        "page_words": r"""with t as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&(amp|quot|copy|middot);', ' ', 'g') as body from pages),
w as (select page_id, regexp_extract_all(body, '[\p{L}\p{N}]+') as w, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&') as title from t)
select page_id, md5(trim(regexp_replace(title, '\s+', ' ', 'g'))) as title_md5, len(w)::int as n_words, md5(array_to_string(w, ' ')) as words_md5 from w""",
        "hybrid_bitmaps": f"""with {_top(_KEPT)}, {_NEAR.replace("select doc_id from documents", f"select document_id from doc where {_KEPT}")},
fu as (select coalesce(bm.document_id, ve.document_id) as document_id, coalesce(1.0::double / (60 + bm.rank), 0.0::double) + coalesce(1.0::double / (60 + ve.rank), 0.0::double) as score from bm full join ve on bm.chunk_id = ve.chunk_id),
g as (select document_id, max(score) as score, least(count(*), 3)::int as n_chunks from fu group by document_id)
select document_id, round(score, 12) as score, row_number() over (order by score desc, document_id)::int as rank, n_chunks from g order by g.score desc, document_id limit 10""",
        "clamped_metrics": first()["job_metrics"].replace(_AT, "timestamp '2024-01-20 00:00:00'").replace("interval 20 day", "interval 1 hour"),
        "rebuilt_topics": """with d as (select distinct vec_id % 20 as id from embeddings), l as (select id, id % 4 - 1 as label from d)
select count(*)::int as size, array_to_string(list_sort(list(id::varchar)), ',') as members, 'by_label' as algo, 'done' as status, (select count(*) from d)::int as num_documents,
  (select count(distinct label) from l where label >= 0)::int as num_clusters, (select count(*) from l where label < 0)::int as num_noise from l where label >= 0 group by label""",
        "manual_bookmark": f"""with n as (select distinct {_normalized("url")} as url from pages)
select 'html' as what, count(*) as n, null::varchar as text from n union all select 'manual', 1, null union all select 'documents', count(*) + 1, null from n
union all select 'bookmark', 2, 'By hand https://by-hand.example.com/a b,a' union all select 'document', 1, 'pending https://by-hand.example.com/a'""",
        "chunk_documents": f"with recursive {_CHUNKED}",
        "cluster_knn_lpa": f"with recursive {_PROPAGATED}",
        "hybrid_queries": f"with {_ITEMS} select query_id, document_id, rank, round(score, 12) as score, n_chunks from hits",
        "eval_retrieval": f"""with {_ITEMS}, {_JUDGED}
select sz.query_id, num_relevant, coalesce(round(found / num_relevant::double, 9), 0.0::double) as recall, coalesce(round(found / seen::double, 9), 0.0::double) as precision,
  coalesce(round(dcg / (select sum(1.0::double / log2(i + 1.0::double)) from generate_series(1, least(10, num_relevant)) t(i)), 9), 0.0::double) as ndcg, coalesce(round(1.0::double / first, 9), 0.0::double) as rr
from sz left join g on g.query_id = sz.query_id""",
    }
