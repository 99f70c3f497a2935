"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .functions import urls
from .functions.text import LABEL_STOPWORDS, MARKED, QUERY_STOPWORDS, UNMARKED
from .queries import NOW, TERMS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_WINDOWS = r"""
d0 as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') as ws from documents),
w0 as (select doc_id, ws, unnest(generate_series(0, case when len(ws) <= 384 then 0 else ceil((len(ws) - 384) / 336.0)::int end)) as ord from d0 where len(ws) > 0),
win as (select doc_id, ord::int as ord, ws[336 * ord + 1 : 336 * ord + 384] as words from w0),
chunk as (select doc_id * 1000000 + ord as chunk_id, doc_id as document_id, ord, array_to_string(words, ' ') as text from win)"""

_TF = ", ".join(f"len(list_filter(terms, lambda t: t = '{t}'))::double as tf{k}" for k, t in enumerate(TERMS))
_SCORE = " + ".join(
    f"(case when ln((n_all - n{k} + 0.5::double) / (n{k} + 0.5::double)) > 0 then ln((n_all - n{k} + 0.5::double) / (n{k} + 0.5::double)) else 1e-6::double end) * (tf{k} * 2.2::double) / (tf{k} + 1.2::double * (0.25::double + 0.75::double * length / mean))"
    for k in range(len(TERMS))
)
_BM25 = f"""{_WINDOWS},
tok as (select chunk_id, document_id, regexp_extract_all(translate(lower(text), '{MARKED}', '{UNMARKED}'), '[\\p{{L}}\\p{{N}}]+') as terms from chunk),
cnt as (select chunk_id, document_id, len(terms) as length, {_TF} from tok),
st as (select count(*) as n_all, avg(length) as mean, {", ".join(f"count(*) filter (tf{k} > 0) as n{k}" for k in range(len(TERMS)))} from cnt),
doc as (select d.doc_id as document_id, d.lang as content_type, d.source, p.url from documents d left join pages p on p.page_id = d.doc_id),
sc as (select chunk_id, document_id, 0.0::double + {_SCORE} as score from cnt, st where {" or ".join(f"tf{k} > 0" for k in range(len(TERMS)))})"""


def _top(condition: str = "true") -> str:
    return f"""{_BM25},
b0 as (select sc.* from sc join doc on doc.document_id = sc.document_id where {condition} order by score desc, chunk_id limit 50),
bm as (select chunk_id, document_id, score, row_number() over (order by score desc, chunk_id)::int as rank from b0)"""


_NEAR = """
v0 as (select vec_id * 1000000 as chunk_id, vec_id as document_id, list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as distance from embeddings where vec_id in (select doc_id from documents)),
v1 as (select * from v0 order by distance, chunk_id limit 50),
ve as (select chunk_id, document_id, distance, 1.0::double / (1.0::double + distance) as score, row_number() over (order by distance, chunk_id)::int as rank from v1)"""


def _fused(second: float) -> str:
    return f"""{_top()}, {_NEAR},
fu as (select coalesce(bm.chunk_id, ve.chunk_id) as id, coalesce(1.0::double / (60 + bm.rank), 0.0::double) + coalesce({second}::double / (60 + ve.rank), 0.0::double) as score, bm.score as bm25_score, ve.score as vector_score,
       coalesce(bm.document_id, ve.document_id) as document_id from bm full join ve on bm.chunk_id = ve.chunk_id)"""


def _collapse(score: str) -> str:
    return f"""with {_top()},
c as (select document_id, {score} as score, least(count(*), 3)::int as n_chunks from bm group by document_id)
select document_id, round(score, 9) as score, row_number() over (order by score desc, document_id)::int as rank, n_chunks from c order by score desc, document_id limit 10"""


_JOBS = """
e0 as (select *, json_extract_string(props, '$.k')::int as k from events),
jobs as (select event_id as id, event_type as kind, user_id, k % 6 as attempts, ts as created_at, ts + to_microseconds(k::bigint * 60000000) as run_after, to_microseconds(round(value * 1000)::bigint) + ts as updated_at,
  round(value * 1000)::bigint / 1000.0::double as ms, case when k >= 80 then 'failed' when k < 10 then 'running' when k < 20 then 'pending' else 'done' end as status,
  case when k >= 80 then 'error ' || k end as last_error, case when k <> 50 then ts end as started_at from e0)"""
_AT = f"timestamp '{NOW}'"
_RUNNING = f"select kind, count(*) as running, floor((epoch_us({_AT}) - epoch_us(min(coalesce(started_at, updated_at)))) / 1000000)::bigint as oldest_running_s from jobs where status = 'running' group by kind"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_TRACKING = "(lower({0}) in (" + ", ".join(f"'{t}'" for t in urls.TRACKING) + ") or " + " or ".join(f"starts_with(lower({{0}}), '{p}')" for p in urls.TRACKING_PREFIXES) + ")"
_PARTS = "list_filter(string_split(regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"


def _normalized(url: str) -> str:
    """The canonical form of the driver's URLs, which need no decoding."""
    kept = f"list_filter({_PARTS.format(url)}, lambda p: not {_TRACKING.format('string_split(p, chr(61))[1]')})"
    query = f"array_to_string(list_sort({kept}), '&')"
    return f"(regexp_extract({url}, '^([^?#]*)', 1) || case when {query} <> '' then '?' || {query} else '' end)"


_REASON = (
    "case when trim(url) = '' then 'empty' when starts_with(lower(url), 'javascript:') then 'javascript' when starts_with(lower(url), 'file:') then 'local_file' when starts_with(lower(url), 'chrome://') then 'browser_internal' "
    "when not (starts_with(lower(url), 'http://') or starts_with(lower(url), 'https://')) then 'unsupported_scheme' when url like 'http://[%' then 'invalid_url' end"
)
_INCOMING = """
inc as (select page_id as place, case page_id % 9 when 1 then 'javascript:open(''' || url || ''')' when 2 then 'file:///tmp/x' when 3 then 'chrome://settings' when 4 then '  ' when 5 then 'ftp' || url when 6 then 'http://[bad' else url end as url from pages)"""
_KNN_UNITS = "u as (select vec_id as id, list_transform(embedding, lambda x: (x::double * (1.0::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))))::float) as unit from embeddings)"
_CENTERED = """
x as (select vec_id as id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pl from embeddings),
m as (select pl, sum(x) / count(*) as mean from x group by pl),
c as (select x.id, x.label, x.pl, x.x - m.mean as x from x join m on x.pl = m.pl),
n as (select id, sqrt(sum(x * x)) as norm from c group by id),
u as (select c.id, c.label, c.pl, (c.x * (1.0::double / n.norm))::float::double as x from c join n on c.id = n.id)"""
_CENTROID = f"""{_CENTERED},
s as (select label, pl, sum(x) as s from u group by label, pl),
sn as (select label, sqrt(sum(s * s)) as norm from s group by label),
mem as (select u.label, u.id, greatest(0.0::double, sum(u.x * s.s / sn.norm)) as similarity from u join s on s.label = u.label and s.pl = u.pl join sn on sn.label = u.label group by u.label, u.id)"""
_EVAL = """
f as (select label, arg_min(embedding, vec_id) as q from embeddings group by label),
r0 as (select e.label as query_id, e.vec_id as id, round(list_distance(e.embedding::double[], f.q::double[]), 9) as d from embeddings e join f on f.label = e.label),
r1 as (select *, row_number() over (partition by query_id order by d, id) as rank from r0),
j as (select distinct e.label as query_id, e.vec_id as id from embeddings e join labels l on l.doc_id = e.vec_id where l.quality = 1),
sz as (select query_id, count(*) as num_relevant from j group by query_id),
h as (select r1.query_id, r1.rank, (j.id is not null) as hit from r1 left join j on j.query_id = r1.query_id and j.id = r1.id where r1.rank <= 50),
g as (select query_id, count(*) filter (rank <= 10) as seen, count(*) filter (rank <= 10 and hit) as hits, sum(case when rank <= 10 and hit then 1.0::double / log2(rank + 1.0::double) else 0 end) as dcg, min(rank) filter (hit) as first from h group by query_id),
per as (select sz.query_id, num_relevant, hits / num_relevant::double as recall, hits / seen::double as precision,
  dcg / (select sum(1.0::double / log2(i + 1.0::double)) from generate_series(1, least(10, num_relevant)) t(i)) as ndcg, coalesce(1.0::double / first, 0.0::double) as rr from sz join g on g.query_id = sz.query_id)"""
_PAGE_END = "case page_id % 3 when 0 then regexp_replace(url, '^(https?://[^/]*).*$', '\\1/') when 1 then 'https://other.example.com/x' else url end"


def oracle_sql() -> dict[str, str]:
    stop, label_stop, browse = _list(QUERY_STOPWORDS), _list(LABEL_STOPWORDS), "select chunk_id, document_id, round(score, 9) as score, rank from bm"
    hosts = "('blog.ththan.example.net', 'thther.example.org', 'therha.example.com', 'ththre.example.com', 'm.ththth.example.net')"
    return {
        "sanitize_query": f"""
with w as (select item_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}''\\-]+'), lambda w: not list_contains({stop}, lower(w))) as ws from benchmark)
select item_id, array_to_string(list_transform(ws, lambda w: '"' || w || '"'), ' OR ') as match, len(ws)::int as n_words from w""",
        "chunk_windows": f"with {_WINDOWS} select doc_id, ord, len(words)::int as token_count, md5(array_to_string(words, ' ')) as text_md5 from win",
        "bm25_topk": f"with {_top()} {browse}",
        "postings": f"""with {_BM25},
p as (select chunk_id, unnest(terms) as term, generate_subscripts(terms, 1) - 1 as pl from tok)
select term, chunk_id, count(*) as tf, min(pl)::int as first_at from p group by term, chunk_id""",
        "search_filtered_type": f"with {_top("content_type in ('fr', 'de')")} {browse}",
        "search_filtered_source": f"with {_top("source in ('src1', 'src2', 'src3')")} {browse}",
        "search_filtered_host": f"with {_top(_HOST.format('url') + ' in ' + hosts)} {browse}",
        "vector_topk": f"with {_NEAR} select chunk_id, document_id, round(distance, 9) as distance, round(score, 9) as score, rank from ve",
        "rrf_fuse": f"with {_fused(0.5)} select id, round(score, 12) as score from fu",
        "hybrid_search": f"""with {_fused(1.0)},
k as (select *, row_number() over (partition by document_id order by score desc, id) as n from fu),
g as (select document_id, max(score) as score, least(count(*), 3)::int as n_chunks from fu group by document_id)
select g.document_id, round(g.score, 12) as score, row_number() over (order by g.score desc, g.document_id)::int as rank, n_chunks, k.id as best_chunk, round(k.bm25_score, 9) as bm25_score, round(k.vector_score, 9) as vector_score
from g join k on k.document_id = g.document_id and k.n = 1 order by g.score desc, g.document_id limit 10""",
        "collapse_max": _collapse("greatest(0.0::double, max(score))"),
        "collapse_sum": _collapse("list_reduce(list_prepend(0.0::double, list_sort(list(score), 'DESC')), lambda a, b: a + b)"),
        "collapse_top3": _collapse("list_reduce(list_prepend(0.0::double, list_sort(list(score), 'DESC')[1:3]), lambda a, b: a + b) / least(count(*), 3)"),
        "related_docs": """
with e as (select vec_id as chunk_id, vec_id % 50 as document_id, vec_id // 50 as ord, embedding from embeddings),
own as (select * from e where document_id = 7 order by ord limit 64),
q0 as (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pl from own),
q as (select list(m order by pl) as v from (select pl, (sum(x) / count(*))::float::double as m from q0 group by pl)),
n as (select chunk_id, document_id, list_distance(embedding::double[], (select v from q)) as d from e where document_id <> 7 order by d, chunk_id limit 80),
g as (select document_id, max(1.0::double / (1.0::double + d)) as score, least(count(*), 3)::int as n_chunks from n group by document_id)
select document_id, round(score, 9) as score, row_number() over (order by score desc, document_id)::int as rank, n_chunks from g order by score desc, document_id limit 10""",
        "url_normalize": f"select page_id, {_normalized('url')} as normalized from pages",
        "url_dedup": f"""with n as (select page_id, regexp_replace({_normalized("url")}, '/[0-9]+(\\.html|/)?(\\?.*)?$', '') as key from pages)
select key, count(*) as n, min(page_id) as first_page from n group by key""",
        "url_hostname": f"select {_HOST.format('url')} as host, count(*) as n from pages group by 1",
        "tracking_params": f"""with p as (select string_split(unnest({_PARTS.format("url")}), '=')[1] as name from pages)
select name, {_TRACKING.format("name")} as tracking, count(*) as n from p group by 1, 2""",
        "host_dispatch": f"""with h as (select page_id, {_HOST.format("url")} as host from pages)
select page_id, case when host in ('ththre.example.com', 'spam-farm.example.org') then 'skip' when host = 'example.org' or ends_with(host, '.example.org') then 'native'
  when host = 'www.cheap-pills.example.com' then 'skip' when host = 'example.net' or ends_with(host, '.example.net') then 'reader' else 'fallback' end as fetcher from h""",
        "indexable_reasons": f"with {_INCOMING} select coalesce({_REASON}, 'ok') as reason, count(*) as n from inc group by 1",
        "import_counts": f"""with {_INCOMING},
a as (select place, case when regexp_matches(url, '^https?://[^\\[]') then regexp_replace(url, '/[^/]*/?$', '/') else url end as url from inc),
r as (select place, {_REASON} as reason, url from a),
o as (select distinct {_normalized("regexp_replace(url, '/[^/]*/?$', '/')")} as url from pages where page_id % 9 in (0, 7, 8) and page_id % 4 = 0),
g as (select {_normalized("url")} as url, min(place) as place, count(*) as n from r where reason is null group by 1),
x as (select g.*, (o.url is not null and length(g.url) % 3 = 0) as there, (o.url is null or length(g.url) % 2 <> 0) as pending from g left join o on o.url = g.url)
select (select count(*) from r) as total, (select count(reason) from r) as filtered, count(*) filter (not there) as created, (sum(n) - count(*) filter (not there))::bigint as skipped, count(*) filter (not there and pending) as jobs_enqueued,
  (select string_agg(reason || '=' || c, ',' order by reason) from (select reason, count(*) as c from r where reason is not null group by reason)) as filtered_by from x""",
        "url_video_ids": f"""select page_id, case when page_id % 6 in (0, 1, 2, 4) then 'v' || page_id end as video,
  case page_id % 6 when 0 then 'https://www.youtube.com/watch?v=v' || page_id when 1 then 'https://www.youtube.com/watch?v=v' || page_id when 2 then 'http://www.youtube.com/watch?v=v' || page_id
    when 3 then 'https://youtube.com/embed/v' || page_id || '/more' when 4 then 'https://www.youtube.com/watch?v=v' || page_id else {_normalized("url")} end as normalized from pages""",
        "url_repositories": """
with k as (select page_id, page_id % 8 as k, page_id::varchar as n from pages),
r as (select page_id, 'o' || n as owner, 'repo' as repo, case when k = 1 then 'file' when k = 2 and page_id > 0 then 'issue' when k = 3 then 'pull' when k in (4, 5) then 'wiki' when k in (2, 6, 7) then 'other' else 'repo' end as type,
  case when k = 1 then 'main' else '' end as ref, case k when 1 then 'src/a' || n || '.py' when 4 then 'Home' when 5 then 'Page-' || n else '' end as path, case when k in (2, 3) then page_id else 0 end as number from k)
select page_id, case when page_id % 11 <> 0 then owner end as owner, case when page_id % 11 <> 0 then repo end as repo, case when page_id % 11 <> 0 then type end as type, case when page_id % 11 <> 0 then ref end as ref,
  case when page_id % 11 <> 0 then path end as path, case when page_id % 11 <> 0 then number end as number from r""",
        "job_metrics": f"""with {_JOBS},
d as (select kind, status, ms from jobs where status in ('done', 'failed') and updated_at > {_AT} - interval 20 day and started_at is not null),
r as (select kind, ms, percent_rank() over (partition by kind order by ms) as pct from d where status = 'done'),
a as (select kind, count(*) as total, count(*) filter (status = 'failed') as failed from d group by kind),
p as (select kind, avg(ms) as mean_ms, min(ms) filter (pct >= 0.5) as p50, min(ms) filter (pct >= 0.95) as p95, min(ms) filter (pct >= 0.99) as p99 from r group by kind),
i as ({_RUNNING})
select coalesce(a.kind, i.kind) as kind, coalesce(total, 0) as total, coalesce(failed, 0) as failed, round(coalesce(mean_ms, 0), 3) as mean_ms, round(coalesce(p50, 0), 3) as p50_ms, round(coalesce(p95, 0), 3) as p95_ms, round(coalesce(p99, 0), 3) as p99_ms,
  coalesce(running, 0) as running, coalesce(oldest_running_s, 0) as oldest_running_s from a left join p on p.kind = a.kind full join i on i.kind = a.kind""",
        "job_inflight": f"with {_JOBS} {_RUNNING}",
        "count_by_status": f"with {_JOBS} select status, count(*) as n from jobs group by status",
        "latest_failed_per_doc": f"""with {_JOBS},
f as (select user_id, last_error, row_number() over (partition by user_id order by updated_at desc, id desc) as n from jobs where status = 'failed'),
u as (select distinct user_id from jobs where user_id % 5 <> 0)
select u.user_id::varchar as id, last_error from u left join f on f.user_id = u.user_id and n = 1""",
        "jobs_with_doc": f"""with {_JOBS},
b as (select * from jobs where status = 'failed' order by updated_at desc, id limit 100)
select id, kind, user_id::varchar as document_id, case when user_id % 5 <> 0 then 'http://d/' || user_id end as url, case when user_id % 5 <> 0 then 'Title ' || user_id end as title,
  case when user_id % 5 <> 0 and length(user_id::varchar) = 2 then 'native' end as fetcher from b""",
        "newest_jobs": f"with {_JOBS} select id, status from jobs where kind = 'error' order by created_at desc, id limit 100",
        "claim_jobs": f"with {_JOBS} select id, kind, 'running' as status, attempts + 1 as attempts from jobs where status = 'pending' and run_after <= {_AT} and kind in ('view', 'click') order by created_at, id limit 200",
        "retry_backoff": f"""with {_JOBS} select id, case when kind <> 'purchase' and attempts < 5 then 'pending' else 'failed' end as status, attempts,
  case when kind <> 'purchase' and attempts < 5 then least(3600, 30 * pow(2, attempts))::bigint end as wait_s from jobs where status = 'running'""",
        "prune_jobs": f"with {_JOBS} select kind, updated_at < timestamp '2024-01-10' as gone, count(*) as n, min(id) as first_id from jobs group by 1, 2",
        "keyset_page": """with p as (select event_id as id from events where event_type = 'signup' and event_id > 500 order by event_id limit 120)
select id, case when count(*) over () = 120 then max(id) over () end as next_cursor from p""",
        "host_failures": f"select user_id as host, arg_max(event_type, struct_pack(ts := ts, kind := event_type)) as kind from events where ts > {_AT} - interval 1 day group by user_id",
        "event_rates": "select strftime(time_bucket(interval 6 hour, ts, timestamp '2024-01-01'), '%Y-%m-%d %H:%M') as window_start, event_type as kind, count(*) as n from events group by 1, 2",
        "documents_upsert": """
with o as (select *, 'http://d/' || doc_id as u from documents where doc_id % 3 <> 0), n as (select *, 'http://d/' || doc_id as u from documents where doc_id % 3 <> 1)
select 'local' as tenant_id, coalesce(o.u, n.u) as url, case when o.u is not null then 'old' || o.doc_id else 'new' || n.doc_id end as id, case when n.u is not null then 'article' else 'unknown' end as content_type,
  case when n.u is not null then 'fetched' else 'pending' end as state, coalesce(case when n.doc_id % 5 <> 0 then 'T' || n.source end, case when o.doc_id % 2 = 0 then o.source end) as title, o.lang as language from o full join n on o.u = n.u""",
        "chunks_replace": f"""with {_WINDOWS},
m as (select document_id, ord, md5(text) as text_md5 from chunk),
r as (select document_id, text_md5 from m where document_id % 4 <> 0 union all select document_id, md5(text_md5) from m where document_id % 4 = 0 and ord = 0)
select document_id, count(*) as n, min(text_md5) as least from r group by document_id""",
        "bookmark_insert": """
with n as (select doc_id, doc_id % 97 as u, source from documents where doc_id % 10 <> 0), o as (select distinct doc_id % 97 as u, source from documents where doc_id % 10 = 0),
k as (select n.doc_id, o.u is not null as there, row_number() over (partition by n.u, n.source order by n.doc_id) as r from n left join o on o.u = n.u and o.source = n.source)
select doc_id, not there and r = 1 as added from k""",
        "tag_union": """
with t as (select doc_id, doc_id % 40 as document_id, unnest([lang, source]) as tag, unnest([1, 2]) as pl from documents where doc_id % 7 <> 0),
f as (select document_id, tag, min(doc_id * 10 + pl) as first from t group by document_id, tag)
select document_id, string_agg(tag, '|' order by first) as tags from f group by document_id""",
        "conversation_threads": """select conv_id, count(*) as turns, md5(string_agg('### ' || coalesce(role, '') || chr(10) || chr(10) || trim(coalesce(text, '')), chr(10) || chr(10) order by turn)) as markdown_md5 from conversations group by conv_id""",
        "page_titles": f"""
with p as (select page_id, url, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, {_PAGE_END} as e from pages),
q as (select *, {_HOST.format("url")} as h1, {_HOST.format("e")} as h2, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as p1, trim(regexp_extract(e, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as p2 from p)
select page_id, md5(title) as title_md5, case when h1 = h2 and p1 <> '' and p2 = '' and not regexp_matches(e, '^[^#]*\\?[^#]') then 'redirected to homepage' when strlen(trim(html)) < 500 then 'extracted text < 500 chars'
  when h1 <> h2 then 'redirected to a different host: ' || h2 end as reason from q""",
        "mean_pool": """with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pl from embeddings)
select label, count(*) as n, pl::int as "at", round(sum(x) / count(*), 9) as x from x group by label, pl""",
        "corpus_mean": """with x as (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pl from embeddings)
select pl::int as "at", round(sum(x) / count(*), 9) as x from x group by pl""",
        "center_unit": f"with {_CENTERED} select id, round(sum(x * x), 4) as norm2, round(max(x) filter (pl = 1), 5) as first from u group by id",
        "knn_graph": f"""with {_KNN_UNITS},
p as (select a.id as src, b.id as dst, list_inner_product(a.unit::double[], b.unit::double[]) as w from u a, u b where a.id <> b.id),
k as (select *, row_number() over (partition by src order by w desc, dst) as n from p where w >= 0.3),
e as (select src, dst, w from k where n <= 10)
select src, dst, round(max(w), 6) as w from (select src, dst, w from e union all select dst, src, w from e) group by src, dst""",
        "cluster_summary": f"with {_CENTROID} select label, count(*) as size, round(avg(similarity), 4) as cohesion from mem group by label",
        "cluster_members": f"with {_CENTROID}, k as (select *, row_number() over (partition by label order by similarity desc, id) as n from mem) select label, id, round(similarity, 4) as similarity from k where n <= 12",
        "term_labels": f"""
with t as (select source, doc_id, list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+'), lambda w: true) as all_ from documents),
f as (select source, doc_id, list_filter(all_, lambda w: length(w) >= 3 and not list_contains({label_stop}, w)) as ws from t),
e as (select source, doc_id, unnest(ws) as term, generate_subscripts(ws, 1) as pl from f),
c as (select source, term, count(*) as n, min(doc_id * 100000 + pl) as first from e group by source, term),
k as (select *, row_number() over (partition by source order by n desc, first) as r from c)
select source, string_agg(upper(term[1]) || term[2:], ' ' order by r) as label from k where r <= 4 group by source""",
        "eval_per_query": f"with {_EVAL} select query_id, num_relevant, round(recall, 9) as recall, round(precision, 9) as precision, round(ndcg, 9) as ndcg, round(rr, 9) as rr from per",
        "eval_means": f"with {_EVAL} select count(*) as queries, round(avg(recall), 9) as mean_recall, round(avg(precision), 9) as mean_precision, round(avg(ndcg), 9) as mean_ndcg, round(avg(rr), 9) as mrr from per",
    }
