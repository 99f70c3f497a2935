"""DuckDB SQL for the queries of queries_store."""

from __future__ import annotations

from .functions.text import LABEL_STOPWORDS
from .oracle import _HOST, _JOBS, _list, _top
from .oracle import oracle_sql as first
from .queries import NOW

_URL = "'https://h' || (k % 7) || '.example.com/p' || k"
_N = "n0 as (select page_id as k from pages), n as (select k, " + _URL + " as url from n0)"
_CLOCK = "(case when k * 37 >= 3600 then (k * 37 // 3600) || ':' || lpad(((k * 37 // 60) % 60)::varchar, 2, '0') else (k * 37 // 60)::varchar end || ':' || lpad((k * 37 % 60)::varchar, 2, '0'))"
_STATES = "st as (select doc_id, doc_id::varchar as id, case doc_id % 7 when 0 then 'dead' when 1 then 'failed' when 2 then 'pending' else 'fetched' end as state, case when doc_id % 7 > 3 then 'x' || doc_id end as extraction from documents)"
_MARKS = "m as (select format('b{:08d}', doc_id) as id, doc_id, case when doc_id % 2 = 0 then 'html' else 'manual' end as source, '/F' || (doc_id % 5) || '/G' as folder_path from documents)"
_OK = "k % 5 <> 4"


def oracle_sql() -> dict[str, str]:
    hybrid = first()["hybrid_search"]
    return {
        "export_html": f"""with {_N}, r as (select *, row_number() over (partition by k % 4 order by k) - 1 as place from n)
select 'f' || (k % 4) as path, place, url, 'T' || k || ' & co' as title, '/Dir - ' || (k % 5) as folder_path, 'a' || (k % 3) || '|b' as tags, case when k % 3 < 2 then 1700000000 + k end::bigint as saved from r""",
        "export_chrome": f"""with {_N}, r as (select *, row_number() over (partition by k % 4 order by k % 2, k) - 1 as place from n)
select 'f' || (k % 4) as path, place, url, 'T' || k as title, case when k % 2 = 0 then '/Bookmarks Bar/F' || (k % 5) else '/Other Bookmarks' end as folder_path, null::varchar as tags, (13300000000 + k - 11644473600)::bigint as saved from r""",
        "export_safari": f"""with {_N}, r as (select *, row_number() over (partition by k % 4 order by k) - 1 as place from n)
select 'f' || (k % 4) as path, place, url, 'T' || k as title, '/Favorites' as folder_path, null::varchar as tags, null::bigint as saved from r""",
        "firefox_folders": f"""with {_N} select k + 1000 as place, url, 'T' || k as title,
case when k % 7 = 1 then '/Bookmarks Toolbar' else '/Bookmarks Menu/' || array_to_string(list_transform(generate_series(0, k % 5), lambda d: 'D-' || d), '/') end as folder_path, null::varchar as tags, (1700000000 + k)::bigint as saved from n where k % 7 <> 0""",
        "time_rules": f"""with {_N} select k, round(case k % 5 when 0 then k * 86400.0::double when 1 then k * 3600.0::double + (k % 60) * 60 when 2 then k + 0.5::double when 3 then -k / 1000.0::double end, 6) as seconds, {_CLOCK} as clock,
case when k % 4 <> 3 then '2024-' || lpad((k % 12 + 1)::varchar, 2, '0') || '-15' end as day, case when k > 0 then k end as micros, case when k >= 5 then (k + 1160) * 10000000 - 11644473600 end::bigint as since_1601,
case when k % 2 = 0 then '2024-05-01T10:00:00.000Z' else '2024-05-01T10:30:00.250Z' end as stored, least(3600, 30 * pow(2, k % 12))::int as delay from n""",
        "fetch_classes": f"""with {_N}, c as (select k, [200, 204, 301, 403, 404, 410, 429, 500, 503][k % 9 + 1] as code, ['text/html', 'application/pdf', 'application/octet-stream', 'image/png', null][k % 5 + 1] as media from n)
select k, case when code < 300 then 'ok' when code in (403, 503) then 'anti_bot' when code in (404, 410) then 'dead' else 'retry' end as class, media, media is null or media = 'text/html' as readable,
coalesce(media = 'application/pdf', false) or (k % 5 in (2, 4) and k % 2 = 0) as pdf from c""",
        "reader_answers": f"""with {_N} select k, case when k % 3 < 2 then 'T' || k else '' end as title, case when k % 3 < 2 then url else '' end as url_source, case when k % 3 < 2 then '2024' else '' end as published,
case k % 3 when 0 then '# Body ' || k || chr(10) || 'Title: no' when 1 then 'plain ' || k || chr(10) || 'Markdown Content:' else '' end as body from n""",
        "front_matters": f"""with {_N} select k, case when k % 3 = 0 then 'T' || k end as title, case when k % 3 = 2 then 'A' end as author, case when k % 3 = 0 then '2024-05-01' end as published, case when k % 3 = 0 then 'S' end as site,
case k % 3 when 0 then 'Body ' || k when 1 then '---' || chr(10) || 'title: open' || chr(10) || 'Body ' || k end as body from n""",
        "caption_texts": f"""with {_N}, l as (select k, list_transform(generate_series(0, k % 9 + 1), lambda i: 'line ' || i) as ls from n)
select k, array_to_string(list_transform(generate_series(1, len(ls), 5), lambda s: array_to_string(ls[s : s + 4], ' ')), chr(10) || chr(10)) as text, true as auto from l""",
        "video_pages": f"""with {_N}, c as (select k, k * 61 as s from n)
select k, '# V' || k || chr(10) || chr(10) || case when k % 2 = 0 then '**Channel:** C' || k || chr(10) else '' end || case when k % 3 = 0 then '**Published:** 2024-02-29' || chr(10) else '' end
 || case when s > 0 then '**Duration:** ' || case when s >= 3600 then (s // 3600) || ':' || lpad(((s // 60) % 60)::varchar, 2, '0') else (s // 60)::varchar end || ':' || lpad((s % 60)::varchar, 2, '0') || chr(10) else '' end
 || case when k % 4 = 0 then chr(10) || '## Description' || chr(10) || chr(10) || 'about' || chr(10) else '' end as markdown, k % 2 = 0 as permanent from c""",
        "code_threads": f"""with {_N}, c as (select k, case when k % 3 = 0 then 'merged' when k % 5 = 0 and k % 2 = 0 then 'draft' when k % 2 = 0 then 'open' else 'closed' end as state, chr(10) as l from n)
select k, '# Bug ' || k || ' (#' || k || ')' || l || l || '**Repository:** o/r' || l || '**State:** ' || state || l || '**Author:** al' || l || '**Labels:** a, b' || l || '**Comments:** ' || (k % 4 + 2) || l
 || case when k % 2 = 0 then l || 'text ' || k || l else '' end || l || '## Comments' || l || l || '### u1 (2024-02-03)' || l || l || 'yes' || l || l || '### u2 (2024-02-03)' || l || l || 'yes' || l
 || case when k % 4 > 0 then l || '_(' || (k % 4) || ' more comments not shown)_' || l else '' end as markdown from c""",
        "code_pages": f"""with {_N}, c as (select k, chr(10) as l from n)
select k, '# ' || case when k % 2 = 0 then 'about ' || k else '(no description)' end || l || l || '**Language:** Go' || l || '**Stars:** ' || k || l || '**License:** MIT' || l || '**Topics:** x, y' || l || case when k % 3 = 0 then '**Status:** archived' || l else '' end
 || l || '## README' || l || l || 'read me' || l as repo, '# a' || k || '.py' || l || l || '**Repository:** o/r' || l || '**Language:** Py | **Stars:** ' || k || l || l || '## Content' || l || l || 'code' || l as file,
 '# Page ' || k || l || l || '**Repository:** o/r (wiki)' || l || l || '## Content' || l || l || 'words' || l as wiki from c""",
        "pdf_texts": r"""with c as (select conv_id, turn, replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)), chr(13) || chr(10), chr(10)) as t from conversations)
select conv_id, turn, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as md5 from c""",
        "data_urls": r"""with d as (select doc_id, '![a ' || doc_id || '](data:image/png;base64,AAAA+/=) ' || coalesce(text, '') || ' data:font/woff;base64,BBBB end' as t from documents)
select doc_id, md5(regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\(data:[^)]*\)', '![\1](image)', 'g'), 'data:[a-zA-Z0-9/+.-]+;base64,[A-Za-z0-9+/=]+', '', 'g')) as md5 from d""",
        "page_markdown": f"""with {_N}, l as (select k, chr(10) || chr(10) as p from n)
select k, 'Page ' || k as title, 'A' || (k % 3) as author, 'en' as language, '# Number ' || k || p || trim(repeat('Sentence ' || k || ' of it. ', 30)) || p || 'A **bold** word and [a link](/x).' || p || '- one' || chr(10) || '- two ' || k
 || p || '```' || chr(10) || 'x = ' || k || chr(10) || '```' as markdown from l""",
        "fetched_pages": f"""with {_N}, l as (select k, k % 8 as way, length('# Number ' || k || 'A **bold** word and [a link](/x).' || '- one' || '- two ' || k || '```' || 'x = ' || k || '```') + 30 * length('Sentence ' || k || ' of it. ') - 1 + 11 as n from n)
select k as document_id, way = 0 or way = 5 as ok, way in (2, 3, 7) as retry,
case way when 1 then 'dead link: HTTP 404' when 2 then 'refused: HTTP 403' when 3 then 'HTTP 500' when 4 then 'unsupported content type: image/png' when 6 then 'dead link: title looks like a not-found page: Not found' when 7 then 'login wall: redirected to a login/auth path: /p' || k || '/login' end as error,
case when way = 6 then 'Not found' when way in (0, 7) then 'Page ' || k end as title, case when way = 5 then 'pdf' else 'article' end as content_type, case when way = 0 then n when way = 5 then 40 * (length('line ' || k) + 1) - 1 end::int as n from l""",
        "host_answers": f"""with {_N}, c as (select k, chr(10) as l, '**Repository:** o/r' || chr(10) as r from n)
select k, '# Bug ' || k || ' (#' || k || ')' || l || l || r || '**State:** closed' || case when k % 2 = 0 then ' (completed)' else '' end || l || '**Author:** al' || l || '**Labels:** a' || l || '**Comments:** 2' || l || l || 'text' || l || l || '## Comments' || l || l
 || '### bo (2001-02-03)' || l || l || 'no' || l || l || '_(1 more comments not shown)_' || l as issue, k % 3 = 0 as is_pull,
'# Fix ' || k || ' (#' || k || ')' || l || l || r || '**State:** ' || case when k % 2 = 0 then 'merged' else 'open' end || l || '**Branches:** main ← b' || k || l || '**Diff:** +' || k || ' −1 across 2 files' || l || '**Comments:** 0' || l as pull,
'# about ' || k || l || l || '**Stars:** ' || k || l || '**License:** MIT' || l as repo,
'# V' || l || l || '**Channel:** C' || l || '**Published:** 2001-02-03' || l || case when k > 0 then '**Duration:** ' || case when k >= 3600 then (k // 3600) || ':' || lpad(((k // 60) % 60)::varchar, 2, '0') else (k // 60)::varchar end || ':' || lpad((k % 60)::varchar, 2, '0') || l else '' end as video from c""",
        "label_answers": f"with {_N} select k, case k % 4 when 3 then '' when 1 then '## **Topic ' || k else 'Topic ' || k end as name, case when k % 4 = 0 then 'About ' || k else '' end as summary from n",
        "label_prompts": f"with {_N} select (k // 8)::int as label, 'T' || min(k) as name, count(*)::varchar as summary from n group by k // 8",
        "judged_queries": f"""with h as (select {_HOST.format("url")} as host, count(*) as n from pages group by 1)
select query_id, query, url, coalesce(n, 0) as n_pages from (values (0, 'north sea', 'https://ththre.example.com/', 'ththre.example.com'), (0, 'north sea', 'https://b.example.com/', 'b.example.com'), (1, 'tides', 'https://spam-farm.example.org/x', 'spam-farm.example.org')) t(query_id, query, url, host) left join h using (host)""",
        "dispatch_rules": f"""with h as (select {_HOST.format("url")} as host from pages),
d as (select case when host = 'example.org' or ends_with(host, '.example.org') then 1 when host in ('ththre.example.com', 'blog.ththan.example.net') then 2 else 3 end as rule_no from h)
select rule_no, kind, hosts, fetcher, count(d.rule_no) as n_pages from (values (1, 'host_suffix', '.example.org', 'x'), (2, 'host_in', 'ththre.example.com,blog.ththan.example.net', 'skip'), (3, 'any', '', 'y')) t(rule_no, kind, hosts, fetcher)
left join d using (rule_no) group by rule_no, kind, hosts, fetcher""",
        "bookmark_list": f"""with {_MARKS}, p as (select * from m where source = 'html' and folder_path like '/F2%' and id > 'b00000010' order by id limit 20)
select id, folder_path, case when count(*) over () = 20 then max(id) over () end as next_cursor from p""",
        "bookmark_delete": f"with {_MARKS} select source, count(*) as n, min(id) as first from m where doc_id % 2 <> 0 group by source",
        "search_bookmarked": f"with {_top('doc.document_id % 2 <> 0')} select chunk_id, document_id, round(score, 9) as score, rank from bm",
        "hydrated_hits": f"with h as ({hybrid}) select h.rank, h.document_id, d.lang as content_type, d.source, p.url from h join documents d on d.doc_id = h.document_id left join pages p on p.page_id = h.document_id",
        "document_vectors": "select vec_id % 20 as id, round(avg(embedding[1]::double), 4) as first, 64::int as d from embeddings where (vec_id % 20) % 3 <> 0 group by vec_id % 20",
        "latest_run": f"""with {_JOBS} (select id, 'done' as which from jobs where status = 'done' order by created_at desc, id limit 1) union all (select id, 'any' as which from jobs order by created_at desc, id limit 1)""",
        "refetch_jobs": f"""with {_STATES} select sha256('local|fetch|' || id || '|{NOW}') as id, 'fetch' as kind, '{{"document_id":"' || id || '"}}' as payload, 'pending' as status, 0 as attempts from st where state <> 'dead'""",
        "reindex_jobs": f"with {_STATES} select id from st where state = 'fetched' and extraction is not null",
        "corpus_stats": f"with {_STATES}, {_MARKS} select 'documents' as what, state as key, count(*) as n from st group by state union all select 'bookmarks', source, count(*) from m group by source",
        "orphan_jobs": f"""with {_JOBS} select case when status = 'running' then 'pending' else status end as status, count(*) as n, count(*) filter (status = 'running' or updated_at = timestamp '{NOW}') as changed from jobs group by 1""",
        "failed_documents": f"with {_JOBS} select user_id::varchar as id, min(case when kind = 'view' then 'dead' else 'failed' end) as state from jobs where status = 'failed' group by user_id",
        "state_changes": f"""with {_STATES}, c as (select case when state = 'failed' then 'pending' else state end as state, case when state <> 'failed' then extraction end as extraction from st)
select state, count(*) as n, count(extraction) as extracted from c group by state""",
        "dangling_documents": f"with {_STATES} select id, extraction as current_extraction_id from st where extraction is not null and doc_id % 2 <> 0",
        "stored_chunks": """with d as (select doc_id, doc_id % 3 + 1 as c, case when doc_id % 6 = 0 then 2 when doc_id % 3 = 0 then null when doc_id % 2 = 0 then 1 else 0 end as version from documents)
select version, sum(c)::bigint as n, count(*) as documents from d where version is not null group by version""",
        "worked_jobs": f"""with {_N} select 'fetch' as kind, case when {_OK} then 'done' when k % 10 = 4 then 'failed' else 'pending' end as status, case when {_OK} then '' when k % 10 = 4 then 'dead link: 404' else 'no answer' end as error, count(*) as n, count(*) as attempts from n group by 1, 2, 3
union all select 'index', 'done', '', count(*), count(*) from n where {_OK}""",
        "worked_documents": f"""with {_N}, g as (select * from n where {_OK})
select case when {_OK} then 'fetched' when k % 10 = 4 then 'dead' else 'pending' end as what, count(*) as n, count(*) filter ({_OK}) as extracted, (sum(3) filter ({_OK}))::bigint as words from n group by 1
union all select w, case when w = 'postings' then 5 else 1 end * count(*), count(*), null from g, (select unnest(['document_extractions', 'chunks', 'chunk_vectors', 'chunk_lengths', 'postings']) as w) group by w""",
        "worked_search": "select 'Sea 12' as title, 1 as rank, 1 as n_chunks, '<em>tide</em> wind <em>12</em>' as snippet",
        "queue_drain": f"""with {_JOBS}, r as (select *, case when status = 'running' then 'pending' else status end as s0, (status in ('running', 'pending')) and run_after <= timestamp '{NOW}' as due from jobs),
e as (select kind, due or updated_at = timestamp '{NOW}' as handled, attempts + due::int as attempts,
  case when not due then s0 when kind = 'view' then 'done' when kind = 'click' and attempts + 1 < 5 then 'pending' else 'failed' end as status,
  case when due and kind = 'signup' then 'no handler' when due and kind <> 'view' then 'no ' || kind end as error from r)
select kind, status, count(*) as n, sum(attempts)::bigint as attempts, count(*) filter (handled) as handled, max(error) as error from e group by kind, status""",
        "cluster_counts": "with p as (select case when vec_id % 5 = 0 then -1 else label end as label from embeddings) select count(*) as n, count(distinct label) filter (label >= 0) as clusters, count(*) filter (label < 0) as noise from p",
        "interest_list": """with c as (select label::varchar as id, count(*) as size, round(avg(vec_id % 10) / 10, 6) as cohesion from embeddings group by label),
b as (select * from c order by size desc, cohesion desc, id limit 3),
m as (select label::varchar as id, vec_id as document_id, row_number() over (partition by label order by (vec_id % 97) desc, vec_id) as r from embeddings)
select b.id, b.size, m.document_id, d.source as title from b join m on m.id = b.id and m.r <= 2 left join documents d on d.doc_id = m.document_id""",
        "query_terms": rf"""with t as (select item_id, string_split_regex(lower(text), '[^a-z0-9]+') as ws from benchmark)
select item_id, array_to_string(list_filter(ws, lambda w: length(w) >= 3 and not list_contains({_list(LABEL_STOPWORDS)}, w)), ' ') as terms from t""",
    }
