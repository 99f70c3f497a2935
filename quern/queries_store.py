"""More registered queries: bookmark exports, texts of other readers, times, and the tables of a store. Inputs are made of the driver's tables
by expressions, so that SQL can tell what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import pages as page_rules
from .functions import markdown, text, times, urls
from .operators import catalog, chunking, clustering, jobs, search
from .plans import fetched, imports, interests, worker
from .queries import _bm25, _documents, _job_documents, _jobs, _now, _read, _round, _vectors
from .queries import hybrid_search as _hybrid
from .sources import bookmarks, config, hosts, readers
from .streaming import queue

def _k() -> Column:
    return F.col("k")


def _s(*parts) -> Column:
    """The parts, columns or strings, as one string."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("k"))


def _url() -> Column:
    return _s("https://h", _k() % 7, ".example.com/p", _k())


def _files(rows: DataFrame, line, head: str, tail: str, *more) -> DataFrame:
    """(path, content): a file for each remainder of k by 4, of a line for each row."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "")
    return rows.groupBy((_k() % 4).alias("f")).agg(lines.alias("body"), *more).select(_s("f", F.col("f")).alias("path"), F.encode(_s(head, F.col("body"), tail), "UTF-8").alias("content"))


def _shown(marks: DataFrame) -> DataFrame:
    return marks.select("path", "place", "url", "title", "folder_path", F.array_join("tags", "|").alias("tags"), F.unix_seconds("saved_at").alias("saved"))


def export_html(spark, sf_dir):
    date = F.when(_k() % 3 == 0, _s(' ADD_DATE="', _k() + 1_700_000_000, '"')).when(_k() % 3 == 1, _s(' ADD_DATE="', _k() + 1_700_000_000, '000000"')).otherwise("")
    line = _s("<DT><H3>Dir / ", _k() % 5, '</H3>\n<DL><p><DT><A HREF="', _url(), '?utm_source=x"', date, ' TAGS="a', _k() % 3, ', ,b"> T', _k(), " &amp; co</A>\n</DL><p>\n")
    return _shown(bookmarks.parse_exports(_files(_numbered(spark, sf_dir), line, "<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p>\n", "</DL><p>"), "html"))


def export_chrome(spark, sf_dir):
    link = _s('{"type": "url", "name": " T', _k(), '", "url": "', _url(), '", "date_added": "', _k() + 13_300_000_000, '000000"},')
    own = F.when(_k() % 2 == 0, _s('{"type": "folder", "name": "F', _k() % 5, '", "children": [', F.rtrim(F.regexp_replace(link, ",$", "")), "]},")).otherwise("")
    rest = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.when(_k() % 2 == 1, link).otherwise("").alias("line")))), lambda x: x["line"]), "")
    files = _numbered(spark, sf_dir).groupBy((_k() % 4).alias("f")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", own.alias("line")))), lambda x: x["line"]), "").alias("bar"), rest.alias("rest"))
    cut = lambda c: F.regexp_replace(c, ",$", "")
    json = _s('{"roots": {"other": {"children": [', cut("rest"), ']}, "bookmark_bar": {"children": [', cut("bar"), "]}}}")
    return _shown(bookmarks.parse_exports(files.select(_s("f", F.col("f")).alias("path"), F.encode(json, "UTF-8").alias("content")), "chrome"))


def export_safari(spark, sf_dir):
    leaf = _s("<dict><key>WebBookmarkType</key><string>WebBookmarkTypeLeaf</string><key>URLString</key><string>", _url(), "</string><key>URIDictionary</key><dict><key>title</key><string>T", _k(), " </string></dict></dict>")
    bar = "<key>WebBookmarkType</key><string>WebBookmarkTypeList</string><key>WebBookmarkIdentifier</key><string>{}</string><key>Children</key><array>"
    head = '<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>Children</key><array>'
    skipped = "<dict>" + bar.format("com.apple.ReadingList") + "<dict><key>WebBookmarkType</key><string>WebBookmarkTypeLeaf</string><key>URLString</key><string>https://later.example.com/</string></dict></array></dict>"
    files = _files(_numbered(spark, sf_dir), leaf, head + skipped + "<dict>" + bar.format("BookmarksBar"), "</array></dict></array></dict></plist>")
    return _shown(bookmarks.parse_exports(files, "safari"))


def firefox_folders(spark, sf_dir):
    """A tree of five folders, one in the other, below the menu; every seventh bookmark is a tag's."""
    kinds = "id long, type int, parent long, title string, date_micros long, guid string, fk long"
    roots = [(1, 2, 0, "", 0, "root________", None), (2, 2, 1, "menu", 0, "menu________", None), (3, 2, 1, "toolbar", 0, "toolbar_____", None), (4, 2, 1, "tags", 0, "tags________", None)]
    chain = [(10 + d, 2, 2 if d == 0 else 9 + d, f"D/{d}", 0, f"d{d}", None) for d in range(5)]
    marks = _numbered(spark, sf_dir).select((_k() + 1000).alias("id"), F.lit(1).alias("type"), F.when(_k() % 7 == 0, 4).when(_k() % 7 == 1, 3).otherwise(10 + _k() % 5).cast("long").alias("parent"), _s(" T", _k()).alias("title"), (_k() * 1_000_000 + 1_700_000_000_000_000).alias("date_micros"), _s("b", _k()).alias("guid"), _k().alias("fk"))
    pages = _numbered(spark, sf_dir).select(_k().alias("place_id"), _url().alias("url"))
    return _shown(bookmarks.firefox_bookmarks(spark.createDataFrame([*roots, *chain], kinds).unionByName(marks), pages)).drop("path")


# --- times and texts -----------------------------------------------------------------------------------------------


def time_rules(spark, sf_dir):
    duration = F.when(_k() % 5 == 0, _s(_k(), "d")).when(_k() % 5 == 1, _s(_k(), "h", _k() % 60, "m")).when(_k() % 5 == 2, _s(_k(), ".5s")).when(_k() % 5 == 3, _s("-", _k(), "ms")).otherwise(_s(_k(), " s"))
    date = F.when(_k() % 4 == 3, _s("2024/", _k())).otherwise(_s("2024", F.lpad((_k() % 12 + 1).cast("string"), 2, "0"), "15"))
    stored = F.when(_k() % 2 == 0, "2024-05-01T10:00:00Z").otherwise("2024-05-01T12:30:00.250+02:00")
    return _numbered(spark, sf_dir).select(
        "k", F.round(times.duration_seconds(duration), 6).alias("seconds"), times.clock(_k() * 37).alias("clock"), times.compact_date(date).cast("string").alias("day"), F.unix_seconds(times.from_micros(_k() * 1_000_000)).alias("micros"),
        F.unix_seconds(times.from_1601_micros(_s(_k() + 1160, "0000000000000"))).alias("since_1601"), times.formatted(times.parsed(stored)).alias("stored"), times.retry_delay((_k() % 12).cast("int")).alias("delay"),
    )


def fetch_classes(spark, sf_dir):
    header = F.when(_k() % 5 == 0, "text/html; charset=UTF-8").when(_k() % 5 == 1, " Application/PDF ").when(_k() % 5 == 2, "application/octet-stream").when(_k() % 5 == 3, "image/png").otherwise(F.lit(None))
    at = F.when(_k() % 2 == 0, _s(_url(), ".PDF?x=1")).otherwise(_url())
    return _numbered(spark, sf_dir).select(
        "k", page_rules.fetch_class(F.element_at(F.array(*map(F.lit, (200, 204, 301, 403, 404, 410, 429, 500, 503))), (_k() % 9 + 1).cast("int"))).alias("class"), page_rules.media_type(header).alias("media"),
        page_rules.is_readable(header).alias("readable"), page_rules.is_pdf(header, at).alias("pdf"),
    )


def reader_answers(spark, sf_dir):
    head = _s("Title: T", _k(), "\nURL Source: ", _url(), "\n\nPublished Time: 2024\n")
    answer = F.when(_k() % 3 == 0, _s(head, "Markdown Content:\n# Body ", _k(), "\nTitle: no\n")).when(_k() % 3 == 1, _s(head, "plain ", _k(), "\nMarkdown Content:\n")).otherwise(_s("words ", _k()))
    return _numbered(spark, sf_dir).select("k", readers.reader_answer(answer).alias("r")).select("k", "r.*")


def front_matters(spark, sf_dir):
    out = F.when(_k() % 3 == 0, _s("---\ntitle: T", _k(), "\nsite: S\npublished: 2024-05-01\n---\n\nBody ", _k(), "\n")).when(_k() % 3 == 1, _s("---\ntitle: open\nBody ", _k())).otherwise(_s("---\nauthor: A\n---\n"))
    return _numbered(spark, sf_dir).select("k", readers.front_matter(out).alias("r")).select("k", "r.title", "r.author", "r.published", "r.site", "r.body")


def caption_texts(spark, sf_dir):
    """Cues of two lines, of which the second comes again as the first of the next one, as automatic captions have them."""
    cue = lambda i: F.concat(F.lit("00:00:0"), i.cast("string"), F.lit(".000 --> 00:00:09.000 align:start\nline "), i.cast("string"), F.lit("\n<c>line</c> "), (i + 1).cast("string"), F.lit("\n\n"))
    vtt = F.concat(F.lit("WEBVTT\nKind: captions\nLanguage: en\n\n"), F.array_join(F.transform(F.sequence(F.lit(0), _k() % 9), cue), ""))
    return _numbered(spark, sf_dir).select("k", readers.captions(vtt).alias("text"), readers.auto_captions(vtt).alias("auto"))


def video_pages(spark, sf_dir):
    md = readers.video_markdown(_s("V", _k()), F.when(_k() % 2 == 0, _s("C", _k())), F.when(_k() % 3 == 0, "20240229").otherwise("2024"), _k() * 61, F.when(_k() % 4 == 0, " about "), F.lit(""))
    error = F.element_at(F.array(*map(F.lit, ("ERROR: Private video", "HTTP 500", "This video is NOT available", "timed out"))), (_k() % 4 + 1).cast("int"))
    return _numbered(spark, sf_dir).select("k", md.alias("markdown"), readers.permanent_download_error(error).alias("permanent"))


def code_threads(spark, sf_dir):
    comments = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(F.concat(F.lit("u"), i.cast("string")).alias("author"), F.lit("2024-02-03T04:05:06Z").alias("created_at"), F.lit(" yes ").alias("body")))
    state = readers.pull_state(F.when(_k() % 2 == 0, "open").otherwise("closed"), _k() % 3 == 0, _k() % 5 == 0)
    md = readers.thread_markdown(_s("Bug ", _k()), _k(), F.lit("o"), F.lit("r"), state, F.lit("al"), F.lit(""), F.array(F.lit("a"), F.lit("b")), (_k() % 4 + 2), F.when(_k() % 2 == 0, _s(" text ", _k(), " ")), comments)
    return _numbered(spark, sf_dir).select("k", md.alias("markdown"))


def code_pages(spark, sf_dir):
    repo = readers.repository_markdown(F.when(_k() % 2 == 0, _s("about ", _k())), F.lit("Go"), _k(), F.lit("MIT"), F.array(F.lit("x"), F.lit("y")), _k() % 3 == 0, F.lit(" read me "))
    file = readers.file_markdown(F.lit("o"), F.lit("r"), _s("a", _k(), ".py"), F.lit(""), F.lit("Py"), _k(), F.lit("code\n"))
    wiki = readers.wiki_markdown(F.lit("o"), F.lit("r"), _s("Page-", _k()), F.lit("words"))
    return _numbered(spark, sf_dir).select("k", repo.alias("repo"), file.alias("file"), wiki.alias("wiki"))


def pdf_texts(spark, sf_dir):
    """Conversations as PDF text: line feeds with carriage returns, and many of them."""
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(page_rules.pdf_markdown(F.concat(F.lit("\r\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\r\n\r\n\r\n\r\n"))))).alias("md5"))


def data_urls(spark, sf_dir):
    md = F.concat(F.lit("![a "), F.col("doc_id").cast("string"), F.lit("](data:image/png;base64,AAAA+/=) "), F.coalesce("text", F.lit("")), F.lit(" data:font/woff;base64,BBBB end"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(chunking.without_data_urls(md)).alias("md5"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of numbers: an article among a menu, a form and a footer."""
    long = F.repeat(_s("Sentence ", _k(), " of it. "), 30)
    body = _s(
        "<html lang='en'><head><title>Page ", _k(), "</title><meta name='author' content='A", _k() % 3, "'></head><body><nav><a href='/'>Home</a></nav><article><h1>Number ", _k(), "</h1><p>", F.trim(long), "<p>A <b>bold</b> word and <a href='/x'>a link</a>.<ul><li>one<li>two ", _k(),
        "</ul><pre>x = ", _k(), "</pre><form><input><button>Go</button></form></article><footer>no</footer></body></html>",
    )
    return _numbered(spark, sf_dir).withColumn("body", body)


def page_markdown(spark, sf_dir):
    m = markdown.extracted(F.col("body"))
    return _pages(spark, sf_dir).select("k", m.alias("m")).select("k", "m.title", "m.author", "m.language", "m.markdown")


def fetched_pages(spark, sf_dir):
    """Fetches of which some are refused, gone, unreadable, walled or PDFs."""
    way = _k() % 8
    status = F.when(way == 1, 404).when(way == 2, 403).when(way == 3, 500).otherwise(200)
    kind = F.when(way == 4, "image/png").when(way == 5, "application/pdf").otherwise("text/html")
    body = F.when(way == 6, "<title>Not found</title><p>x</p>").when(way == 5, F.repeat(_s("line ", _k(), "\r\n"), 40)).otherwise(F.col("body"))
    end = F.when(way == 7, _s(_url(), "/login"))
    answers = _pages(spark, sf_dir).select(_k().alias("document_id"), _url().alias("url"), end.alias("final_url"), status.alias("status"), kind.alias("content_type"), body.alias("body"))
    return fetched.results(answers).select("document_id", "ok", "retry", "error", "title", "content_type", F.length("markdown").alias("n"))


def host_answers(spark, sf_dir):
    """Issues, pull requests and repositories as a code host's JSON."""
    issue = _s('{"title": "Bug ', _k(), '", "body": " text ", "state": "closed", "state_reason": "', F.when(_k() % 2 == 0, "completed").otherwise(""), '", "user": {"login": "al"}, "labels": [{"name": "a"}], "comments": 2', F.when(_k() % 3 == 0, ', "pull_request": {}').otherwise(""), "}")
    said = F.lit('[{"user": {"login": "bo"}, "body": " no ", "created_at": "2001-02-03T04:05:06Z"}]')
    pull = _s('{"title": "Fix ', _k(), '", "state": "open", "merged": ', F.when(_k() % 2 == 0, "true").otherwise("false"), ', "base": {"ref": "main"}, "head": {"ref": "b', _k(), '"}, "additions": ', _k(), ', "deletions": 1, "changed_files": 2}')
    repo = _s('{"description": "about ', _k(), '", "stargazers_count": ', _k(), ', "license": {"name": "MIT"}, "topics": []}')
    o, r = F.lit("o"), F.lit("r")
    return _numbered(spark, sf_dir).select(
        "k", hosts.issue(o, r, _k(), issue, said).alias("issue"), hosts.is_pull(issue).alias("is_pull"), hosts.pull(o, r, _k(), pull, F.lit(None).cast("string")).alias("pull"), hosts.repository(repo, F.lit("")).alias("repo"),
        hosts.video(_s('{"title": "V", "channel": "C", "upload_date": "20010203", "duration": ', _k(), "}"), F.lit(None).cast("string")).alias("video"),
    )


def label_answers(spark, sf_dir):
    answer = F.when(_k() % 4 == 0, _s("NAME: Topic ", _k(), "\nSUMMARY: About ", _k())).when(_k() % 4 == 1, _s("## **Topic ", _k(), "**\nmore")).when(_k() % 4 == 2, _s("Name - \"Topic ", _k(), "\"")).otherwise("this is a sentence of more than six words")
    return _numbered(spark, sf_dir).select("k", clustering.label_answer(answer).alias("a")).select("k", "a.*")


def label_prompts(spark, sf_dir):
    """What a model is asked about eight titles: its answer here is the first of them, and how many there are."""
    t = _numbered(spark, sf_dir).select(F.floor(_k() / 8).cast("int").alias("label"), _k().alias("rank"), _s("T", _k()).alias("title"))
    return clustering.generated_labels(t, lambda p: F.concat(F.lit("NAME: "), F.regexp_extract(p, "- ([^\n]*)", 1), F.lit("\nSUMMARY: "), F.size(F.regexp_extract_all(p, F.lit("(\n- )"), F.lit(1))).cast("string")))


# --- settings --------------------------------------------------------------------------------------------------------

JUDGED = "queries:\n- query: north sea\n  relevant: [https://ththre.example.com/, https://b.example.com/]\n- query: tides\n  relevant: [https://spam-farm.example.org/x]\n"


DISPATCH = "rules:\n- match: {host_suffix: .example.org}\n  fetcher: x\n- match: {host_in: [ththre.example.com, blog.ththan.example.net]}\n  fetcher: skip\n- fetcher: y\n"


def judged_queries(spark, sf_dir):
    """Judgements joined with how many pages have the host of a judged URL."""
    hosts = _read(spark, sf_dir, "pages").groupBy(urls.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))
    judged = config.load_judgements(spark, JUDGED).withColumn("host", urls.hostname(F.col("url")))
    return judged.join(hosts, "host", "left").select("query_id", "query", "url", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def dispatch_rules(spark, sf_dir):
    """Rules with how many pages each of them decides: those that no rule before it covers."""
    rules = config.rules_table(spark, config.load_rules(DISPATCH))
    decided = imports.dispatched(_read(spark, sf_dir, "pages").select("url"), rules.withColumn("fetcher", F.col("rule_no").cast("string")))
    counts = decided.groupBy(F.col("fetcher").cast("int").alias("rule_no")).agg(F.count("*").alias("n_pages"))
    return rules.join(counts, "rule_no", "left").select("rule_no", "kind", F.array_join("hosts", ",").alias("hosts"), "fetcher", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


# --- the store -------------------------------------------------------------------------------------------------------


def _marks(spark, sf_dir):
    """A bookmark of each document, from one of two sources and in one of five folders."""
    d = _read(spark, sf_dir, "documents")
    return d.select(
        F.format_string("b%08d", "doc_id").alias("id"), F.lit("local").alias("tenant_id"), F.concat(F.lit("http://d/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 2 == 0, "html").otherwise("manual").alias("source"), F.col("doc_id").alias("document_id"),
        F.concat(F.lit("/F"), (F.col("doc_id") % 5).cast("string"), F.lit("/G")).alias("folder_path"), F.array(F.col("lang")).alias("tags"),
    )


def bookmark_list(spark, sf_dir):
    rows = _marks(spark, sf_dir).where("source = 'html'")
    return jobs.page(rows.where(F.col("folder_path").startswith("/F2")), "b00000010", 20).select("id", "folder_path", "next_cursor")


def bookmark_delete(spark, sf_dir):
    t = _tables(spark)
    t.replace("bookmarks", _marks(spark, sf_dir))
    gone = t.read("bookmarks").where("document_id % 2 = 0")
    t.merge("bookmarks", gone.limit(0), "id", gone.select("id"))
    return t.read("bookmarks").groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def search_bookmarked(spark, sf_dir):
    """BM25 over documents that have a bookmark from one source."""
    from .queries import QUERY, _chunks

    docs = search.matching(_documents(spark, sf_dir), search.Filters(sources=("manual",)), _marks(spark, sf_dir))
    return _round(search.bm25_search(_chunks(spark, sf_dir), docs, QUERY, stemmed=False), 9, "score").select("chunk_id", "document_id", "score", "rank")


def hydrated_hits(spark, sf_dir):
    hits = _hybrid(spark, sf_dir).select("document_id", "score", "rank")
    return search.hydrate(hits, _documents(spark, sf_dir)).select("rank", "document_id", "content_type", "source", "url")


def document_vectors(spark, sf_dir):
    """Mean vectors of documents of ten chunks each, of which every third is not fetched."""
    v = _vectors(spark, sf_dir, 20)
    docs = v.select(F.col("document_id").alias("id"), F.when(F.col("document_id") % 3 == 0, "failed").otherwise("fetched").alias("state")).distinct()
    return interests.document_vectors(v, docs).select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"), F.size("embedding").alias("d"))


def latest_run(spark, sf_dir):
    runs = _jobs(spark, sf_dir).select("id", "tenant_id", "status", "created_at")
    return catalog.latest_run(runs, True).select("id").withColumn("which", F.lit("done")).unionByName(catalog.latest_run(runs).select("id").withColumn("which", F.lit("any")))


def _states(spark, sf_dir):
    k = F.col("doc_id") % 7
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("local").alias("tenant_id"), F.when(k == 0, "dead").when(k == 1, "failed").when(k == 2, "pending").otherwise("fetched").alias("state"), F.when(k > 3, _s("x", F.col("doc_id"))).alias("current_extraction_id"))


def refetch_jobs(spark, sf_dir):
    targets = jobs.to_refetch(_states(spark, sf_dir))
    return jobs.new_jobs(targets.select(F.col("id").alias("document_id")), "fetch", _now()).select("id", "kind", "payload", "status", "attempts")


def reindex_jobs(spark, sf_dir):
    return jobs.to_reindex(_states(spark, sf_dir)).select("id")


def corpus_stats(spark, sf_dir):
    return jobs.count_by(_states(spark, sf_dir), "state").withColumn("what", F.lit("documents")).withColumnRenamed("state", "key").unionByName(_marks(spark, sf_dir).groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n")).withColumn("what", F.lit("bookmarks")))


def orphan_jobs(spark, sf_dir):
    return jobs.orphans_reset(_jobs(spark, sf_dir), _now()).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("updated_at") == _now()).alias("changed"))


def failed_documents(spark, sf_dir):
    error = F.when(F.col("kind") == "view", F.concat(F.lit("dead link: "), F.col("last_error"))).otherwise(F.col("last_error"))
    failed = _jobs(spark, sf_dir).where("status = 'failed'").select(jobs.document_of(F.col("payload")).alias("id"), jobs.document_state(error).alias("state"))
    return failed.groupBy("id").agg(F.min("state").alias("state"))


def state_changes(spark, sf_dir):
    docs = _states(spark, sf_dir)
    new = docs.where("state = 'failed'").select("id", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("current_extraction_id"))
    return catalog.set_values(docs, new, "id", ["state", "current_extraction_id"]).groupBy("state").agg(F.count("*").alias("n"), F.count("current_extraction_id").alias("extracted"))


def dangling_documents(spark, sf_dir):
    known = _states(spark, sf_dir).where("current_extraction_id is not null and cast(id as int) % 2 = 0").select(F.col("current_extraction_id").alias("id"))
    return catalog.dangling(_states(spark, sf_dir), "current_extraction_id", known).select("id", "current_extraction_id")


def _tables(spark: SparkSession) -> catalog.Tables:
    """A store of its own for one run, in the folder that all executors share."""
    return catalog.Tables(spark, f"{catalog.shared_folder(spark)}/store-{uuid.uuid4().hex}")


def stored_chunks(spark, sf_dir):
    """Chunks of documents, some of which are replaced twice and some cleared."""
    t, d = _tables(spark), _read(spark, sf_dir, "documents")
    rows = lambda where, version: d.where(where).select(F.col("doc_id").alias("document_id"), F.lit(version).alias("version"), F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("ord"))
    t.merge("parts", rows("true", 0), "document_id")
    t.merge("parts", rows("doc_id % 2 = 0", 1), "document_id")
    t.merge("parts", rows("doc_id % 6 = 0", 2), "document_id", d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id")))
    return t.read("parts").groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


WORDS = ("tide", "wind", "sea")


def _embedded(column):
    return F.array(*(F.size(F.split(F.lower(column), w)).cast("float") - 1 for w in WORDS)).cast("array<float>")


def _fetched(pages: DataFrame) -> DataFrame:
    n = F.regexp_extract("url", r"/p(\d+)$", 1).cast("long")
    ok = n % 5 != 4
    return pages.select(
        "document_id", ok.alias("ok"), (n % 10 == 9).alias("retry"), F.when(~ok, F.when(n % 10 == 4, "dead link: 404").otherwise("no answer")).alias("error"), "fetcher",
        F.concat(F.lit("tide wind "), n.cast("string")).alias("markdown"), F.concat(F.lit("Sea "), n.cast("string")).alias("title"), F.lit("article").alias("content_type"),
    )


#: The stores that _worked has made, by application and tables.
_STORES: dict[tuple[str, str], Engine] = {}


def _worked(spark: SparkSession, sf_dir: str) -> Engine:
    """A store that starts empty: pages are imported as bookmarks, fetched from a made-up web and indexed by jobs. The queries that read it share one run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORES and _STORES[key].tables.exists("jobs"):
        return _STORES[key]
    e = Engine(spark, _tables(spark).root, config.load_settings("embedding_dim: 3\nsearch: {bm25_weight: 1000}"), _embedded)
    incoming = _numbered(spark, sf_dir).select(_k().alias("place"), _url().alias("url"), F.lit("").alias("title"), F.lit("").alias("folder_path"), F.array(F.lit("t")).alias("tags"), F.lit(None).cast("timestamp").alias("saved_at"))
    e.import_bookmarks(incoming, "html", _now())
    e.work(_fetched, now=_now())
    _STORES[key] = e
    return e


def worked_jobs(spark, sf_dir):
    """What becomes of the jobs of an import."""
    t = _worked(spark, sf_dir).tables
    return t.read("jobs").groupBy("kind", "status", F.coalesce("last_error", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def worked_documents(spark, sf_dir):
    """What becomes of the documents of an import, and what each table holds."""
    e = _worked(spark, sf_dir)
    docs = e.tables.read("documents").groupBy("state").agg(F.count("*").alias("n"), F.count("current_extraction_id").alias("extracted"), F.sum("word_count").alias("words")).withColumnRenamed("state", "what")
    sizes = [e.tables.read(n).agg(F.lit(n).alias("what"), F.count("*").alias("n"), F.count_distinct("document_id").alias("extracted"), F.lit(None).cast("long").alias("words")) for n in ("document_extractions", "chunks", "chunk_vectors", "chunk_lengths", "postings")]
    for s in sizes:
        docs = docs.unionByName(s)
    return docs


def worked_search(spark, sf_dir):
    """A search of the written index: a number that stands in one text and title."""
    hits = _worked(spark, sf_dir).search("tide 12", k=1)
    return hits.select("title", "rank", F.size("chunks").alias("n_chunks"), F.get("chunks", F.lit(0))["snippet"].alias("snippet"))


def queue_drain(spark, sf_dir):
    """Three claims of a queue whose handler fails some jobs, for good or not, and says nothing of others."""
    t = _tables(spark)
    t.replace("jobs", _jobs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status"))))
    handle = lambda rows: worker.said(rows.where("kind <> 'signup'"), F.col("kind") == "view", F.col("kind") == "click", F.concat(F.lit("no "), F.col("kind")))
    queue.drain(t, None, handle, _now(), n=max(1, t.read("jobs").count() // 3))
    return t.read("jobs").groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"), F.count_if(F.col("updated_at") == _now()).alias("handled"), F.max(F.when(F.col("updated_at") == _now(), F.col("last_error"))).alias("error"))


def cluster_counts(spark, sf_dir):
    """Sizes and noise of given labels."""
    p = _read(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")).alias("label"))
    return p.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"))


def interest_list(spark, sf_dir):
    """The three largest topics with their two most central members."""
    e = _read(spark, sf_dir, "embeddings")
    clusters = e.groupBy(F.col("label").cast("string").alias("id")).agg(F.count("*").alias("size"), F.round(F.avg(F.col("vec_id") % 10) / 10, 6).alias("cohesion"))
    members = e.select(F.col("label").cast("string").alias("cluster_id"), F.col("vec_id").alias("document_id"), ((F.col("vec_id") % 97) / 97).alias("similarity"))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("url"))
    out = interests.interests(clusters, members, docs, 3, 2)
    return out.select("id", "size", F.explode("members").alias("m")).select("id", "size", "m.document_id", "m.title")


def query_terms(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.label_terms(F.col("text")), " ").alias("terms"))


NAMES = (
    "page_markdown fetched_pages host_answers export_html export_chrome export_safari firefox_folders time_rules fetch_classes reader_answers front_matters caption_texts video_pages code_threads code_pages pdf_texts data_urls label_answers label_prompts "
    "judged_queries dispatch_rules bookmark_list bookmark_delete search_bookmarked hydrated_hits document_vectors latest_run refetch_jobs reindex_jobs corpus_stats orphan_jobs failed_documents state_changes "
    "dangling_documents stored_chunks worked_jobs worked_documents worked_search queue_drain cluster_counts interest_list query_terms"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
