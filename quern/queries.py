"""The registered queries of the engine and their SQL, over the driver's tables.

How the tables stand for the engine's: documents are cut into windows of words, which are chunks (chunk_id = doc_id * 1,000,000 + ord);
embeddings are chunk vectors, of the chunk vec_id * 1,000,000 or, where a document has many, of the document vec_id % 50; pages give URLs;
events give jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pages as page_rules
from .functions import text, urls, vectors
from .operators import catalog, chunking, clustering, evaluation, fusion, jobs, lexical, search, vector_search
from .plans import imports
from .sources import config, readers

QUERY = "ernt, retion; the rely aned"
TERMS = ["ernt", "retion", "rely", "aned"]
RULES = """
rules:
  - match: {host_in: [ththre.example.com, spam-farm.example.org]}
    fetcher: skip
  - match: {host_suffix: example.org}
    fetcher: native
  - match: {host: www.cheap-pills.example.com}
    fetcher: skip
  - match: {host_suffix: .example.net}
    fetcher: reader
"""
NOW = "2024-01-30 12:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = chunking.word_windows(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return w.select((F.col("doc_id") * 1_000_000 + F.col("ord")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "ord", F.array_join("words", " ").alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the URL of the page of the same number."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), "url")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("content_type"), "source")
    return docs.join(pages, "document_id", "left")


def _vectors(spark: SparkSession, sf_dir: str, documents: int = 0) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    if documents:
        return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % documents).alias("document_id"), F.floor(F.col("vec_id") / documents).alias("ord"), "embedding")
    return e.select((F.col("vec_id") * 1_000_000).alias("chunk_id"), F.col("vec_id").alias("document_id"), F.lit(0).alias("ord"), "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    status = F.when(k >= 80, "failed").when(k < 10, "running").when(k < 20, "pending").otherwise("done")
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.lit("local").alias("tenant_id"), F.col("event_type").alias("kind"), F.to_json(F.struct(F.col("user_id").alias("document_id"))).alias("payload"), status.alias("status"), (k % 6).alias("attempts"),
        F.timestamp_micros(F.unix_micros(ts) + k.cast("long") * 60_000_000).alias("run_after"), ts.alias("created_at"), F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1000).cast("long")).alias("updated_at"),
        F.when(k >= 80, F.concat(F.lit("error "), k.cast("string"))).alias("last_error"), F.when(k != 50, ts).alias("started_at"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- search ------------------------------------------------------------------------------------------------------


def sanitize_query(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", text.sanitized(F.col("text")).alias("match"), F.size(text.query_words(F.col("text"))).alias("n_words"))


def chunk_windows(spark, sf_dir):
    w = chunking.word_windows(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return w.select("doc_id", "ord", "token_count", F.md5(F.array_join("words", " ")).alias("text_md5"))


def chunk_documents(spark, sf_dir):
    c = chunking.chunk_documents(_read(spark, sf_dir, "documents"), size=chunking.Sizes(overlap=48))
    return c.select("doc_id", "ord", "token_count", F.octet_length("text").alias("bytes"), F.md5("text").alias("text_md5"))


def _bm25(spark, sf_dir, filters=search.Filters()):
    return search.bm25_search(_chunks(spark, sf_dir), search.matching(_documents(spark, sf_dir), filters), QUERY, stemmed=False)


def bm25_topk(spark, sf_dir):
    return _round(_bm25(spark, sf_dir), 9, "score").select("chunk_id", "document_id", "score", "rank")


def bm25_phrases(spark, sf_dir):
    """Stems, a phrase, and snippets."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return search.bm25_search(_chunks(spark, sf_dir), docs, "ernts of the state-of-ing on-the retion", with_snippets=True)


def postings(spark, sf_dir):
    p = lexical.postings(lexical.index(_chunks(spark, sf_dir), stemmed=False))
    return p.select("term", "chunk_id", "tf", F.element_at("positions", 1).alias("first_at"))


def search_filtered_type(spark, sf_dir):
    return _round(_bm25(spark, sf_dir, search.Filters(content_types=("fr", "de"))), 9, "score").select("chunk_id", "document_id", "score", "rank")


def search_filtered_source(spark, sf_dir):
    return _round(_bm25(spark, sf_dir, search.Filters(sources=("src1", "src2", "src3"))), 9, "score").select("chunk_id", "document_id", "score", "rank")


def search_filtered_host(spark, sf_dir):
    hosts = ("blog.ththan.example.net", "thther.example.org", "therha.example.com", "ththre.example.com", "m.ththth.example.net")
    return _round(_bm25(spark, sf_dir, search.Filters(hosts=hosts)), 9, "score").select("chunk_id", "document_id", "score", "rank")


def _near(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return search.vector_leg(_vectors(spark, sf_dir), docs, _asked(spark, sf_dir))


def vector_topk(spark, sf_dir):
    return _round(_near(spark, sf_dir), 9, "distance", "score").select("chunk_id", "document_id", "distance", "score", "rank")


def rrf_fuse(spark, sf_dir):
    legs = [x.select(F.col("chunk_id").alias("id"), "rank") for x in (_bm25(spark, sf_dir), _near(spark, sf_dir))]
    return _round(fusion.fuse(legs, [1.0, 0.5]), 12, "score")


def hybrid_search(spark, sf_dir):
    hits = search.hybrid(_bm25(spark, sf_dir), _near(spark, sf_dir))
    best = F.get("chunks", F.lit(0))
    return _round(hits.select("document_id", "score", "rank", F.size("chunks").alias("n_chunks"), best["chunk_id"].alias("best_chunk"), F.round(best["bm25_score"], 9).alias("bm25_score"), F.round(best["vector_score"], 9).alias("vector_score")), 12, "score")


def _collapsed(spark, sf_dir, strategy):
    hits = fusion.collapse(_bm25(spark, sf_dir).select("document_id", "chunk_id", "score"), strategy)
    return _round(hits.select("document_id", "score", "rank", F.size("chunks").alias("n_chunks")), 9, "score")


def collapse_max(spark, sf_dir):
    return _collapsed(spark, sf_dir, "max")


def collapse_sum(spark, sf_dir):
    return _collapsed(spark, sf_dir, "sum")


def collapse_top3(spark, sf_dir):
    return _collapsed(spark, sf_dir, "top3_avg")


def related_docs(spark, sf_dir):
    v = _vectors(spark, sf_dir, 50)
    hits = search.related(v, v.select("document_id").distinct(), 7, 10)
    return _round(hits.select("document_id", "score", "rank", F.size("chunks").alias("n_chunks")), 9, "score")


# --- URLs --------------------------------------------------------------------------------------------------------


def url_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized"))


def url_dedup(spark, sf_dir):
    n = url_normalize(spark, sf_dir).withColumn("key", F.regexp_replace("normalized", r"/[0-9]+(\.html|/)?(\?.*)?$", ""))
    return n.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def url_hostname(spark, sf_dir):
    return _read(spark, sf_dir, "pages").groupBy(urls.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def tracking_params(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select(F.explode(urls.parameters(F.col("url"))).alias("p"))
    return p.groupBy(F.col("p.name").alias("name"), urls.tracking_name(F.col("p.name")).alias("tracking")).agg(F.count("*").alias("n"))


def host_dispatch(spark, sf_dir):
    rules = config.rules_table(spark, config.load_rules(RULES))
    return imports.dispatched(_read(spark, sf_dir, "pages").select("page_id", "url"), rules, "fallback").select("page_id", "fetcher")


def _incoming(spark, sf_dir):
    """Pages as bookmarks of which some can't be indexed."""
    k, u = F.col("page_id") % 9, F.col("url")
    url = F.when(k == 1, F.concat(F.lit("javascript:open('"), u, F.lit("')"))).when(k == 2, F.lit("file:///tmp/x")).when(k == 3, F.lit("chrome://settings")).when(k == 4, F.lit("  ")).when(k == 5, F.concat(F.lit("ftp"), u)).when(k == 6, F.lit("http://[bad")).otherwise(u)
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), url.alias("url"), F.lit("").alias("title"), F.lit("/Web").alias("folder_path"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("timestamp").alias("saved_at"))


def indexable_reasons(spark, sf_dir):
    return imports.filtered(_incoming(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def import_counts(spark, sf_dir):
    """Imports the pages' URLs without their last part where some documents and bookmarks are there already."""
    cut = F.regexp_replace("url", r"/[^/]*/?$", "/")
    incoming = _incoming(spark, sf_dir).withColumn("url", F.when(F.col("url").rlike("^https?://[^\\[]"), cut).otherwise(F.col("url")))
    old = _read(spark, sf_dir, "pages").where("page_id % 9 in (0, 7, 8) and page_id % 4 = 0").select(urls.normalized(cut).alias("url")).distinct()
    docs = old.select(F.md5("url").alias("id"), F.lit("local").alias("tenant_id"), "url", F.when(F.length("url") % 2 == 0, "fetched").otherwise("pending").alias("state"))
    marks = old.where("length(url) % 3 = 0").select(F.lit("local").alias("tenant_id"), "url", F.lit("html").alias("source"))
    c = imports.import_bookmarks(incoming, docs, marks, "html", _now()).counts
    return c.select("total", "filtered", "created", "skipped", "jobs_enqueued", F.array_join(F.transform(F.map_entries("filtered_by"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("filtered_by"))


def url_video_ids(spark, sf_dir):
    k, v = F.col("page_id") % 6, F.concat(F.lit("v"), F.col("page_id").cast("string"))
    u = (
        F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?list=a&v="), v, F.lit("&t=1")))
        .when(k == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?si=1")))
        .when(k == 2, F.concat(F.lit("http://m.youtube.com/shorts/"), v))
        .when(k == 3, F.concat(F.lit("https://youtube.com/embed/"), v, F.lit("/more")))
        .when(k == 4, F.concat(F.lit("https://youtube.com/live/"), v))
        .otherwise(F.col("url"))
    )
    return _read(spark, sf_dir, "pages").select("page_id", urls.video_id(u).alias("video"), urls.normalized(u).alias("normalized"))


def url_repositories(spark, sf_dir):
    k, n = F.col("page_id") % 8, F.col("page_id").cast("string")
    tail = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("/blob/main/src/a"), n, F.lit(".py"))).when(k == 2, F.concat(F.lit("/issues/"), n)).when(k == 3, F.concat(F.lit("/pull/"), n, F.lit("/files"))).when(k == 4, F.lit("/wiki")).when(k == 5, F.concat(F.lit("/wiki/Page-"), n)).when(k == 6, F.lit("/issues/new")).otherwise(F.lit("/releases"))
    owner = F.when(F.col("page_id") % 11 == 0, "settings").otherwise(F.concat(F.lit("o"), n))
    r = urls.repository(F.concat(F.lit("https://github.com/"), owner, F.lit("/repo"), tail))
    return _read(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", "r.*")


# --- jobs --------------------------------------------------------------------------------------------------------


def job_metrics(spark, sf_dir):
    m = jobs.metrics(_jobs(spark, sf_dir), _now(), 20 * 86_400)
    return _round(m, 3, "mean_ms", "p50_ms", "p95_ms", "p99_ms")


def job_inflight(spark, sf_dir):
    return jobs.in_flight(_jobs(spark, sf_dir), _now())


def count_by_status(spark, sf_dir):
    return jobs.count_by(_jobs(spark, sf_dir), "status")


def _job_documents(spark, sf_dir):
    users = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id")).where("user_id % 5 <> 0").distinct()
    return users.select("id", F.lit("local").alias("tenant_id"), F.concat(F.lit("http://d/"), F.col("id")).alias("url"), F.concat(F.lit("Title "), F.col("id")).alias("title"), F.when(F.length("id") == 2, F.concat(F.lit("x"), F.col("id"))).alias("current_extraction_id"))


def latest_failed_per_doc(spark, sf_dir):
    docs = _job_documents(spark, sf_dir)
    return jobs.latest_failures(docs, _jobs(spark, sf_dir)).select("id", "last_error")


def jobs_with_doc(spark, sf_dir):
    docs = _job_documents(spark, sf_dir)
    runs = docs.where("current_extraction_id is not null").select(F.col("current_extraction_id").alias("id"), F.lit("native").alias("fetcher"))
    return jobs.with_documents(_jobs(spark, sf_dir), docs, runs, 100, status="failed").select("id", "kind", "document_id", "url", "title", "fetcher")


def newest_jobs(spark, sf_dir):
    return jobs.newest(_jobs(spark, sf_dir), 100, kind="error").select("id", "status")


def claim_jobs(spark, sf_dir):
    return jobs.claim(_jobs(spark, sf_dir), _now(), 200, ("view", "click")).select("id", "kind", "status", "attempts")


def retry_backoff(spark, sf_dir):
    running = _jobs(spark, sf_dir).where("status = 'running'")
    after = jobs.after_failure(running, _now(), F.lit("timeout"), F.col("kind") != "purchase")
    wait = F.when(F.col("status") == "pending", (F.unix_micros("run_after") - F.unix_micros(_now())) / 1_000_000).cast("long")
    return after.select("id", "status", "attempts", wait.alias("wait_s"))


def prune_jobs(spark, sf_dir):
    stay, gone = jobs.pruned(_jobs(spark, sf_dir), before=F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return stay.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True))).groupBy("kind", "gone").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def keyset_page(spark, sf_dir):
    return jobs.page(_jobs(spark, sf_dir).where("kind = 'signup'"), 500, 120).select("id", "next_cursor")


def host_failures(spark, sf_dir):
    """Kinds of user's latest events, as hosts' failures, within a day."""
    f = _read(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("seen_at"))
    return jobs.live_hosts(f, _now(), 86_400)


def event_rates(spark, sf_dir):
    from .streaming import queue

    e = _read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return queue.rates(e, "6 hours").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "kind", "n")


# --- tables ------------------------------------------------------------------------------------------------------


def documents_upsert(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    row = lambda cond, **c: d.where(cond).select(F.lit("local").alias("tenant_id"), F.concat(F.lit("http://d/"), F.col("doc_id").cast("string")).alias("url"), *(v.alias(k) for k, v in c.items()))
    old = row("doc_id % 3 <> 0", id=F.concat(F.lit("old"), F.col("doc_id").cast("string")), content_type=F.lit("unknown"), state=F.lit("pending"), title=F.when(F.col("doc_id") % 2 == 0, F.col("source")), language=F.col("lang"))
    new = row("doc_id % 3 <> 1", id=F.concat(F.lit("new"), F.col("doc_id").cast("string")), content_type=F.lit("article"), state=F.lit("fetched"), title=F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("T"), F.col("source"))), language=F.lit(None).cast("string"))
    return catalog.upsert_documents(old, new)


def chunks_replace(spark, sf_dir):
    w = _chunks(spark, sf_dir).select("document_id", "ord", F.md5("text").alias("text_md5"))
    new = w.where("document_id % 4 = 0 and ord = 0").withColumn("text_md5", F.md5("text_md5"))
    return catalog.replace_chunks(w, new, w.where("document_id % 4 = 0")).groupBy("document_id").agg(F.count("*").alias("n"), F.min("text_md5").alias("least"))


def bookmark_insert(spark, sf_dir):
    """Documents as bookmarks whose URLs repeat; some are there already."""
    d = _read(spark, sf_dir, "documents").select(F.lit("local").alias("tenant_id"), F.concat(F.lit("http://d/"), (F.col("doc_id") % 97).cast("string")).alias("url"), "source", "doc_id")
    added, conflicts = catalog.insert_bookmarks(d.where("doc_id % 10 = 0"), d.where("doc_id % 10 <> 0"), F.col("doc_id"))
    return added.withColumn("added", F.lit(True)).unionByName(conflicts.withColumn("added", F.lit(False))).select("doc_id", "added")


def tag_union(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 7 == 0, "no json").otherwise(F.to_json(F.array(F.col("lang"), F.concat(F.lit(" "), F.col("source")), F.lit(""))))
    rows = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("document_id"), tags.alias("tags"))
    return catalog.tag_union(rows).select("document_id", F.array_join("tags", "|").alias("tags"))


def conversation_threads(spark, sf_dir):
    m = readers.conversation_markdown(_read(spark, sf_dir, "conversations"))
    return m.select("conv_id", "turns", F.md5("markdown").alias("markdown_md5"))


def page_titles(spark, sf_dir):
    """Each page's title, and why it would be no article if it had been reached from its site's root."""
    p = _read(spark, sf_dir, "pages")
    title = page_rules.title(F.col("html"))
    end = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^(https?://[^/]*).*$", "$1/")).when(F.col("page_id") % 3 == 1, F.lit("https://other.example.com/x")).otherwise(F.col("url"))
    reason = F.coalesce(page_rules.gone(title, F.col("url"), end), page_rules.login_wall(F.col("html"), title, F.col("url"), end))
    return p.select("page_id", F.md5(title).alias("title_md5"), reason.alias("reason"))


# --- vectors, topics, evaluation ------------------------------------------------------------------------------------


def _values(df: DataFrame, key: list[str], column: str, places: int) -> DataFrame:
    return df.select(*key, F.posexplode(column).alias("at", "x")).withColumn("x", F.round(F.col("x").cast("double"), places))


def mean_pool(spark, sf_dir):
    return _values(vector_search.mean_pooled(_points(spark, sf_dir), ["label"], as_float=False), ["label", "n"], "embedding", 9)


def corpus_mean(spark, sf_dir):
    return _values(clustering.corpus_mean(_points(spark, sf_dir)), [], "mean", 9)


def center_unit(spark, sf_dir):
    u = clustering.unit_residuals(_points(spark, sf_dir))
    return u.select("id", F.round(vectors.dot(F.col("unit"), F.col("unit")), 4).alias("norm2"), F.round(F.get("unit", F.lit(0)).cast("double"), 5).alias("first"))


def knn_graph(spark, sf_dir):
    units = clustering.unit_residuals(_points(spark, sf_dir), center=False)
    return _round(clustering.undirected(clustering.knn_edges(units, 10, 0.3)), 6, "w")


def cluster_knn_lpa(spark, sf_dir):
    return clustering.cluster(_points(spark, sf_dir), min_similarity=0.3, center=True)


def cluster_summary(spark, sf_dir):
    p = _points(spark, sf_dir)
    sizes, _ = clustering.summaries(p, p.select("id", "label"))
    return _round(sizes, 4, "cohesion")


def cluster_members(spark, sf_dir):
    p = _points(spark, sf_dir)
    _, members = clustering.summaries(p, p.select("id", "label"))
    return _round(members.where("rank <= 12"), 4, "similarity").select("label", "id", "similarity")


def term_labels(spark, sf_dir):
    """The frequent terms of the first lines of each source's documents."""
    d = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("rank"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    return clustering.term_labels(d, ["source"])


def _rankings(spark, sf_dir):
    """Each label's vectors by distance from its first one, against the documents of good quality."""
    p = _points(spark, sf_dir)
    first = p.groupBy("label").agg(F.min_by("embedding", "id").alias("q"))
    ranked = p.join(F.broadcast(first), "label").select(F.col("label").alias("query_id"), "id", F.round(vectors.distance(F.col("embedding"), F.col("q")), 9).alias("d"))
    from pyspark.sql import Window as W

    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("d", "id"))).where("rank <= 50")
    good = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    judged = p.join(good, "id").select(F.col("label").alias("query_id"), "id")
    return evaluation.per_query(ranked, judged, 10)


def eval_per_query(spark, sf_dir):
    return _round(_rankings(spark, sf_dir), 9, "recall", "precision", "ndcg", "rr")


def eval_means(spark, sf_dir):
    return _round(evaluation.means(_rankings(spark, sf_dir)), 9, "mean_recall", "mean_precision", "mean_ndcg", "mrr")


NAMES = (
    "hybrid_search sanitize_query chunk_windows chunk_documents bm25_topk bm25_phrases postings search_filtered_type search_filtered_source search_filtered_host vector_topk rrf_fuse collapse_max collapse_sum collapse_top3 related_docs "
    "url_normalize url_dedup url_hostname tracking_params host_dispatch indexable_reasons import_counts url_video_ids url_repositories "
    "job_metrics job_inflight count_by_status latest_failed_per_doc jobs_with_doc newest_jobs claim_jobs retry_backoff prune_jobs keyset_page host_failures event_rates "
    "documents_upsert chunks_replace bookmark_insert tag_union conversation_threads page_titles "
    "mean_pool corpus_mean center_unit knn_graph cluster_knn_lpa cluster_summary cluster_members term_labels eval_per_query eval_means"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
