"""From bookmarks to indexed documents: import, fetch results, index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import catalog, chunking, jobs
from ..operators.stage import keep
from ..schemas import SOURCES


def dispatched(pages: DataFrame, rules: DataFrame, fallback: str | None = None, url_col: str = "url") -> DataFrame:
    """pages with fetcher: that of the first rule whose hosts cover the URL's host, else the fallback.

    Rules are a short list, but a page may match many: each host, not each page, meets the rules.
    """
    hosts = pages.select(urls.hostname(F.col(url_col)).alias("_host")).distinct()
    first = hosts.join(F.broadcast(rules), urls.host_matches(F.coalesce("_host", F.lit("")), F.col("kind"), F.col("hosts"))).groupBy("_host").agg(F.min_by("fetcher", "rule_no").alias("_fetcher"))
    joined = pages.withColumn("_h", urls.hostname(F.col(url_col))).join(first, F.col("_h").eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("fetcher", F.coalesce("_fetcher", F.lit(fallback))).drop("_h", "_host", "_fetcher")


def filtered(bookmarks: DataFrame, url_col: str = "url") -> DataFrame:
    """bookmarks with reason (null: it can be indexed) and normalized."""
    return bookmarks.withColumn("reason", urls.filter_reason(F.col(url_col))).withColumn("normalized", F.when(F.col("reason").isNull(), urls.normalized(urls.stripped(F.col(url_col)))))


MOST_ERRORS = 10


@dataclass
class Import:
    """What an import adds: documents, bookmarks and fetch jobs; and its counts, one row."""

    documents: DataFrame
    bookmarks: DataFrame
    jobs: DataFrame
    counts: DataFrame


def import_bookmarks(incoming: DataFrame, documents: DataFrame, bookmarks: DataFrame, source: str, now: Column, tenant: str = "local") -> Import:
    """Adds bookmarks (place, url, title, folder_path, tags, saved_at) of one source.

    Those that can't be indexed go, by reason; the first MOST_ERRORS of them are listed. A document is made for a URL that has none; of bookmarks with one URL the first is added,
    unless there is one from this source; an added one whose document is pending gets a fetch job. What is incoming is written once, with its canonical
    URLs, to the folder for checkpoints, and the results read that.
    """
    if source not in SOURCES:
        raise ValueError(f"source must be one of {', '.join(SOURCES)}")
    seen = keep(filtered(incoming))  # canonical URLs are found once, in Python
    good = seen.where("reason is null").select("place", F.col("normalized").alias("url"), "title", "folder_path", "tags", F.coalesce("saved_at", now).alias("saved_at"))
    own = documents.where(F.col("tenant_id") == tenant).select("url", F.col("id").alias("document_id"), "state")
    made = good.select("url").distinct().join(own, "url", "left_anti")
    made = made.withColumn("document_id", catalog.stable_id(F.lit(tenant), F.col("url"))).withColumn("state", F.lit("pending"))
    known = own.unionByName(made.select("url", "document_id", "state"))
    rows = good.withColumn("tenant_id", F.lit(tenant)).withColumn("source", F.lit(source))
    added, conflicts = catalog.insert_bookmarks(bookmarks, rows, F.col("place"))
    added = added.join(known, "url")
    todo = added.where("state = 'pending'").select("document_id")
    reasons = seen.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    by = F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("filtered_by")
    first = seen.where("reason is not null").orderBy("place").limit(MOST_ERRORS).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "url", "reason"))), lambda e: F.concat_ws(": ", e["url"], e["reason"])).alias("errors"))
    total = seen.agg(F.count("*").alias("total"), F.count("reason").alias("filtered"))
    counts = total.crossJoin(added.agg(F.count("*").alias("created"), F.count_if(F.col("state") == "pending").alias("jobs_enqueued"))).crossJoin(conflicts.agg(F.count("*").alias("skipped"))).crossJoin(reasons.agg(by)).crossJoin(first)  # one row each
    return Import(
        made.select(F.col("document_id").alias("id"), F.lit(tenant).alias("tenant_id"), "url", F.lit("unknown").alias("content_type"), "state", now.alias("created_at"), now.alias("updated_at")),
        added.select(
            catalog.stable_id(F.lit(tenant), F.col("url"), F.lit(source)).alias("id"), "tenant_id", "url", "source", "saved_at", now.alias("created_at"), now.alias("updated_at"), "document_id",
            F.when(F.col("title") != "", F.col("title")).alias("title"), F.when(F.col("folder_path") != "", F.col("folder_path")).alias("folder_path"), "tags",
        ),
        jobs.new_jobs(todo, "fetch", now, tenant),
        counts,
    )


def index_documents(extractions: DataFrame, chunks: DataFrame, size: chunking.Sizes = chunking.Sizes(overlap=48), prefix: str = "search_document: ") -> DataFrame:
    """chunks with those of the extracted documents (document_id, markdown) replaced; embed_text goes to the embedding model."""
    new = chunking.chunk_documents(extractions, "document_id", "markdown", size, prefix)
    return catalog.replace_chunks(chunks, new.select(*chunks.columns), extractions)


def embedded(chunks: DataFrame, embed, text_col: str = "embed_text") -> DataFrame:
    """(chunk_id, document_id, ord, embedding) by a function from a text column to a vector column, such as a pandas UDF that asks
    a model for a batch at a time."""
    return chunks.select("chunk_id", "document_id", "ord", embed(F.col(text_col)).alias("embedding"))
