"""Hybrid and related-document search over chunk tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from . import fusion, lexical, vector_search

TENANT = "local"


@dataclass(frozen=True)
class Filters:
    """Each empty filter holds for all; values of one are alternatives."""

    content_types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    exclude_document: object = None

    def empty(self) -> bool:
        return not (self.content_types or self.sources or self.hosts) and self.exclude_document is None


def matching(documents: DataFrame, filters: Filters, bookmarks: DataFrame | None = None, tenant: str | None = TENANT) -> DataFrame:
    """documents (document_id, and the columns that filters name) that a search may return.

    sources asks for a bookmark of the document from one of them; without a table of bookmarks, for the document's own
    column source. Hosts are compared exactly, without port and subdomains.
    """
    out = documents
    if tenant is not None and "tenant_id" in documents.columns:
        out = out.where(F.col("tenant_id") == tenant)
    if filters.content_types:
        out = out.where(F.col("content_type").isin(*filters.content_types))
    if filters.sources:
        if bookmarks is None:
            out = out.where(F.col("source").isin(*filters.sources))
        else:
            kept = bookmarks.where(F.col("source").isin(*filters.sources)).select("document_id")
            out = out.join(kept, "document_id", "left_semi")
    if filters.hosts:
        out = out.where(urls.hostname(F.col("url")).isin(*(h.lower() for h in filters.hosts)))
    if filters.exclude_document is not None:
        out = out.where(F.col("document_id") != filters.exclude_document)
    return out


def bm25_search(chunks: DataFrame, documents: DataFrame, query: str, limit: int = 50, columns: tuple[str, ...] = ("text",), stemmed: bool = True, with_snippets: bool = False) -> DataFrame:
    """(chunk_id, document_id, score, rank[, snippet]) of chunks (chunk_id, document_id, indexed columns) of documents.

    Statistics count all chunks; documents decide afterwards which may be returned. An empty result for a query without words.
    """
    phrases = lexical.phrases_of(query, stemmed)
    keep = ("document_id",)
    if stemmed:
        found = lexical.scores_of_texts(chunks, phrases, columns, keep)
    else:
        found = lexical.scores(lexical.index(chunks, columns=columns, stemmed=False, keep=keep), phrases, keep)
    return _best(found, chunks, documents, phrases, limit, with_snippets)


def index_search(
    posted: DataFrame, lengths: DataFrame, chunks: DataFrame, documents: DataFrame, query: str, limit: int = 50, stats: DataFrame | None = None, frequencies: DataFrame | None = None
) -> DataFrame:
    """bm25_search, with snippets, over a written index: postings and chunk lengths, or, where they are kept, one row of statistics (n_all, mean) and
    terms' frequencies. Postings of the query's terms are read; of chunks, the texts of the `limit` best ones. Postings
    without document_id are joined with chunks for it."""
    phrases = lexical.phrases_of(query)
    keep = ("document_id",) if "document_id" in posted.columns else ()
    found = lexical.scores_of_postings(posted, lexical.statistics(lengths) if stats is None else stats, phrases, keep, frequencies)
    found = found if keep else found.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    best = lexical.top(found.join(documents.select("document_id"), "document_id", "left_semi"), limit).select("chunk_id", "score", "document_id", "rank")
    return _with_snippets(best, chunks, phrases, ("chunk_id",))


def _best(found: DataFrame, chunks: DataFrame, documents: DataFrame, phrases: list[list[str]], limit: int, with_snippets: bool) -> DataFrame:
    # Documents without an id are left out by the table alone: a plain equality would leave them out of the scores too, below the exchange that the
    # statistics share, and chunks would be cut into tokens twice.
    kept = documents.where("document_id is not null").select(F.col("document_id").alias("kept"))
    best = lexical.top(found.select("chunk_id", "score", "document_id").join(kept, F.col("document_id").eqNullSafe(F.col("kept")), "left_semi"), limit)
    # by document too: a filter on the chunk alone may only be known when all documents are cut into chunks
    return _with_snippets(best, chunks, phrases, ("document_id", "chunk_id")) if with_snippets else best


def _with_snippets(best: DataFrame, chunks: DataFrame, phrases: list[list[str]], by: tuple[str, ...]) -> DataFrame:
    """best with snippets of its chunks, which are picked by the columns `by`. Its rows are fetched, so that they are found once."""
    rows = best.collect()  # `limit` rows
    for c in by:
        chunks = chunks.where(F.col(c).isin(*{r[c] for r in rows}))
    texts = chunks.select("chunk_id", lexical.snippets(F.col("text"), phrases).alias("snippet"))
    return chunks.sparkSession.createDataFrame(rows, best.schema).join(texts, "chunk_id")


def vector_leg(vectors: DataFrame, documents: DataFrame, query: DataFrame, limit: int = 50) -> DataFrame:
    """(chunk_id, document_id, distance, score, rank) of vectors (chunk_id, document_id, embedding) of documents."""
    return vector_search.nearest(vectors.select("chunk_id", "document_id", "embedding").join(documents.select("document_id"), "document_id", "left_semi"), query, limit)


def hybrid(bm25: DataFrame, near: DataFrame, k: int = 10, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = 60, strategy: str = "max") -> DataFrame:
    """(document_id, score, rank, chunks) from the two legs' results. Each chunk shows its fused score and the score of each leg
    that found it."""
    weights = tuple(w or 1.0 for w in weights)
    legs = [x.withColumnRenamed("chunk_id", "id") for x in (bm25, near)]
    shown = {"snippet": "snippet"} if "snippet" in bm25.columns else {}
    carried = [{"document_id": "document_id", "score": "bm25_score", **shown}, {"document_id": "document_id", "score": "vector_score"}]
    fused = fusion.fuse(legs, list(weights), rrf_k, carried=carried)
    return fusion.collapse(fused.withColumnRenamed("id", "chunk_id"), strategy, k)


def hybrid_queries(posted: DataFrame, stats: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, limit: int = 50, documents: DataFrame | None = None, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = 60, strategy: str = "max", stemmed: bool = False) -> DataFrame:
    """(query_id, document_id, score, rank, chunks): hybrid search for each of queries (query_id, text, embedding), in one plan.

    posted: a written index (lexical.postings or inverted, with document_id); stats: one row (n_all, mean) of all chunks; vectors: (chunk_id, document_id,
    embedding). Each leg gives a query's `limit` best chunks, of documents (document_id) alone if they are given. A query without
    words, or without a vector, has the other leg only; one without either is not in the result.
    """
    scored = lexical.scores_of_queries(posted, stats, queries, stemmed=stemmed)
    if documents is not None:
        kept = documents.select("document_id").distinct()
        scored, vectors = scored.join(kept, "document_id", "left_semi"), vectors.join(kept, "document_id", "left_semi")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    words = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    near = vector_search.nearest_many(vectors.select("chunk_id", "document_id", "embedding"), queries, limit)
    legs = [x.withColumnRenamed("chunk_id", "id") for x in (words, near)]
    carried = [{"document_id": "document_id", "score": "bm25_score"}, {"document_id": "document_id", "score": "vector_score"}]
    fused = fusion.fuse(legs, [w or 1.0 for w in weights], rrf_k, key=("query_id",), carried=carried)
    return fusion.collapse(fused.withColumnRenamed("id", "chunk_id"), strategy, k, key=("query_id",))


def related(vectors: DataFrame, documents: DataFrame, document, k: int = 10, strategy: str = "max", fanout: int = 50, pooled: int = 64) -> DataFrame:
    """(document_id, score, rank, chunks) of the documents nearest to a document's mean vector.

    The mean is that of its first `pooled` chunks. max(fanout, 8 k) chunks of other documents are collapsed by 1 / (1 + distance). A
    document without vectors is related to none. vectors: (chunk_id, document_id, ord, embedding).
    """
    query = vector_search.leading_mean(vectors, document, pooled)
    others = matching(documents, Filters(exclude_document=document), tenant=None)
    near = vector_leg(vectors, others, query, max(fanout, 8 * k))
    return fusion.collapse(near.select("document_id", "chunk_id", "score"), strategy, k)


def hydrate(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits with the columns of their documents. hits are few, so they are what is sent round."""
    return documents.join(F.broadcast(hits), "document_id")
