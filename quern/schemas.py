"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _table(required: dict, optional: dict | None = None) -> T.StructType:
    fields = [T.StructField(k, v, False) for k, v in required.items()]
    return T.StructType(fields + [T.StructField(k, v, True) for k, v in (optional or {}).items()])


DOCUMENTS = _table(
    {"id": _S, "tenant_id": _S, "url": _S, "content_type": _S, "state": _S, "created_at": _TS, "updated_at": _TS},
    {"url_canonical": _S, "title": _S, "author": _S, "language": _S, "published_at": _TS, "word_count": _I, "current_extraction_id": _S},
)
EXTRACTIONS = _table({"id": _S, "document_id": _S, "fetcher": _S, "status": _S, "fetched_at": _TS}, {"markdown": _S, "raw_path": _S, "extraction_meta": _S, "error_message": _S})
CHUNKS = _table({"chunk_id": _S, "document_id": _S, "ord": _I, "text": _S}, {"extraction_id": _S, "token_count": _I})
CHUNK_VECTORS = _table({"chunk_id": _S, "document_id": _S, "ord": _I, "embedding": T.ArrayType(T.FloatType())})
CHUNK_LENGTHS = _table({"chunk_id": _S, "document_id": _S, "length": _I})
#: Signed sums: what each change added and took away.
INDEX_STATISTICS = _table({"chunks": _L, "tokens": _L})
TERM_STATISTICS = _table({"term": _S, "chunks": _L})
POSTINGS = _table({"term": _S, "chunk_id": _S, "length": _I, "tf": _I, "positions": T.ArrayType(_I), "document_id": _S})
BOOKMARKS = _table(
    {"id": _S, "tenant_id": _S, "url": _S, "source": _S, "saved_at": _TS, "created_at": _TS, "updated_at": _TS},
    {"document_id": _S, "title": _S, "folder_path": _S, "tags": T.ArrayType(_S)},
)
JOBS = _table(
    {"id": _S, "tenant_id": _S, "kind": _S, "payload": _S, "status": _S, "attempts": _I, "run_after": _TS, "created_at": _TS, "updated_at": _TS},
    {"last_error": _S, "started_at": _TS},
)
CLUSTER_RUNS = _table(
    {"id": _S, "tenant_id": _S, "status": _S, "algo": _S, "num_documents": _I, "num_clusters": _I, "num_noise": _I, "started_at": _TS, "created_at": _TS, "updated_at": _TS},
    {"params": _S, "error": _S, "finished_at": _TS},
)
CLUSTERS = _table({"id": _S, "tenant_id": _S, "run_id": _S, "size": _I, "cohesion": _D}, {"label": _S, "summary": _S})
CLUSTER_DOCUMENTS = _table({"cluster_id": _S, "document_id": _S, "similarity": _D})
PARSED_BOOKMARK = _table({"url": _S}, {"title": _S, "folder_path": _S, "tags": T.ArrayType(_S), "saved_at": _TS})

#: Tables by their names in a store.
STORED = {
    "documents": DOCUMENTS, "document_extractions": EXTRACTIONS, "chunks": CHUNKS, "chunk_vectors": CHUNK_VECTORS, "chunk_lengths": CHUNK_LENGTHS, "postings": POSTINGS, "index_statistics": INDEX_STATISTICS, "term_statistics": TERM_STATISTICS, "bookmarks": BOOKMARKS, "jobs": JOBS,
    "cluster_runs": CLUSTER_RUNS, "clusters": CLUSTERS, "cluster_documents": CLUSTER_DOCUMENTS,
}

CONTENT_TYPES = ("article", "repo", "video", "pdf", "thread", "unknown")
DOC_STATES = ("pending", "fetched", "failed", "dead")
SOURCES = ("chrome", "safari", "firefox", "manual", "html")
JOB_KINDS = ("fetch", "index", "import", "cluster", "summarize")
JOB_STATUSES = ("pending", "running", "done", "failed")
