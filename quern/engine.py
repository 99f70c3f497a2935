"""The engine: one object with a method for each operation over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQuery

from .operators import catalog, chunking, clustering, evaluation, jobs, lexical, search
from .plans import imports, interests, worker
from .sources.config import Settings
from .streaming import queue


class Conflict(ValueError):
    """What was asked for can't be done to a thing in its present state."""


class Engine:
    """All operations over a folder of tables, which may be empty at first.

    embed: a function from a text column to a vector column. generate: a function from a column of prompts to a column of a language model's
    answers. clusterer: a function from (id, embedding) points and the settings to (id, label).
    """

    def __init__(
        self, spark: SparkSession, root: str, settings: Settings | None = None, embed: Callable[[Column], Column] | None = None, generate: Callable[[Column], Column] | None = None,
        labeler: Callable[[DataFrame], DataFrame] | None = None, clusterer: interests.Clusterer | None = None,
    ) -> None:
        self.spark, self.settings, self.embed, self.clusterer = spark, settings or Settings(), embed, clusterer
        self.labeler = labeler or (None if generate is None else lambda titles: clustering.generated_labels(titles, generate))
        self.settings.validate()
        self.tables = catalog.Tables(spark, root)

    def _own(self, name: str) -> DataFrame:
        return self.tables.read(name).where(F.col("tenant_id") == self.settings.tenant_id)

    # --- bookmarks and documents

    def import_bookmarks(self, incoming: DataFrame, source: str, now: Column | None = None) -> DataFrame:
        """Adds bookmarks, and returns the counts."""
        now = F.current_timestamp() if now is None else now
        got = imports.import_bookmarks(incoming, self.tables.read("documents"), self.tables.read("bookmarks"), source, now, self.settings.tenant_id)
        counts = self.spark.createDataFrame(got.counts.collect(), got.counts.schema)  # one row, before the tables change
        for name, rows in (("jobs", got.jobs), ("bookmarks", got.bookmarks), ("documents", got.documents)):
            self.tables.append(name, self._shaped(rows, self.tables.read(name)))
        return counts

    @staticmethod
    def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))

    def add_bookmark(self, url: str, title: str = "", tags: list[str] | None = None, now: Column | None = None) -> DataFrame:
        row = [(0, url, title, "", tags or [], None)]
        return self.import_bookmarks(self.spark.createDataFrame(row, "place long, url string, title string, folder_path string, tags array<string>, saved_at timestamp"), "manual", now)

    def documents(self, state: str = "", limit: int = 50) -> DataFrame:
        return jobs.newest(self.tables.read("documents"), limit, self.settings.tenant_id, "updated_at", state=state)

    def bookmark(self, bookmark_id: str) -> DataFrame:
        return self._one(self._own("bookmarks").where(F.col("id") == bookmark_id), bookmark_id)

    def extractions(self, document_id: str) -> DataFrame:
        """All extractions of a document, the newest first."""
        return self.tables.read("document_extractions").where(F.col("document_id") == document_id).orderBy(F.desc("fetched_at"), "id")

    def chunks(self, chunk_ids: list[str]) -> DataFrame:
        """Chunks by their ids, in any order; none for no ids, an error if none of them is there."""
        found = self.tables.read("chunks").where(F.col("chunk_id").isin(*chunk_ids))
        return self._one(found, ", ".join(chunk_ids)) if chunk_ids else found

    def link_bookmark(self, bookmark_id: str, document_id: str) -> None:
        """Points a bookmark at a document; both must be there."""
        row = self.bookmark(bookmark_id)
        self._one(self._own("documents").where(F.col("id") == document_id), document_id)
        self.tables.merge("bookmarks", row.withColumn("document_id", F.lit(document_id)), "id")

    def set_state(self, document_id: str, state: str, now: Column | None = None) -> None:
        row = self._one(self._own("documents").where(F.col("id") == document_id), document_id)
        self._set_states(row.select("id", F.lit(state).alias("state")), now)

    def set_current_extraction(self, document_id: str, extraction_id: str, now: Column | None = None) -> None:
        """Points a document at one of the stored extractions."""
        row = self._one(self._own("documents").where(F.col("id") == document_id), document_id)
        self._one(self.tables.read("document_extractions").where(F.col("id") == extraction_id), extraction_id)
        at = F.current_timestamp() if now is None else now
        self.tables.merge("documents", row.withColumn("current_extraction_id", F.lit(extraction_id)).withColumn("updated_at", at), "id")

    def document(self, document_id: str) -> DataFrame:
        """The document with its current extraction."""
        runs = self.tables.read("document_extractions").select(F.col("id").alias("current_extraction_id"), "fetcher", "markdown", "extraction_meta")
        return self._one(self._own("documents").where(F.col("id") == document_id), document_id).join(runs, "current_extraction_id", "left")

    @staticmethod
    def _one(rows: DataFrame, what: str) -> DataFrame:
        if rows.isEmpty():
            raise KeyError(what)
        return rows

    def bookmarks(self, source: str = "", folder_prefix: str = "", cursor: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self._own("bookmarks")
        rows = rows.where(F.col("source") == source) if source else rows
        return jobs.page(rows.where(F.col("folder_path").startswith(folder_prefix)) if folder_prefix else rows, cursor, limit)

    def delete_bookmark(self, bookmark_id: str) -> None:
        row = self.bookmark(bookmark_id)
        self.tables.merge("bookmarks", row.limit(0), "id", row.select("id"))

    # --- extractions, index and search

    def _set_states(self, states: DataFrame, now: Column | None = None, columns: tuple[str, ...] = ()) -> None:
        """Sets state, and other columns, of documents (id, state, ...)."""
        at = F.current_timestamp() if now is None else now
        docs = self.tables.read("documents")
        new = states.withColumn("updated_at", at)
        changed = docs.join(states.select("id"), "id", "left_semi")
        self.tables.merge("documents", catalog.set_values(changed, new, "id", ["state", "updated_at", *columns]).select(*docs.columns), "id")

    def add_extractions(self, rows: DataFrame, now: Column | None = None) -> DataFrame:
        """Stores extractions of documents (document_id, markdown; fetcher, title, author, language, content_type, published_at, final_url, meta where they
        are known), one for each document, and returns them with their ids.

        A document's earlier extractions stay. It points at the new one and takes its title and so on where these are given; it is pending until it
        is indexed. An extraction of an unknown document is left out.
        """
        at = F.current_timestamp() if now is None else now
        docs = self.tables.read("documents")
        have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        known = rows.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        new = self.tables.scratch(known.select(
            catalog.stable_id(F.lit("extraction"), F.col("document_id"), at.cast("string")).alias("id"), "document_id", F.coalesce(have("fetcher"), F.lit("manual")).alias("fetcher"), F.lit("ok").alias("status"), at.alias("fetched_at"),
            "markdown", have("meta").alias("extraction_meta"), *(have(c).alias(c) for c in ("title", "author", "language", "content_type", "final_url")), have("published_at").cast("timestamp").alias("published_at"),
        ))
        written = self.tables.append("document_extractions", self._shaped(new, self.tables.read("document_extractions")))
        filled = lambda c: F.coalesce(F.when(F.col(f"n.{c}") != "", F.col(f"n.{c}")), F.col(f"d.{c}"))
        words = F.when(F.col("n.markdown").isNotNull(), F.size(F.filter(F.split("n.markdown", r"\s+"), lambda w: w != ""))).cast("int")
        values = {
            "content_type": filled("content_type"), "title": filled("title"), "author": filled("author"), "language": filled("language"), "published_at": F.coalesce("n.published_at", "d.published_at"),
            "url_canonical": F.coalesce(F.when((F.col("n.final_url") != "") & (F.col("n.final_url") != F.col("d.url")), F.col("n.final_url")), F.col("d.url_canonical")),
            "current_extraction_id": F.col("n.id"), "state": F.lit("pending"), "updated_at": at, "word_count": words,
        }
        both = docs.alias("d").join(new.alias("n"), F.col("d.id") == F.col("n.document_id"))
        self.tables.merge("documents", both.select(*((values[c] if c in values else F.col(f"d.{c}")).alias(c) for c in docs.columns)), "id")
        self.tables.drop(new)
        return written

    def index(self, extractions: DataFrame, now: Column | None = None) -> None:
        """Stores extractions, as add_extractions does, and indexes their documents."""
        self.index_documents(self.add_extractions(extractions, now).select("document_id", "markdown"), now)

    def index_documents(self, extractions: DataFrame, now: Column | None = None) -> None:
        """Chunks, embeds and indexes documents (document_id, markdown), replacing what they had, and marks them fetched.

        The lexical index covers a chunk's text, its document's title and the tags of the document's bookmarks. Texts are cut once and tokenised once.
        """
        s = self.settings.chunking
        new = chunking.chunk_documents(extractions, "document_id", "markdown", chunking.Sizes(s.size_tokens, s.overlap_tokens, s.size_chars))
        docs = self.tables.read("documents").select(F.col("id").alias("document_id"), "title", F.col("current_extraction_id").alias("extraction_id"))
        keys = extractions.select("document_id")
        shaped = lambda name, rows: self._shaped(rows, self.tables.read(name))
        chunks = self.tables.merge("chunks", shaped("chunks", new.join(docs.select("document_id", "extraction_id"), "document_id", "left")), "document_id", keys)
        vectors = imports.embedded(chunks.withColumn("embed_text", F.concat(F.lit(s.document_prefix), F.col("text"))), self.embed)
        self.tables.merge("chunk_vectors", shaped("chunk_vectors", catalog.checked_vectors(vectors, self.settings.embedding_dim)), "document_id", keys)
        marks = self.tables.read("bookmarks").join(keys.distinct(), "document_id", "left_semi")
        tags = catalog.tag_union(marks.withColumn("tags", F.to_json("tags"))).select("document_id", F.to_json("tags").alias("tags"))
        wide = chunks.join(docs.select("document_id", "title"), "document_id", "left").join(tags, "document_id", "left")
        terms = self.tables.scratch(lexical.index(wide, columns=("text", "title", "tags"), keep=("document_id",)))
        posted = self.tables.scratch(shaped("postings", lexical.inverted(terms, keep=("document_id",))))
        # what is added and what goes, before it goes
        old = self.tables.read("chunk_lengths").join(keys, "document_id", "left_semi")
        sums, counts = lexical.changes(terms, 1).unionByName(lexical.changes(old, -1)), lexical.term_changes(posted, 1)
        if not old.isEmpty():
            counts = counts.unionByName(lexical.term_changes(self.tables.read("postings").join(keys, "document_id", "left_semi"), -1))
        self.tables.append("index_statistics", shaped("index_statistics", sums))
        self.tables.merge("term_statistics", shaped("term_statistics", counts.groupBy("term").agg(F.sum("chunks").alias("chunks")).where("chunks <> 0")), order=("term",))
        self.tables.merge("chunk_lengths", shaped("chunk_lengths", terms), "document_id", keys)
        self.tables.merge("postings", posted, "document_id", keys, order=("term", "chunk_id"))
        self.tables.drop(terms, posted)
        self._set_states(keys.distinct().select(F.col("document_id").alias("id"), F.lit("fetched").alias("state")), now)

    def search(self, query: str, k: int = 10, filters: search.Filters = search.Filters()) -> DataFrame:
        if not query:
            raise ValueError("a query is needed")
        s = self.settings.search
        docs = search.matching(self._own("documents").withColumnRenamed("id", "document_id"), filters, self.tables.read("bookmarks"))
        stats, frequencies = lexical.summed_statistics(self.tables.read("index_statistics")), self.tables.read("term_statistics")
        bm25 = search.index_search(self.tables.read("postings"), self.tables.read("chunk_lengths"), self.tables.read("chunks"), docs, query, s.pre_fanout, stats, frequencies)
        asked = self.spark.createDataFrame([(s.query_prefix + query,)], "text string").select(self.embed(F.col("text")).alias("v"))
        near = search.vector_leg(self.tables.read("chunk_vectors"), docs, asked, s.pre_fanout)
        hits = search.hybrid(bm25, near, k if k > 0 else 10, (s.bm25_weight, s.vector_weight), s.rrf_k, s.collapse)
        return search.hydrate(hits, docs).orderBy("rank")

    def related(self, document_id: str, k: int = 10) -> DataFrame:
        docs = self._own("documents").withColumnRenamed("id", "document_id")
        self._one(docs.where(F.col("document_id") == document_id), document_id)
        hits = search.related(self.tables.read("chunk_vectors"), docs, document_id, k if k > 0 else 10, self.settings.search.collapse)
        return search.hydrate(hits, docs).orderBy("rank")

    def search_queries(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, document_id, score, rank, chunks) of hybrid search for each of queries (query_id, text), in one plan."""
        s = self.settings.search
        asked = queries.select("query_id", "text", self.embed(F.concat(F.lit(s.query_prefix), F.col("text"))).alias("embedding"))
        docs = self._own("documents").select(F.col("id").alias("document_id"))
        stats = lexical.summed_statistics(self.tables.read("index_statistics"))
        return search.hybrid_queries(self.tables.read("postings"), stats, self.tables.read("chunk_vectors"), asked, k if k > 0 else 10, s.pre_fanout, docs, (s.bm25_weight, s.vector_weight), s.rrf_k, s.collapse, stemmed=True)

    def evaluate_queries(self, queries: DataFrame, judged: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Searches for queries (query_id, text) and measures the results against judged (query_id, id); the measures of each query, and their means."""
        found = self.tables.scratch(self.search_queries(queries, k).select("query_id", "rank", F.col("document_id").alias("id")))
        return self.evaluate(found, judged, k)

    def evaluate(self, rankings: DataFrame, judged: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        per = evaluation.per_query(rankings, judged, k)
        return per, evaluation.means(per)

    # --- topics, jobs

    def rebuild_interests(self, now: Column | None = None) -> str:
        return interests.rebuild(self.tables, F.current_timestamp() if now is None else now, self.settings.clustering, self.labeler, self.settings.tenant_id, self.clusterer)

    def interest(self, cluster_id: str, members: int = 50) -> DataFrame:
        """One topic of the last done run with its most central members."""
        found = self._one(self._topics().where(F.col("id") == cluster_id), cluster_id)
        return interests.interests(found, self.tables.read("cluster_documents").where(F.col("cluster_id") == cluster_id), self.tables.read("documents"), 1, members)

    def _topics(self) -> DataFrame:
        """Topics of the last done run: rows of one that is on its way, or has failed, are not among them."""
        done = catalog.latest_run(self.tables.read("cluster_runs"), True, self.settings.tenant_id).select(F.col("id").alias("run_id"))
        return self._own("clusters").join(F.broadcast(done), "run_id", "left_semi")  # one row

    def interests(self, limit: int = 50, members: int = 5) -> DataFrame:
        return interests.interests(self._topics(), self.tables.read("cluster_documents"), self.tables.read("documents"), limit, members)

    def jobs(self, kind: str = "", status: str = "", limit: int = 50) -> DataFrame:
        return jobs.with_documents(self.tables.read("jobs"), self.tables.read("documents"), self.tables.read("document_extractions"), limit, kind=kind, status=status)

    def job_metrics(self, window_seconds: int = 3600, now: Column | None = None) -> DataFrame:
        window_seconds = window_seconds if 1 <= window_seconds <= 86_400 else 3600
        return jobs.metrics(self.tables.read("jobs"), F.current_timestamp() if now is None else now, window_seconds, self.settings.tenant_id)

    def prune_jobs(self, status: str | None = None, before: Column | None = None) -> int:
        _, gone = jobs.pruned(self.tables.read("jobs"), status, before, self.settings.tenant_id)
        ids = self.tables.scratch(gone.select("id"))
        n = ids.count()
        self.tables.merge("jobs", self.tables.read("jobs").limit(0), "id", ids)
        self.tables.drop(ids)
        return n

    def enqueue(self, kind: str, documents: DataFrame, now: Column | None = None) -> DataFrame:
        """Adds a job for each document (document_id), and returns the jobs."""
        return self.tables.append("jobs", jobs.new_jobs(documents, kind, F.current_timestamp() if now is None else now, self.settings.tenant_id))

    def _enqueue_for(self, chosen: DataFrame, kind: str, now: Column | None) -> DataFrame:
        targets = self.tables.scratch(chosen.select(F.col("id").alias("document_id")))
        if kind == "fetch":
            self._set_states(targets.select(F.col("document_id").alias("id"), F.lit("pending").alias("state")), now)
        out = self.enqueue(kind, targets, now)
        self.tables.drop(targets)
        return out

    def refetch(self, document_id: str, force: bool = False, now: Column | None = None) -> str:
        """Enqueues a fetch of a document, which is pending again, and returns the job's id. A dead one needs force."""
        row = self._one(self._own("documents").where(F.col("id") == document_id), document_id)
        if row.first()["state"] == "dead" and not force:
            raise Conflict(f"{document_id} is dead")
        return self._enqueue_for(row, "fetch", now).first()["id"]

    def reindex(self, document_id: str, now: Column | None = None) -> str:
        """Enqueues the index of a document's current extraction, and returns the job's id."""
        row = self._one(self._own("documents").where(F.col("id") == document_id), document_id)
        if row.first()["current_extraction_id"] is None:
            raise Conflict(f"{document_id} has no extraction")
        return self._enqueue_for(row, "index", now).first()["id"]

    def refetch_all(self, state: str | None = None, force: bool = False, now: Column | None = None) -> int:
        """Enqueues fetches of all documents of a state, else of all but dead ones, which force brings back; returns how many."""
        return self._enqueue_for(jobs.to_refetch(self._own("documents"), state, force), "fetch", now).count()

    def reindex_all(self, state: str = "fetched", now: Column | None = None) -> int:
        return self._enqueue_for(jobs.to_reindex(self._own("documents"), state), "index", now).count()

    def work(self, fetch: worker.Fetch | None = None, rules: DataFrame | Callable[[], DataFrame] | None = None, now: Column | None = None, kinds: tuple[str, ...] = (), **how) -> int:
        """Runs jobs that are due until none is left, and returns how many were run. fetch: see worker.fetch_handler."""
        at = F.current_timestamp() if now is None else now
        return queue.drain(self.tables, None, worker.handlers(self, fetch, rules, at), at, kinds, on_failed=lambda rows: worker.mark_failed(self, rows, at), **how)

    def work_stream(self, arriving: DataFrame, checkpoint: str, fetch: worker.Fetch | None = None, rules: DataFrame | Callable[[], DataFrame] | None = None, **how) -> StreamingQuery:
        """Runs jobs as they arrive and as they are due."""
        at = F.current_timestamp()
        return queue.run(arriving, self.tables, worker.handlers(self, fetch, rules, at), checkpoint, on_failed=lambda rows: worker.mark_failed(self, rows, at), **how)

    def stats(self) -> DataFrame:
        """(what, key, n): documents by state, jobs by status, and bookmarks."""
        parts = [
            jobs.count_by(self.tables.read("documents"), "state", self.settings.tenant_id).select(F.lit("documents").alias("what"), F.col("state").alias("key"), "n"),
            jobs.count_by(self.tables.read("jobs"), "status", self.settings.tenant_id).select(F.lit("jobs").alias("what"), F.col("status").alias("key"), "n"),
            self._own("bookmarks").agg(F.count("*").alias("n")).select(F.lit("bookmarks").alias("what"), F.lit("all").alias("key"), "n"),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
