"""What jobs do, by their kind: fetch, index and cluster. Each handler takes claimed jobs and says of each (id, ok, retry, error)."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import jobs as rules
from ..streaming.queue import Handler
from . import imports

if TYPE_CHECKING:
    from ..engine import Engine

#: Fetches pages (document_id, url, fetcher): returns (document_id, ok, retry, error, markdown) and, where they are known, title, author,
#: language, content_type, published_at, final_url and meta. An error that says `dead link` means that the page is gone.
Fetch = Callable[[DataFrame], DataFrame]

_SAID = "id string, ok boolean, retry boolean, error string"


def said(jobs: DataFrame, ok: Column, retry: Column, error: Column) -> DataFrame:
    return jobs.select("id", ok.alias("ok"), retry.alias("retry"), error.cast("string").alias("error"))


def by_kind(handlers: dict[str, Handler]) -> Handler:
    """One handler of all kinds; a kind without one is not spoken of. The kinds of claimed jobs, a few, come to the driver."""

    def handle(claimed: DataFrame) -> DataFrame:
        out = claimed.sparkSession.createDataFrame([], _SAID)
        for kind in sorted(r["kind"] for r in claimed.select("kind").distinct().collect()):
            if kind in handlers:
                out = out.unionByName(handlers[kind](claimed.where(F.col("kind") == kind)))
        return out

    return handle


def with_documents(engine: Engine, claimed: DataFrame) -> DataFrame:
    """claimed (id) with document_id, found, url and current_extraction_id of the document that the payload names."""
    docs = engine.tables.read("documents").where(F.col("tenant_id") == engine.settings.tenant_id)
    docs = docs.select(F.col("id").alias("document_id"), F.lit(True).alias("found"), "url", "current_extraction_id")
    return claimed.select("id", rules.document_of(F.col("payload")).alias("document_id")).join(docs, "document_id", "left")


def fetch_handler(engine: Engine, fetch: Fetch, dispatch: DataFrame | Callable[[], DataFrame] | None, now: Column) -> Handler:
    """Fetches the documents of jobs, each once, stores the extractions and enqueues their index. dispatch: rules, or a function that
    reads them anew for each batch of jobs."""

    def handle(claimed: DataFrame) -> DataFrame:
        todo = engine.tables.scratch(with_documents(engine, claimed))
        pages = todo.where("found").select("document_id", "url").distinct()
        table = dispatch() if callable(dispatch) else dispatch
        pages = imports.dispatched(pages, table) if table is not None else pages.withColumn("fetcher", F.lit("native"))
        got = engine.tables.scratch(fetch(pages.where("fetcher is not null")))
        named = got if "fetcher" in got.columns else got.join(pages.select("document_id", "fetcher"), "document_id", "left")
        new = engine.add_extractions(named.where("ok"), now)
        engine.enqueue("index", new.select("document_id"), now)
        answers = got.select("document_id", "ok", "retry", "error")
        both = todo.join(answers, "document_id", "left")
        error = (
            F.when(F.col("document_id").isNull(), "document_id required")
            .when(F.col("found").isNull(), F.concat(F.lit("no document "), F.col("document_id")))
            .when(F.col("ok").isNull(), F.concat(F.lit("no fetcher for "), F.col("url")))
            .otherwise(F.col("error"))
        )
        out = engine.tables.scratch(said(both, F.coalesce("ok", F.lit(False)), F.coalesce("retry", F.lit(False)), error))
        engine.tables.drop(todo, got)
        return out

    return handle


def index_handler(engine: Engine, now: Column) -> Handler:
    """Indexes the current extractions of documents."""

    def handle(claimed: DataFrame) -> DataFrame:
        texts = engine.tables.read("document_extractions").select(F.col("id").alias("current_extraction_id"), "markdown")
        todo = engine.tables.scratch(with_documents(engine, claimed).join(texts, "current_extraction_id", "left"))
        engine.index_documents(todo.where("markdown is not null").select("document_id", "markdown").dropDuplicates(["document_id"]), now)
        error = (
            F.when(F.col("document_id").isNull(), "document_id required")
            .when(F.col("found").isNull(), F.concat(F.lit("no document "), F.col("document_id")))
            .when(F.col("markdown").isNull(), F.concat(F.lit("no extraction of "), F.col("document_id")))
        )
        out = engine.tables.scratch(said(todo, F.col("markdown").isNotNull(), F.lit(False), error))
        engine.tables.drop(todo)
        return out

    return handle


def cluster_handler(engine: Engine, now: Column) -> Handler:
    """Rebuilds the topics once for all jobs that ask for it."""

    def handle(claimed: DataFrame) -> DataFrame:
        try:
            engine.rebuild_interests(now)
        except Exception as e:  # the run is stored as failed; the job may be tried again
            return said(claimed, F.lit(False), F.lit(True), F.lit(str(e)[:500]))
        return said(claimed, F.lit(True), F.lit(False), F.lit(None))

    return handle


def handlers(engine: Engine, fetch: Fetch | None, dispatch: DataFrame | Callable[[], DataFrame] | None, now: Column) -> Handler:
    own = {"index": index_handler(engine, now), "cluster": cluster_handler(engine, now)}
    if fetch is not None:
        own["fetch"] = fetch_handler(engine, fetch, dispatch, now)
    return by_kind(own)


def mark_failed(engine: Engine, jobs: DataFrame, now: Column) -> None:
    """Documents whose fetch or index failed for good are failed, or dead if their page is gone."""
    docs = jobs.where(F.col("kind").isin("fetch", "index")).select(rules.document_of(F.col("payload")).alias("id"), rules.document_state(F.coalesce("last_error", F.lit(""))).alias("state"))
    engine._set_states(docs.where("id is not null").groupBy("id").agg(F.min("state").alias("state")), now)
