"""The job queue as a stream: arriving jobs, handled in micro-batches, with retries that survive a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs as rules
from ..operators.catalog import Tables

#: Handles claimed jobs: jobs to (id, ok boolean, retry boolean, error string).
Handler = Callable[[DataFrame], DataFrame]


def drain(tables: Tables, arrived: DataFrame | None, handler: Handler, now: Column, kinds: tuple[str, ...] = (), n: int | None = None, max_attempts: int = 5, on_failed: Callable[[DataFrame], None] | None = None) -> int:
    """Adds arrived jobs, then claims, handles and ends those that may run, n at a time or else all that are due at once, until none is left; returns
    how many were handled. Rounds have a fixed cost, so with a fixed n they would take a time that grows with the queue however many machines there are.

    Each step is written before the next one reads it: a claim (jobs are running from then on, and stay so if the handler is
    lost), what the handler says of it, and what becomes of its jobs. So a handler sees a claimed job once. Jobs that arrive again (a
    micro-batch that is repeated after a failure) are known by their id and not added twice. A claimed job that the handler says
    nothing about fails for good. on_failed: is given jobs that did.
    """
    if arrived is not None:
        known = tables.read("jobs")
        tables.append("jobs", arrived.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti").select(*known.columns))
    handled = 0
    while True:
        claimed = tables.merge("jobs", rules.claim(tables.read("jobs"), now, n, kinds), "id")
        some = claimed.count()
        if not some:
            return handled
        handled += some
        # a job that the handler speaks of twice has failed if any of it has
        said = handler(claimed).groupBy("id").agg(F.min("ok").alias("ok"), F.min("retry").alias("retry"), F.min("error").alias("error"))
        done = tables.scratch(claimed.join(said, "id", "left"))
        good = rules.after_success(done.where("ok"), now)
        bad = rules.after_failure(done.where("not coalesce(ok, false)"), now, F.coalesce("error", F.lit("no handler")), F.coalesce("retry", F.lit(False)), max_attempts)
        ended = tables.merge("jobs", good.unionByName(bad).select(*claimed.columns), "id")
        if on_failed is not None:
            on_failed(ended.where("status = 'failed'"))
        tables.drop(done)


def reset_orphans(tables: Tables, now: Column) -> None:
    """Jobs that were running when the last run ended are pending again."""
    tables.merge("jobs", rules.orphans_reset(tables.read("jobs").where("status = 'running'"), now), "id")


def with_ticks(stream: DataFrame) -> DataFrame:
    """The stream, with a micro-batch each second even if nothing arrives, so that retries run when they are due."""
    ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    return stream.unionByName(ticks.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema)))


def run(stream: DataFrame, tables: Tables, handler: Handler, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, available_now: bool = True, **how) -> StreamingQuery:
    """Starts the queue over a stream of jobs; each micro-batch drains it. Jobs that were running when the last run ended are pending
    again first, and what is due is handled before anything arrives."""
    reset_orphans(tables, now())
    drain(tables, None, handler, now(), **how)
    source = stream if available_now else with_ticks(stream)
    writer = source.writeStream.foreachBatch(lambda batch, _: drain(tables, batch, handler, now(), **how)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()


def rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour", time_col: str = "ts", kind_col: str = "kind") -> DataFrame:
    """(window_start, kind, n): ended jobs by kind and time window, for batches and streams alike. In a stream, windows that are over by more
    than `late` are final, and their state is dropped."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), kind_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind_col, "n")
