"""The table of jobs: metrics, listings, claims, failures and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times


def metrics(jobs: DataFrame, now: Column, window_seconds: int = 3600, tenant: str = "local") -> DataFrame:
    """(kind, total, failed, mean_ms, p50_ms, p95_ms, p99_ms, running, oldest_running_s) of each kind of job.

    Jobs that ended within the window count; durations are those of done ones. A percentile is the smallest duration whose
    percent rank reaches it, 0 where none does: a single job has rank 0. Running jobs count whenever they began.
    """
    own = jobs.where(F.col("tenant_id") == tenant)
    ended = own.where(F.col("status").isin("done", "failed") & (F.col("updated_at") > now - F.make_dt_interval(secs=F.lit(window_seconds))) & F.col("started_at").isNotNull())
    ms = times.millis_between(F.col("started_at"), F.col("updated_at"))
    done = F.col("status") == "done"
    # Jobs are counted by duration first, so ranks go over the distinct durations of a kind: a percent rank is the share of the others
    # of its kind and state that took less.
    counted = ended.groupBy("kind", done.alias("done"), ms.alias("ms")).agg(F.count("*").alias("n"))
    own = W.partitionBy("kind", "done")
    less = F.coalesce(F.sum("n").over(own.orderBy("ms").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum("n").over(own)
    timed = counted.withColumn("pct", F.when(all_ > 1, less / (all_ - 1)).otherwise(0.0))
    at = lambda p: F.coalesce(F.min(F.when(F.col("done") & (F.col("pct") >= p), F.col("ms"))), F.lit(0.0))
    by_kind = timed.groupBy("kind").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("done"), 0).otherwise(F.col("n"))).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("done"), F.col("ms") * F.col("n"))) / F.sum(F.when(F.col("done"), F.col("n"))), F.lit(0.0)).alias("mean_ms"),
        at(0.50).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        at(0.99).alias("p99_ms"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "failed")] + [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")]
    return by_kind.join(in_flight(jobs, now, tenant), "kind", "full").select("kind", *zero, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("running", "oldest_running_s")))


def in_flight(jobs: DataFrame, now: Column, tenant: str = "local") -> DataFrame:
    """(kind, running, oldest_running_s): running jobs, and the whole seconds since the oldest of them began."""
    since = F.coalesce("started_at", "updated_at")
    age = F.floor((F.unix_micros(now) - F.unix_micros(F.min(since))) / 1_000_000)
    return jobs.where((F.col("tenant_id") == tenant) & (F.col("status") == "running")).groupBy("kind").agg(F.count("*").alias("running"), F.coalesce(age, F.lit(0)).cast("long").alias("oldest_running_s"))


def count_by(rows: DataFrame, column: str, tenant: str = "local") -> DataFrame:
    return rows.where(F.col("tenant_id") == tenant).groupBy(column).agg(F.count("*").alias("n"))


def document_of(payload: Column) -> Column:
    return F.get_json_object(payload, "$.document_id")


def newest(rows: DataFrame, limit: int = 50, tenant: str = "local", order: str = "created_at", **equal) -> DataFrame:
    """The newest rows by a time, then by id; equal: columns and the values they must have ("" and None: any)."""
    own = rows.where(F.col("tenant_id") == tenant)
    for column, value in equal.items():
        if value not in ("", None):
            own = own.where(F.col(column) == value)
    return own.orderBy(F.desc(order), "id").limit(limit if 0 < limit <= 500 else 50)


def with_documents(jobs: DataFrame, documents: DataFrame, extractions: DataFrame, limit: int = 50, **equal) -> DataFrame:
    """The newest jobs by their last change, with url and title of their document and the fetcher of its current extraction."""
    best = newest(jobs, limit, order="updated_at", **equal).withColumn("document_id", document_of(F.col("payload")))
    docs = documents.select(F.col("id").alias("document_id"), "url", "title", "current_extraction_id")
    runs = extractions.select(F.col("id").alias("current_extraction_id"), "fetcher")
    return best.join(docs, "document_id", "left").join(runs, "current_extraction_id", "left")


def latest_failures(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """documents with last_error and failed_at of their latest failed job; null where there is none."""
    failed = jobs.where("status = 'failed'").select(document_of(F.col("payload")).alias("id"), F.struct("updated_at", F.col("id").alias("job")).alias("at"), "last_error")
    latest = failed.groupBy("id").agg(F.max_by("last_error", "at").alias("last_error"), F.max("at.updated_at").alias("failed_at"))
    return documents.join(latest, "id", "left")


def runnable(now: Column, kinds: tuple[str, ...] = ()) -> Column:
    out = (F.col("status") == "pending") & (F.col("run_after") <= now)
    return out & F.col("kind").isin(*kinds) if kinds else out


def claim(jobs: DataFrame, now: Column, n: int | None = 1, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The n oldest jobs that may run, or all of them if n is None, as they are once claimed."""
    due = jobs.where(runnable(now, kinds))
    best = due if n is None else due.orderBy("created_at", "id").limit(n)
    return best.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "started_at": now, "updated_at": now})


def after_failure(jobs: DataFrame, now: Column, error: Column, retry: Column, max_attempts: int = times.MAX_ATTEMPTS) -> DataFrame:
    """Claimed jobs as they are once they failed: pending again after a delay that doubles, or failed for good."""
    again = retry & (F.col("attempts") < max_attempts)
    delay = F.make_dt_interval(secs=times.retry_delay(F.col("attempts")))
    return jobs.withColumns({
        "status": F.when(again, "pending").otherwise("failed"), "last_error": error, "updated_at": now, "run_after": F.when(again, now + delay).otherwise(F.col("run_after")),
    })


def after_success(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.withColumns({"status": F.lit("done"), "updated_at": now})


def document_state(error: Column) -> Column:
    """The state of a document whose fetch failed for good."""
    return F.when(error.contains("dead link"), "dead").otherwise("failed")


def orphans_reset(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs at a start: those that were running when the last run ended are pending."""
    lost = F.col("status") == "running"
    return jobs.withColumns({"status": F.when(lost, "pending").otherwise(F.col("status")), "updated_at": F.when(lost, now).otherwise(F.col("updated_at"))})


def pruned(jobs: DataFrame, status: str | None = None, before: Column | None = None, tenant: str = "local") -> tuple[DataFrame, DataFrame]:
    """(jobs that stay, jobs that go): those of a status, or those last changed before a time; exactly one is given."""
    if (status is None) == (before is None):
        raise ValueError("give a status or a time, not both")
    gone = (F.col("tenant_id") == tenant) & (F.col("status") == status if status is not None else F.col("updated_at") < before)
    return jobs.where(~gone), jobs.where(gone)


def page(rows: DataFrame, cursor=None, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows after a cursor by id, and next_cursor: the last id, if a limit was given and the page is full."""
    n = limit if limit and 0 < limit <= 500 else 50
    got = (rows if cursor is None else rows.where(F.col(id_col) > cursor)).orderBy(id_col).limit(n)
    whole = W.partitionBy()
    last = F.when((F.count("*").over(whole) == n) & F.lit(limit is not None), F.max(id_col).over(whole))
    return got.withColumn("next_cursor", last)


def live_hosts(failures: DataFrame, now: Column, ttl_seconds: int = 900) -> DataFrame:
    """(host, kind): the latest failure of each host within the time that failures are remembered."""
    fresh = failures.where(F.col("seen_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return fresh.groupBy("host").agg(F.max_by("kind", F.struct("seen_at", "kind")).alias("kind"))


def to_refetch(documents: DataFrame, state: str | None = None, force: bool = False) -> DataFrame:
    """Documents of a state; without one, all but dead ones, which force brings back."""
    return documents.where(F.col("state") == state) if state else documents if force else documents.where("state in ('pending', 'fetched', 'failed')")


def to_reindex(documents: DataFrame, state: str = "fetched") -> DataFrame:
    """Documents of a state that have an extraction."""
    return documents.where((F.col("state") == state) & F.col("current_extraction_id").isNotNull())


def new_jobs(targets: DataFrame, kind: str, now: Column, tenant: str = "local") -> DataFrame:
    """Pending jobs for documents (document_id); ids depend on kind, document and time alone."""
    payload = F.to_json(F.struct("document_id"))
    return targets.select(
        F.sha2(F.concat_ws("|", F.lit(tenant), F.lit(kind), "document_id", now.cast("string")), 256).alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(kind).alias("kind"), payload.alias("payload"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), now.alias("run_after"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("started_at"),
    )
