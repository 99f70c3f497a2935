import datetime as dt
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schemas
from quern.engine import Conflict, Engine
from quern.operators import catalog, clustering, jobs
from quern.plans import imports
from quern.sources.config import load_settings
from quern.streaming import queue

JOB = schemas.JOBS


def now():
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


def at(minute):
    return dt.datetime(2024, 5, 1, 11, minute, tzinfo=dt.timezone.utc).replace(tzinfo=None)


def job(i, kind="fetch", status="pending", attempts=0, run=0, created=0, updated=0, started=None, payload="{}", error=None):
    return {"id": i, "tenant_id": "local", "kind": kind, "payload": payload, "status": status, "attempts": attempts, "run_after": at(run), "created_at": at(created), "updated_at": at(updated), "last_error": error, "started_at": started}


def table(spark, rows, schema=JOB):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def test_metrics(spark):
    rows = [job(f"d{k}", status="done", updated=30 + k, started=at(30)) for k in range(1, 5)] + [job("f", status="failed", updated=40, started=at(30)), job("x", "index", "done", updated=40, started=at(39)), job("r", "cluster", "running", started=at(50)), job("n", "fetch", "done", updated=30)]
    got = {r["kind"]: r for r in jobs.metrics(table(spark, rows), now()).collect()}
    fetch = got["fetch"]
    assert (fetch["total"], fetch["failed"], fetch["mean_ms"], fetch["p50_ms"], fetch["p95_ms"]) == (5, 1, 150_000.0, 180_000.0, 240_000.0)
    assert (got["index"]["mean_ms"], got["index"]["p50_ms"]) == (60_000.0, 0.0)  # one job has percent rank 0
    assert (got["cluster"]["running"], got["cluster"]["oldest_running_s"], got["cluster"]["total"]) == (1, 600, 0)


def test_claim_retry_and_failure(spark):
    rows = [job("b", created=2), job("a", created=1), job("later", run=59, created=0), job("other", "index", created=0)]
    rows[2]["run_after"] = dt.datetime(2024, 5, 1, 13)
    claimed = jobs.claim(table(spark, rows), now(), 1, ("fetch",))
    assert [(r["id"], r["status"], r["attempts"]) for r in claimed.collect()] == [("a", "running", 1)]
    after = jobs.after_failure(claimed, now(), F.lit("boom"), F.lit(True), 2).first()
    assert after["status"] == "pending" and after["run_after"] == dt.datetime(2024, 5, 1, 12, 1)
    assert jobs.after_failure(claimed.withColumn("attempts", F.lit(2)), now(), F.lit("boom"), F.lit(True), 2).first()["status"] == "failed"
    assert jobs.after_failure(claimed, now(), F.lit("boom"), F.lit(False)).first()["status"] == "failed"
    assert jobs.orphans_reset(claimed, now()).first()["status"] == "pending"


def test_prune_and_page(spark):
    rows = table(spark, [job(f"j{k}", status="done" if k % 2 else "failed", updated=k) for k in range(6)])
    stay, gone = jobs.pruned(rows, status="failed")
    assert stay.count() == gone.count() == 3
    assert jobs.pruned(rows, before=F.lit("2024-05-01 11:02:00").cast("timestamp"))[1].count() == 2
    with pytest.raises(ValueError):
        jobs.pruned(rows)
    page = jobs.page(rows, "j1", 3).collect()
    assert [r["id"] for r in page] == ["j2", "j3", "j4"] and page[0]["next_cursor"] == "j4"
    assert jobs.page(rows, "j3", 3).first()["next_cursor"] is None and jobs.page(rows).first()["next_cursor"] is None


def test_latest_failures_and_documents(spark):
    p = '{"document_id": "d1"}'
    rows = table(spark, [job("1", status="failed", updated=1, payload=p, error="old"), job("2", status="failed", updated=2, payload=p, error="new"), job("3", status="done", updated=3, payload="no json")])
    docs = spark.createDataFrame([("d1", "u1", "t1", "x1"), ("d2", "u2", None, None)], "id string, url string, title string, current_extraction_id string")
    assert {r["id"]: r["last_error"] for r in jobs.latest_failures(docs, rows).collect()} == {"d1": "new", "d2": None}
    runs = spark.createDataFrame([("x1", "native")], "id string, fetcher string")
    assert {r["id"]: (r["url"], r["fetcher"]) for r in jobs.with_documents(rows, docs, runs).collect()} == {"1": ("u1", "native"), "2": ("u1", "native"), "3": (None, None)}


def test_upsert(spark):
    s = "id string, tenant_id string, url string, content_type string, state string, title string"
    old = spark.createDataFrame([("a", "local", "u1", "unknown", "pending", "T"), ("b", "local", "u2", "unknown", "pending", None)], s)
    new = spark.createDataFrame([("z", "local", "u1", "article", "fetched", None), ("c", "local", "u3", "pdf", "fetched", "N")], s)
    got = {r["url"]: tuple(r) for r in catalog.upsert_documents(old, new).collect()}
    assert got == {"u1": ("a", "local", "u1", "article", "fetched", "T"), "u2": ("b", "local", "u2", "unknown", "pending", None), "u3": ("c", "local", "u3", "pdf", "fetched", "N")}


def test_tags(spark):
    rows = spark.createDataFrame([(1, "d", '["go", " db "]'), (2, "d", '["db", "sql", ""]'), (3, "e", "oops")], "id int, document_id string, tags string")
    assert {r["document_id"]: r["tags"] for r in catalog.tag_union(rows).collect()} == {"d": ["go", "db", "sql"]}


def test_checks(spark):
    v = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert catalog.checked_vectors(v, 2).count() == 1
    with pytest.raises(Exception, match="length other than 3"):
        catalog.checked_vectors(v, 3).collect()
    docs = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "id string, current_extraction_id string")
    assert [r["id"] for r in catalog.dangling(docs, "current_extraction_id", spark.createDataFrame([("x",)], "id string")).collect()] == ["c"]


def test_tables_keep_the_last_version(spark, tmp_path):
    t = catalog.Tables(spark, str(tmp_path))
    assert not t.exists("x")
    for k in range(4):
        t.replace("x", spark.range(k))
    t.replace("x", t.read("x").unionByName(spark.range(10)))
    assert t.read("x").count() == 13 and len([p for p in (tmp_path / "x").iterdir() if p.name.startswith("v")]) == 2


def test_merges(spark, tmp_path):
    """Random changes by key, with few and many parts, against a dictionary."""
    rng = random.Random(1)
    for most in (3, 100):
        t, want = catalog.Tables(spark, str(tmp_path / str(most)), most), {}
        for step in range(9):
            rows = [(rng.randrange(12), step, n) for n in range(rng.randrange(0, 4))]
            cleared = rng.sample(range(12), rng.randrange(0, 3)) if step % 2 else None
            df = spark.createDataFrame(rows, "id long, step int, n int")
            keys = None if cleared is None else spark.createDataFrame([(k,) for k in cleared], "id long")
            written = t.merge("x", df, "id", keys)
            assert sorted(map(tuple, written.collect())) == sorted(rows)
            for k in {r[0] for r in rows} if cleared is None else cleared:
                want.pop(k, None)
            for r in rows:
                want.setdefault(r[0], []).append(r)
            assert sorted(map(tuple, t.read("x").collect())) == sorted(r for rs in want.values() for r in rs)
    with pytest.raises(ValueError, match="replaces rows by id"):
        t.merge("x", df, "step")


def test_appends_write_what_they_add(spark, tmp_path):
    t = catalog.Tables(spark, str(tmp_path))
    t.replace("x", spark.range(100_000))
    held = {p.name for p in (tmp_path / "x").iterdir()}
    t.append("x", spark.range(1))
    assert t.read("x").count() == 100_001 and {n for n in held if n.startswith("v")} <= {p.name for p in (tmp_path / "x").iterdir()}
    t.append("x", spark.range(0))  # nothing to add: no new part
    assert len([p for p in (tmp_path / "x").iterdir() if p.name.startswith("v")]) == 2


def test_tables_start_empty_and_survive_lost_writers(spark, tmp_path):
    t = catalog.Tables(spark, str(tmp_path))
    assert all(t.read(n).count() == 0 and not t.exists(n) for n in schemas.STORED)
    with pytest.raises(FileNotFoundError):
        t.read("unknown")
    t.replace("x", spark.range(3))
    (tmp_path / "x" / "_manifest-000000000002.json").write_text('{"parts": [')  # a writer that was lost while it named its change
    assert t.read("x").count() == 3
    real = t._manifests
    stale = real("x")
    (tmp_path / "x" / "_manifest-000000000002.json").unlink()
    t.append("x", spark.range(1))
    t._manifests = lambda name: stale
    with pytest.raises(catalog.ConcurrentWrite):
        t.append("x", spark.range(10))
    t._manifests = real
    assert t.read("x").count() == 4


def test_import(spark):
    incoming = spark.createDataFrame(
        [(0, "https://h/a?utm_source=x", "A", "/F", ["t"], None), (1, "https://H/a", "again", "", [], None), (2, "javascript:x", "", "", [], None), (3, "https://h/b", "", "", [], at(1)), (4, "https://h/c", "", "", [], None)],
        "place long, url string, title string, folder_path string, tags array<string>, saved_at timestamp",
    )
    docs = spark.createDataFrame([("d1", "local", "https://h/b", "fetched")], "id string, tenant_id string, url string, state string")
    marks = spark.createDataFrame([("local", "https://h/c", "html")], "tenant_id string, url string, source string")
    got = imports.import_bookmarks(incoming, docs, marks, "html", now())
    c = got.counts.first()
    assert (c["total"], c["filtered"], c["created"], c["skipped"], c["jobs_enqueued"], c["filtered_by"]) == (5, 1, 2, 2, 1, {"javascript": 1})
    rows = {r["url"]: r for r in got.bookmarks.collect()}
    assert rows["https://h/a"]["title"] == "A" and rows["https://h/b"]["tags"] is None and rows["https://h/b"]["saved_at"] == at(1)
    assert got.documents.count() == 2 and got.jobs.count() == 1
    with pytest.raises(ValueError):
        imports.import_bookmarks(incoming, docs, marks, "opera", now())


def handler(rows):
    return rows.select("id", (F.col("kind") == "fetch").alias("ok"), (F.col("kind") == "index").alias("retry"), F.lit("boom").alias("error"))


def test_queue_stream(spark, tmp_path):
    src, tables = str(tmp_path / "in"), catalog.Tables(spark, str(tmp_path / "t"))
    table(spark, [job("a"), job("b", "index"), job("c", "cluster")]).write.parquet(src)
    stream = lambda: spark.readStream.schema(table(spark, []).schema).parquet(src)
    queue.run(stream(), tables, handler, str(tmp_path / "cp"), lambda: now()).awaitTermination()
    got = {r["id"]: r for r in tables.read("jobs").collect()}
    assert {k: v["status"] for k, v in got.items()} == {"a": "done", "b": "pending", "c": "failed"}
    assert got["b"]["attempts"] == 1 and got["b"]["run_after"] == dt.datetime(2024, 5, 1, 12, 1)
    # jobs that come again are not added twice; the retry runs once it is due
    table(spark, [job("a")]).write.mode("append").parquet(src)
    queue.run(stream(), tables, handler, str(tmp_path / "cp"), lambda: F.lit("2024-05-01 12:02:00").cast("timestamp")).awaitTermination()
    got = {r["id"]: r for r in tables.read("jobs").collect()}
    assert len(got) == 3 and got["a"]["attempts"] == 1 and got["b"]["attempts"] == 2


def counting(folder, answer="true"):
    """A handler that leaves a file for each call of a job, and whose answers may differ from call to call."""

    def handle(rows):
        @F.udf("struct<ok:boolean,retry:boolean>")
        def of(i):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(i)
            ok = answer == "true" or random.random() < 0.5
            return ok, answer == "retry"

        said = rows.select("id", of.asNondeterministic()(F.col("id")).alias("s"))
        return said.select("id", "s.ok", "s.retry", F.lit("erratic").alias("error"))

    return handle


@pytest.mark.parametrize("answer", ["true", "erratic"])
def test_each_job_is_handled_once(spark, tmp_path, answer):
    t = catalog.Tables(spark, str(tmp_path / "t"))
    (tmp_path / "calls").mkdir()
    arrived = table(spark, [job(f"j{k}", created=k) for k in range(20)])
    assert queue.drain(t, arrived, counting(tmp_path / "calls", answer), now(), n=8) == 20
    rows = t.read("jobs").collect()
    calls = sorted(p.read_text() for p in (tmp_path / "calls").iterdir())
    assert calls == sorted(f"j{k}" for k in range(20)) and sorted(r["id"] for r in rows) == calls
    assert {r["status"] for r in rows} == ({"done"} if answer == "true" else {"done", "failed"}) and {r["attempts"] for r in rows} == {1}


def test_all_due_jobs_are_claimed_at_once(spark, tmp_path):
    """Rounds don't grow with the queue: each costs dozens of small Spark jobs."""
    t, calls = catalog.Tables(spark, str(tmp_path / "t")), []
    k = F.col("id")
    due = spark.range(10_001).select(F.concat(F.lit("j"), k.cast("string")).alias("id"), F.lit("local").alias("tenant_id"), F.lit("fetch").alias("kind"), F.lit("{}").alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now().alias("run_after"), now().alias("created_at"))
    t.replace("jobs", due.select(*((F.col(f.name) if f.name in due.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.read("jobs").schema)))

    def handle(rows):
        calls.append(rows.count())
        return rows.select("id", F.lit(True).alias("ok"), F.lit(False).alias("retry"), F.lit(None).cast("string").alias("error"))

    assert queue.drain(t, None, handle, now()) == 10_001 and calls == [10_001]
    assert t.read("jobs").where("status = 'done' and attempts = 1").count() == 10_001


def test_jobs_of_a_lost_handler_run_again(spark, tmp_path):
    src, t = str(tmp_path / "in"), catalog.Tables(spark, str(tmp_path / "t"))
    table(spark, [job("a"), job("b")]).write.parquet(src)

    def lost(rows):
        raise RuntimeError("killed")

    stream = lambda: spark.readStream.schema(JOB).parquet(src)
    with pytest.raises(Exception, match="killed"):
        queue.run(stream(), t, lost, str(tmp_path / "cp"), now).awaitTermination()
    assert {r["status"] for r in t.read("jobs").collect()} == {"running"}
    queue.run(stream(), t, lambda rows: rows.select("id", F.lit(True).alias("ok"), F.lit(False).alias("retry"), F.lit(None).cast("string").alias("error")), str(tmp_path / "cp"), now).awaitTermination()
    got = t.read("jobs").collect()
    assert {(r["id"], r["status"], r["attempts"]) for r in got} == {("a", "done", 2), ("b", "done", 2)} and len(got) == 2


def test_retries_run_on_an_idle_stream(spark, tmp_path):
    src, t = str(tmp_path / "in"), catalog.Tables(spark, str(tmp_path / "t"))
    (tmp_path / "in").mkdir()
    start = time.time()
    clock = lambda: F.lit(dt.datetime(2024, 5, 1, 12) + dt.timedelta(seconds=60 * (time.time() - start)))  # noqa: E731  a minute a second
    t.append("jobs", table(spark, [job("a")]))
    failing = lambda rows: rows.select("id", (F.col("attempts") > 1).alias("ok"), F.lit(True).alias("retry"), F.lit("boom").alias("error"))
    q = queue.run(spark.readStream.schema(JOB).parquet(src), t, failing, str(tmp_path / "cp"), clock, available_now=False)
    try:
        while time.time() < start + 90 and t.read("jobs").first()["status"] != "done":
            time.sleep(1)
        assert (t.read("jobs").first()["status"], t.read("jobs").first()["attempts"]) == ("done", 2)
    finally:
        q.stop()


def test_rates_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(at(k), "fetch") for k in (1, 2, 12)] + [(dt.datetime(2024, 5, 2), "fetch")], "ts timestamp, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    q = queue.rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window_start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(at(0), 2), (at(10), 1)}
    assert queue.rates(rows).count() == 3


WORDS = ["rust", "borrow", "cooking", "pasta"]


def embedder(column):
    return F.array(*(F.size(F.split(F.lower(column), w)).cast("float") - 1 for w in WORDS))


def fetched(pages):
    """A fetcher of a made-up web: pages 0 to 7 are there, others are gone, or don't answer."""
    n = F.regexp_extract("url", r"(\d+)$", 1)
    ok = n.cast("int") < 8
    return pages.select(
        "document_id", ok.alias("ok"), (n == "9").alias("retry"), F.when(~ok, F.when(n == "8", "dead link: 404").otherwise("no answer")).alias("error"), "fetcher",
        F.concat(F.lit("# Page "), n, F.lit("\n\nRust borrow rules of page "), n).alias("markdown"), F.concat(F.lit("Page "), n).alias("title"), F.lit("article").alias("content_type"), F.concat("url", F.lit("/")).alias("final_url"),
    )


def test_worker_from_an_empty_folder(spark, tmp_path):
    """Bookmarks go through fetch, index and cluster jobs; nothing is there at first."""
    e = Engine(spark, str(tmp_path), load_settings("embedding_dim: 4\nclustering: {center: false}"), embedder)
    for k in (0, 3, 8, 9):
        assert e.add_bookmark(f"https://h.example.com/{k}", tags=["db"], now=now()).first()["jobs_enqueued"] == 1
    e.tables.append("jobs", table(spark, [job("lone", payload='{"document_id": "nobody"}'), job("c", "cluster", created=59), job("odd", "summarize")]))
    rules = spark.createDataFrame([(1, "any", [], "reader")], "rule_no int, kind string, hosts array<string>, fetcher string")
    assert e.work(fetched, lambda: rules, now()) == 9
    docs = {r["url"]: r for r in e.tables.read("documents").collect()}
    state = {u[-1]: (r["state"], r["title"], r["content_type"], r["url_canonical"]) for u, r in docs.items()}
    assert state == {
        "0": ("fetched", "Page 0", "article", "https://h.example.com/0/"), "3": ("fetched", "Page 3", "article", "https://h.example.com/3/"),
        "8": ("dead", None, "unknown", None), "9": ("pending", None, "unknown", None),
    }
    ended = {(r["kind"], r["status"], r["last_error"]) for r in e.tables.read("jobs").collect()}
    assert ended == {("fetch", "done", None), ("index", "done", None), ("cluster", "done", None), ("fetch", "failed", "dead link: 404"), ("fetch", "pending", "no answer"), ("fetch", "failed", "no document nobody"), ("summarize", "failed", "no handler")}
    three = docs["https://h.example.com/3"]["id"]
    assert e.document(three).first()["markdown"].startswith("# Page 3") and e.document(three).first()["fetcher"] == "reader"
    assert [r["url"] for r in e.search("page 3").collect()][0] == "https://h.example.com/3"
    assert e.chunks([f"{three}#0"]).first()["extraction_id"] == docs["https://h.example.com/3"]["current_extraction_id"] and e.chunks([]).count() == 0
    # again: a second extraction, and the first one stays
    later = F.lit("2024-05-02 12:00:00").cast("timestamp")
    with pytest.raises(Conflict):
        e.refetch(docs["https://h.example.com/8"]["id"], now=later)
    assert e.refetch(three, now=later) and e.document(three).first()["state"] == "pending"
    assert e.work(fetched, now=later) == 3  # the fetch, the index that follows, and the one that did not answer
    assert e.extractions(three).count() == 2 and e.document(three).first()["current_extraction_id"] == e.extractions(three).first()["id"]
    assert e.chunks([f"{three}#0"]).count() == 1
    first = e.extractions(three).collect()[1]["id"]
    e.set_current_extraction(three, first)
    assert e.document(three).first()["current_extraction_id"] == first
    for act in (lambda: e.set_current_extraction(three, "none"), lambda: e.refetch("none"), lambda: e.chunks(["none"]), lambda: e.interest("none"), lambda: e.bookmark("none"), lambda: e.set_state("none", "dead")):
        with pytest.raises(KeyError):
            act()
    with pytest.raises(Conflict):
        e.reindex(docs["https://h.example.com/8"]["id"])
    at = F.lit("2024-05-03 12:00:00").cast("timestamp")
    assert e.reindex(three, at) and e.reindex_all(now=at) == 2 and e.refetch_all(now=at) == 3
    mark = e.bookmarks().first()["id"]
    e.link_bookmark(mark, three)
    assert e.bookmark(mark).first()["document_id"] == three
    e.set_state(three, "failed", at)
    assert e.documents("failed").count() == 1 and e.documents("dead").count() == 1


def test_labels_by_a_language_model(spark, tmp_path):
    asked = lambda prompt: F.when(prompt.contains("Rust"), F.concat(F.lit("NAME: Systems\nSUMMARY: About "), F.regexp_extract(prompt, "- ([^\n]*)", 1))).otherwise("")
    titles = spark.createDataFrame([(0, 2, "B"), (0, 1, "Rust A"), (1, 1, "Pasta")], "label int, rank int, title string")
    assert [tuple(r) for r in clustering.generated_labels(titles, asked).collect()] == [(0, "Systems", "About Rust A")]


def test_engine(spark, tmp_path):
    def by_host(points, settings):
        """A clusterer of one's own."""
        return points.select("id", (F.get("embedding", F.lit(0)) > 0).cast("int").alias("label"))

    settings = load_settings("embedding_dim: 4\nclustering: {center: false}")
    e = Engine(spark, str(tmp_path), settings, embedder)
    urls = [(k, f"https://h{k % 2}.example.com/{k}", f"{'Rust borrow' if k % 2 else 'Pasta cooking'} {k}", "", [], None) for k in range(8)]
    incoming = spark.createDataFrame(urls, "place long, url string, title string, folder_path string, tags array<string>, saved_at timestamp")
    c = e.import_bookmarks(incoming, "html", now()).first()
    assert (c["created"], c["jobs_enqueued"]) == (8, 8)
    assert e.import_bookmarks(incoming, "html", now()).first()["skipped"] == 8
    assert e.add_bookmark("https://h0.example.com/0", now=now()).first()["created"] == 1
    docs = {r["url"]: r["id"] for r in e.tables.read("documents").collect()}
    texts = [(docs[u], f"{'rust borrow checker' if k % 2 else 'pasta cooking recipe'} number{k}") for k, u, *_ in urls]
    e.index(spark.createDataFrame(texts, "document_id string, markdown string"))
    assert {r["state"] for r in e.tables.read("documents").collect()} == {"fetched"}
    hits = e.search("rust number3").collect()
    assert hits[0]["url"] == "https://h1.example.com/3" and hits[0]["chunks"][0]["snippet"].startswith("<em>rust</em>")
    related = e.related(docs["https://h1.example.com/3"], 3).collect()
    assert {r["url"] for r in related} == {f"https://h1.example.com/{k}" for k in (1, 5, 7)}
    run = e.rebuild_interests(now())
    shown = e.interests().collect()
    assert [r["size"] for r in shown] == [4, 4] and all(len(r["members"]) == 4 for r in shown) and all(r["run_id"] == run for r in shown)
    assert e.tables.read("cluster_runs").first()["num_clusters"] == 2
    stats = {(r["what"], r["key"]): r["n"] for r in e.stats().collect()}
    assert stats == {("documents", "fetched"): 8, ("jobs", "pending"): 9, ("bookmarks", "all"): 9}
    assert e.interest(shown[0]["id"], 2).first()["members"][1]["title"] == shown[0]["members"][1]["title"]
    own = Engine(spark, str(tmp_path), settings, embedder, clusterer=by_host)
    own.rebuild_interests(F.lit("2024-05-01 13:00:00").cast("timestamp"))
    assert own.tables.read("cluster_runs").first()["algo"] == "by_host" and own.interests().count() == 2
    assert e.refetch_all(now=F.lit("2024-05-02").cast("timestamp")) == 8
    assert e.jobs(kind="fetch").count() == 17
    assert e.prune_jobs(status="pending") == 17 and e.jobs().count() == 0
    assert e.document(docs["https://h1.example.com/3"]).count() == 1
    with pytest.raises(KeyError):
        e.related("absent")
    with pytest.raises(ValueError):
        e.search("")
    first = e.bookmarks(limit=2).collect()
    e.delete_bookmark(first[0]["id"])
    assert e.tables.read("bookmarks").count() == 8
    assert np.isfinite(e.job_metrics(now=now()).count())


def test_failing_hosts_as_a_stream(spark, tmp_path):
    """Changes of a replayed table end where the batch operator does, and forgotten hosts leave no state."""
    from pyspark.sql import Window as W

    from quern.streaming import hosts

    rows = [(f"h{k % 5}", f"k{k % 3}", f"2024-01-01 00:{k:02d}:00") for k in range(40)] + [("old", "k1", "2024-01-01 00:00:30"), ("h1", "k9", "2024-01-01 00:36:00"), (None, "k1", "2024-01-01 00:05:00")]
    source = spark.createDataFrame(rows, "host string, kind string, at string").selectExpr("host", "kind", "timestamp(at) as seen_at")
    for n, until in enumerate(("00:15:00", "00:30:00", "00:59:00")):
        since = ("00:00:00", "00:15:00", "00:30:00")[n]
        source.where(f"seen_at >= timestamp'2024-01-01 {since}' and seen_at < timestamp'2024-01-01 {until}'").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    before = spark.conf.get(hosts.PROVIDER[0], None)
    seen: list = []
    try:
        spark.conf.unset(hosts.PROVIDER[0])
        with pytest.raises(ValueError):
            hosts.live_hosts(stream, 600)
        spark.conf.set(*hosts.PROVIDER)
        q = hosts.live_hosts(stream, 600).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset(hosts.PROVIDER[0]) if before is None else spark.conf.set(hosts.PROVIDER[0], before)
    changes = spark.createDataFrame(seen, "batch long, host string, kind string, seen_at timestamp, live boolean")
    order = W.partitionBy("host").orderBy(F.desc("batch"), F.desc("seen_at"), "live")
    last = {r["host"]: (r["kind"], r["live"]) for r in changes.withColumn("n", F.row_number().over(order)).where("n = 1").collect()}
    want = {r["host"]: r["kind"] for r in jobs.live_hosts(source.where("host is not null"), F.lit("2024-01-01 00:39:00").cast("timestamp"), 600).collect()}
    assert {h: k for h, (k, live) in last.items() if live} == want and last["old"] == ("k1", False)
    assert kept[-1] >= len(want)
