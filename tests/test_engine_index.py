"""The engine's index: statistics by deltas, many queries, topics of done runs alone."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.engine import Engine
from quern.operators import catalog, lexical
from quern.plans import fetched
from quern.sources.config import load_settings


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embedder(texts: pd.Series) -> pd.Series:
    return pd.Series([[3.0 * ("rust" in t), 3.0 * ("pasta" in t), len(t) / 1000, 1.0] for t in texts], dtype=object)


def at(hour):
    return F.lit(f"2024-05-01 {hour:02d}:00:00").cast("timestamp")


def by_subject(points, settings):
    return points.select("id", (F.get("embedding", F.lit(0)) > 1).cast("int").alias("label"))


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), load_settings("embedding_dim: 4\nclustering: {center: false}"), embedder, clusterer=by_subject)
    rows = [(k, f"https://h{k % 2}.example.com/{k}", f"Title {k}", "", [], None) for k in range(8)]
    e.import_bookmarks(spark.createDataFrame(rows, "place long, url string, title string, folder_path string, tags array<string>, saved_at timestamp"), "html", at(1))
    return e


def texts(e, words, which=range(8)):
    docs = {int(r["url"].rsplit("/", 1)[1]): r["id"] for r in e.tables.read("documents").collect()}
    return e.spark.createDataFrame([(docs[k], words(k)) for k in which], "document_id string, markdown string")


def counted(e):
    """Statistics as the deltas have them, and as a count of the index has them."""
    lengths, posted = e.tables.read("chunk_lengths"), e.tables.read("postings")
    sums = lexical.summed_statistics(e.tables.read("index_statistics")).first()
    terms = e.tables.read("term_statistics").groupBy("term").agg(F.sum("chunks").alias("n")).where("n <> 0")
    kept = (tuple(sums), {r["term"]: r["n"] for r in terms.collect()})
    return kept, (tuple(lexical.statistics(lengths).first()), {r["term"]: r["count"] for r in posted.groupBy("term").count().collect()})


def test_statistics_by_deltas_are_a_recount(engine):
    engine.index(texts(engine, lambda k: f"rust borrow checker number{k}" if k % 2 else "pasta cooking " * (k + 1)), at(2))
    kept, real = counted(engine)
    assert kept == real and kept[0][0] == 8
    engine.index(texts(engine, lambda k: f"rust of another kind {k}", range(3)), at(3))
    engine.index(texts(engine, lambda k: "", [5]), at(4))  # nothing is left of its chunks
    kept, real = counted(engine)
    assert kept == real and "number1" not in kept[1] and kept[0][0] == 7
    best = engine.search("rust").collect()
    assert {r["url"][-1] for r in best if r["chunks"][0]["bm25_score"] is not None} == {"0", "1", "2", "3", "7"}


def test_queries_in_one_plan_are_searches(engine):
    engine.index(texts(engine, lambda k: f"rust borrow checkers number{k}" if k % 2 else f"pasta cooking recipe number{k}"), at(2))
    asked = {1: "borrowing checker", 2: "recipes number4", 3: "number7"}
    got = engine.search_queries(engine.spark.createDataFrame(list(asked.items()), "query_id long, text string"), 5).collect()
    for q, text in asked.items():
        want = [(r["document_id"], round(r["score"], 12)) for r in engine.search(text, 5).collect()]
        assert [(r["document_id"], round(r["score"], 12)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    docs = {r["url"][-1]: r["id"] for r in engine.tables.read("documents").collect()}
    judged = engine.spark.createDataFrame([(3, docs["7"]), (2, docs["4"])], "query_id long, id string")
    per, means = engine.evaluate_queries(engine.spark.createDataFrame(list(asked.items()), "query_id long, text string"), judged, 5)
    assert {r["query_id"]: r["recall"] for r in per.collect()} == {2: 1.0, 3: 1.0} and means.first()["mean_recall"] == 1.0


@pytest.mark.parametrize("failing", ["clusters", "cluster_documents", "cluster_runs"])
def test_topics_of_a_failed_rebuild_are_not_shown(engine, monkeypatch, failing):
    engine.index(texts(engine, lambda k: f"rust borrow checker number{k}" if k % 2 else "pasta cooking"), at(2))
    run = engine.rebuild_interests(at(3))
    before = sorted(r["id"] for r in engine.interests().collect())
    assert len(before) == 2
    written, append, replace = [], catalog.Tables.append, catalog.Tables.replace

    def lost(self, name):
        if name == failing and not written:
            written.append(name)
            raise RuntimeError("the run is lost")

    def failing_append(self, name, rows):
        out = append(self, name, rows)
        lost(self, name)
        return out

    def failing_replace(self, name, rows, **how):
        lost(self, name)
        return replace(self, name, rows, **how)

    monkeypatch.setattr(catalog.Tables, "append", failing_append)
    monkeypatch.setattr(catalog.Tables, "replace", failing_replace)
    with pytest.raises(RuntimeError):
        engine.rebuild_interests(at(4))
    shown = engine.interests().collect()
    assert sorted(r["id"] for r in shown) == before and {r["run_id"] for r in shown} == {run}
    engine.rebuild_interests(at(5))
    assert engine.interests().count() == 2


def test_only_pages_that_can_be_read_are_parsed(spark):
    rows = [(str(k), f"https://x.example.com/{k}", None, 200 if k < 3 else 404, "text/html" if k < 2 else "application/zip", f"<html><title>A page of words</title><body><article><p>{'Some words of it, and more. ' * 60}</p></article></body></html>") for k in range(5)]
    answers = spark.createDataFrame(rows, "document_id string, url string, final_url string, status int, content_type string, body string")
    plan = fetched.results(answers)._jdf.queryExecution().optimizedPlan().toString()
    assert "extracted(CASE WHEN" in plan
    assert {r["document_id"] for r in fetched.results(answers).where("ok").collect()} == {"0", "1"}
