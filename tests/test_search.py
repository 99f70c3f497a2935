import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import clustering, evaluation, fusion, lexical, search, vector_search


def ranking(spark, ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids, 1)], "id string, rank int")


def order(df):
    return [r["id"] for r in df.orderBy(F.desc("score"), "id").collect()]


def test_fuse(spark):
    a, b = ranking(spark, "abc"), ranking(spark, "bca")
    assert order(fusion.fuse([a, b])) == ["b", "a", "c"]
    assert order(fusion.fuse([ranking(spark, "ab"), ranking(spark, "ba")], [1.0, 10.0]))[0] == "b"
    assert order(fusion.fuse([ranking(spark, "a"), ranking(spark, "b")])) == ["a", "b"]
    got = fusion.fuse([a], k=0).where("id = 'a'").first()["score"]
    assert got == 1 / 61
    assert fusion.fuse([a.withColumn("rank", F.lit(0))]).count() == 0


def test_collapse(spark):
    rows = [("x", "c1", 1.0), ("x", "c2", 0.5), ("x", "c3", 0.25), ("x", "c4", 0.125), ("y", "c5", 1.5), ("z", "c6", -1.0)]
    df = spark.createDataFrame(rows, "document_id string, chunk_id string, score double")
    got = {s: [(r["document_id"], r["score"]) for r in fusion.collapse(df, s).orderBy("rank").collect()] for s in ("max", "sum", "top3_avg", "odd")}
    assert got["max"] == got["odd"] == [("y", 1.5), ("x", 1.0), ("z", 0.0)]
    assert got["sum"] == [("x", 1.875), ("y", 1.5), ("z", -1.0)]
    assert got["top3_avg"][1] == ("x", (1.0 + 0.5 + 0.25) / 3)
    best = fusion.collapse(df, "max", 2).where("document_id = 'x'").first()["chunks"]
    assert [c["chunk_id"] for c in best] == ["c1", "c2", "c3"]


def corpus(spark):
    rows = [("postgres", 0.10, "article", "https://github.com/a/b"), ("btree", 0.20, "pdf", "https://example.com/b"), ("llm", 0.30, "repo", "https://example.com:8080/c")]
    docs = spark.createDataFrame([(i, "local", t, u) for i, _, t, u in rows], "document_id string, tenant_id string, content_type string, url string")
    vectors = spark.createDataFrame([(f"{i}#0", i, 0, [v] * 8) for i, v, _, _ in rows], "chunk_id string, document_id string, ord int, embedding array<float>")
    chunks = spark.createDataFrame([(f"{i}#0", i, "kubernetes deployment guide") for i, *_ in rows], "chunk_id string, document_id string, text string")
    marks = spark.createDataFrame([("postgres", "manual"), ("btree", "chrome"), ("btree", "html"), ("llm", "chrome")], "document_id string, source string")
    return docs, vectors, chunks, marks


def test_related(spark):
    docs, vectors, _, _ = corpus(spark)
    got = search.related(vectors, docs, "postgres").orderBy("rank").collect()
    assert [r["document_id"] for r in got] == ["btree", "llm"]
    assert got[0]["score"] == pytest.approx(1 / (1 + math.sqrt(8 * 0.1**2)), abs=1e-6)
    assert search.related(vectors, docs, "absent").count() == 0


@pytest.mark.parametrize(
    ("filters", "found"),
    [
        (search.Filters(content_types=("pdf",)), {"btree"}),
        (search.Filters(content_types=("article", "repo")), {"postgres", "llm"}),
        (search.Filters(sources=("manual",)), {"postgres"}),
        (search.Filters(sources=("chrome", "html")), {"btree", "llm"}),
        (search.Filters(hosts=("GitHub.com",)), {"postgres"}),
        (search.Filters(hosts=("example.com",)), {"btree", "llm"}),
        (search.Filters(exclude_document="llm"), {"postgres", "btree"}),
        (search.Filters(), {"postgres", "btree", "llm"}),
    ],
)
def test_filters_hold_in_both_legs(spark, filters, found):
    docs, vectors, chunks, marks = corpus(spark)
    allowed = search.matching(docs, filters, marks)
    query = spark.createDataFrame([([0.999] * 8,)], "v array<float>")
    assert {r["document_id"] for r in search.bm25_search(chunks, allowed, "kubernetes").collect()} == found
    assert {r["document_id"] for r in search.vector_leg(vectors, allowed, query).collect()} == found
    assert filters.empty() == (len(found) == 3)


@pytest.mark.parametrize("stemmed", [True, False])
def test_a_search_goes_through_the_texts_once(spark, stemmed):
    """Statistics and scores read one pass, document ids come along; chunks of no document count in the statistics, and are not returned."""
    rows = [(k, None if k % 7 == 0 else k % 5, f"w{k % 3} common stone w{k % 11}" + " pad" * (k % 4)) for k in range(60)]
    schema, read = "chunk_id long, document_id long, text string", spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    chunks = spark.createDataFrame(rows, schema)
    docs = spark.createDataFrame([(1,), (2,), (None,), (2,)], "document_id long")
    got = search.bm25_search(chunks.mapInArrow(passed, schema), docs, "w1 stones common-stone", 100, stemmed=stemmed).collect()
    assert read.value == len(rows)
    scores = {r["chunk_id"]: r["score"] for r in lexical.scores(lexical.index(chunks, stemmed=stemmed), lexical.phrases_of("w1 stones common-stone", stemmed)).collect()}
    assert {r["chunk_id"]: r["score"] for r in got} == {k: scores[k] for k, d, _ in rows if d in (1, 2)} and len(got) == len({r["chunk_id"] for r in got}) > 10


def test_hybrid_keeps_each_legs_scores(spark):
    docs, vectors, chunks, _ = corpus(spark)
    bm25 = search.bm25_search(chunks, docs.where("document_id <> 'llm'"), "kubernetes")
    near = search.vector_leg(vectors, docs.where("document_id <> 'postgres'"), spark.createDataFrame([([0.3] * 8,)], "v array<float>"))
    got = {r["document_id"]: r["chunks"][0] for r in search.hybrid(bm25, near, weights=(0.0, 1.0)).collect()}
    assert got["llm"]["bm25_score"] is None and got["postgres"]["vector_score"] is None
    assert got["btree"]["bm25_score"] is not None and got["btree"]["vector_score"] is not None


def test_vector_lengths(spark):
    _, vectors, _, _ = corpus(spark)
    with pytest.raises(Exception, match="different lengths"):
        vector_search.nearest(vectors, spark.createDataFrame([([1.0],)], "v array<float>")).collect()


def test_mean_pooled(spark):
    rows = spark.createDataFrame([("x", 0, [0.1] * 4), ("x", 1, [0.3] * 4), ("y", 0, [0.5] * 4)], "document_id string, ord int, embedding array<float>")
    got = {r["document_id"]: r["embedding"] for r in vector_search.mean_pooled(rows, ["document_id"]).collect()}
    assert got["x"] == pytest.approx([0.2] * 4) and got["y"] == pytest.approx([0.5] * 4)
    assert vector_search.leading_mean(rows, "x", 1).first()["embedding"] == pytest.approx([0.1] * 4)


def test_measures(spark):
    rank = spark.createDataFrame([("q", k, i) for k, i in enumerate("abcd", 1)] + [("r", 1, "x"), ("r", 2, "a")], "query_id string, rank int, id string")
    judged = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "c"), ("r", "a"), ("s", "z")], "query_id string, id string")
    got = {r["query_id"]: r for r in evaluation.per_query(rank, judged, 4).collect()}
    assert got["q"]["ndcg"] == pytest.approx(1.5 / 1.6309297535714573) and got["q"]["precision"] == 0.5 and got["q"]["recall"] == 1.0
    assert got["r"]["rr"] == 0.5 and got["r"]["precision"] == 0.5
    assert (got["s"]["recall"], got["s"]["ndcg"], got["s"]["rr"]) == (0, 0, 0)
    assert evaluation.per_query(rank, judged, 2).where("query_id = 'q'").first()["recall"] == 0.5
    mean = evaluation.means(evaluation.per_query(rank, judged, 4)).first()
    assert mean["queries"] == 3 and mean["mrr"] == 0.5


POINTS = [("a1", [1, 0.10, 0, 0]), ("a2", [1, 0.05, 0, 0]), ("a3", [0.9, 0, 0.05, 0]), ("a4", [1, 0, 0.10, 0]), ("b1", [0, 1, 0.10, 0]), ("b2", [0, 1, 0, 0]), ("b3", [0, 0.9, 0, 0.05]), ("out", [0, 0, 0, 1])]
SHARED = [("a1", [10.0, 10.0, 8.0, 8.0]), ("a2", [10.1, 9.9, 8.0, 8.0]), ("a3", [9.9, 10.1, 8.0, 8.0]), ("b1", [8.0, 8.0, 10.0, 10.0]), ("b2", [8.0, 8.0, 10.1, 9.9]), ("b3", [8.0, 8.0, 9.9, 10.1])]


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, embedding array<float>")


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


@pytest.mark.parametrize("least, cells", [(-1.0, 64), (0.2, 1 << 20), (0.2, 300)])
def test_pairs_of_blocks_are_multiplied_once(least, cells):
    """Both sides of two blocks from one product, in strips, equal ones by id: as all pairs of either side."""
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 6))
    v[40:55], v[70:80] = v[3], v[3]  # equal weights
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    ids = np.sort(rng.permutation(500)[:90])
    low = np.arange(90) % 3 > 0

    def plain(one, other):
        out = []
        for i in one:
            w = [(-sum(float(a) * float(b) for a, b in zip(v[i], v[j], strict=True)), int(ids[j])) for j in other if j != i]
            out += [(int(ids[i]), j, -x) for x, j in sorted(w)[:4] if -x >= least]
        return sorted(out)

    x, y = np.flatnonzero(low), np.flatnonzero(~low)
    made = lambda a, b, same: sorted((int(r.src), int(r.dst), r.w) for f in clustering._pair_edges(v[a], ids[a], v[b], ids[b], 4, least, same, cells) for r in f.itertuples())
    near = lambda rows: [(a, b, round(w, 12)) for a, b, w in rows]
    assert near(made(x, y, False)) == near(sorted(plain(x, y) + plain(y, x)))
    assert near(made(x, x, True)) == near(plain(x, x))


def test_rows_are_sent_to_few_blocks(spark):
    """A row is dealt out once for each block of 16,384 rows, or for 16 where there are few: it was for each block of 2,048."""
    units = spark.range(70_000).select("id", F.array(F.lit(1.0), F.col("id") / 70_000).alias("unit"))
    plan = clustering.knn_edges(units, 3, 2.0)
    gateway = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    known = {stages().apply(k).stageId() for k in range(stages().size())}
    assert plan.count() == 0
    found = stages()
    dealt = max(found.apply(k).shuffleWriteRecords() for k in range(found.size()) if found.apply(k).stageId() not in known)
    assert dealt <= 16 * 70_000


def test_units_cost_their_length(spark):
    """The norm is found once, not for each component: 6,000 of them would be 36 million steps a vector."""
    import time

    from quern.functions import vectors

    rows = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda k: k.cast("double")).alias("v"))
    start = time.time()
    got = rows.select(vectors.unit(F.col("v")).alias("u")).select(F.sum(vectors.squared(F.col("u"))).alias("s")).first()["s"]
    assert abs(got - 20) < 1e-4 and time.time() - start < 10
    odd = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<double>").select("id", vectors.unit(F.col("v")).alias("u"))
    assert {r["id"]: r["u"] and [round(x, 6) for x in r["u"]] for r in odd.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}


@pytest.mark.parametrize("block", [2048, 2])
def test_clusters_and_noise(spark, block):
    got = labels(clustering.cluster(points(spark, POINTS), block=block))
    assert got == {**dict.fromkeys(("a1", "a2", "a3", "a4"), 0), **dict.fromkeys(("b1", "b2", "b3"), 1), "out": -1}


def test_small_and_zero_points(spark):
    assert labels(clustering.cluster(points(spark, [("x", [1, 0]), ("y", [1, 0.01])]))) == {"x": -1, "y": -1}
    assert labels(clustering.cluster(points(spark, [("x", [0, 0])]), center=True)) == {"x": -1}
    assert clustering.cluster(points(spark, POINTS).where("false")).count() == 0


def test_centring(spark):
    assert len(set(labels(clustering.cluster(points(spark, SHARED))).values())) == 1
    got = labels(clustering.cluster(points(spark, SHARED), center=True))
    assert got["a1"] == got["a2"] == got["a3"] != got["b1"] == got["b2"] == got["b3"]


@pytest.mark.parametrize("iters", [1, 2, 20])
def test_components_are_swept_as_one_graph_is(spark, iters):
    """Labels of one sweep over all edges, and of a sweep for each component, are the same."""
    r = np.random.default_rng(4)
    x = np.concatenate([c + 0.5 * r.standard_normal((25, 6)) for c in 4 * r.standard_normal((5, 6))])
    ids = r.permutation(len(x)) * 3
    points = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "id long, embedding array<double>")
    edges = clustering.undirected(clustering.knn_edges(clustering.unit_residuals(points, False), 4, 0.5, 16)).toPandas()
    nodes = np.array(sorted(set(edges["src"])))
    label = nodes[clustering.propagate(len(nodes), np.searchsorted(nodes, edges["src"]), np.searchsorted(nodes, edges["dst"]), edges["w"].to_numpy(), iters)]
    want = {}
    for n, k in zip(nodes.tolist(), label.tolist(), strict=True):
        want.setdefault(k, []).append(n)
    order = sorted((g for g in want.values() if len(g) >= 3), key=lambda g: (-len(g), g[0]))
    got = {row["id"]: row["label"] for row in clustering.cluster(points, 4, 0.5, 3, iters, block=16).collect()}
    assert got == {int(i): next((k for k, g in enumerate(order) if i in g), -1) for i in ids}
    parts = clustering.with_component(spark.createDataFrame([(a, b) for a, b in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True)], "src long, dst long")).collect()
    assert len({row["component"] for row in parts}) > 1 and all(row["component"] <= min(row["src"], row["dst"]) for row in parts)


def test_propagation_is_sequential():
    # a path: each node sees what the one before it took
    src, dst = np.array([0, 1, 1, 2, 2, 3]), np.array([1, 0, 2, 1, 3, 2])
    assert clustering.propagate(4, src, dst, np.ones(6)).tolist() == [1, 1, 1, 1] or len(set(clustering.propagate(4, src, dst, np.ones(6)).tolist())) <= 2
    assert clustering.propagate(4, src, dst, np.ones(6), 0).tolist() == [0, 1, 2, 3]


def test_summaries_and_labels(spark):
    p = points(spark, POINTS)
    sizes, members = clustering.summaries(p, clustering.cluster(p), center=False)
    assert {r["label"]: r["size"] for r in sizes.collect()} == {0: 4, 1: 3}
    assert all(0 <= r["similarity"] <= 1 + 1e-6 for r in members.collect()) and members.count() == 7
    titles = spark.createDataFrame([(0, 1, "Learning Rust"), (0, 2, "Deep learning with the café"), (0, 3, "rust rust")], "label int, rank int, title string")
    assert clustering.term_labels(titles.withColumnRenamed("label", "c"), ["c"]).first()["label"] == "Rust Learning Deep Caf"


def test_label_answers(spark):
    cases = {
        "NAME - DNS Fundamentals\nSUMMARY: How names resolve.": ("DNS Fundamentals", "How names resolve."),
        "**Name:** x\n": ("Name:** x", ""),
        "- NAME: \"Go\"\n": ("Go", ""),
        "Sure, here is the topic that you have asked me for:": ("", ""),
        "Rust Async": ("Rust Async", ""),
        "": ("", ""),
    }
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", clustering.label_answer(F.col("a")).alias("l")).collect()
    got = {r["a"]: tuple(r["l"]) for r in rows}
    for a, want in cases.items():
        if not a.startswith("**"):
            assert got[a] == want, a
