"""Indexes in blocks and cells, many queries at once, graphs by descent, propagation by wavefronts."""

import os
import random
import re
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern import queries, queries_index
from quern.operators import bitmaps, clustering, evaluation, impact, ivf, lexical, nn_descent, propagation, search, stage, vector_search


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, k // 3, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(1, 40)))) for k in range(600)]
    rows += [(1000 + k, 300, "w5 w5 w9") for k in range(20)] + [(2000, 301, ""), (2001, 301, None)]  # equal scores, and nothing to find
    return spark.createDataFrame(rows, "chunk_id long, document_id long, text string")


def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


# --- blocks by impact ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blocks(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("impact") / "index")
    impact.write(lexical.index(chunks, stemmed=False, keep=("document_id",)), path)
    return impact.read(spark, path)


def plain_scores(chunks, query, documents=None):
    best = search.bm25_search(chunks, chunks.select("document_id").distinct() if documents is None else documents, query, 10, stemmed=False)
    return [(r["chunk_id"], round(r["score"], 9), r["rank"]) for r in best.orderBy("rank").collect()]


@pytest.mark.parametrize("query", ["w5", "w50 w9 w9", "w1 w2 w3 w58", "w5 unheard"])
def test_blocks_give_what_all_postings_give(chunks, blocks, query):
    found = impact.search(blocks, query, 10, stemmed=False)
    assert [(r["chunk_id"], round(r["score"], 9), r["rank"]) for r in found.best.orderBy("rank").collect()] == plain_scores(chunks, query)


def test_blocks_with_documents(spark, chunks, blocks):
    kept = spark.createDataFrame([(k,) for k in range(0, 302, 7)], "document_id long")
    found = impact.search(blocks, "w5 w20", 10, stemmed=False, documents=kept)
    assert [(r["chunk_id"], round(r["score"], 9), r["rank"]) for r in found.best.orderBy("rank").collect()] == plain_scores(chunks, "w5 w20", kept)


def test_few_blocks_are_read(blocks):
    """A rare word decides, so most postings of a frequent one stay unread."""
    found = impact.search(blocks, "w5 w55", 5, stemmed=False, first=1)
    assert 0 < found.read < found.held / 2 and found.looked_up < 100


def test_blocks_without_words(blocks):
    for query in ("", "the of", "unheard"):
        assert impact.search(blocks, query, stemmed=False).best.count() == 0
    with pytest.raises(ValueError):
        impact.search(blocks, "well-known", stemmed=False)


def test_blocks_of_an_empty_table(spark, chunks, tmp_path):
    path = folder(tmp_path)
    impact.write(lexical.index(chunks.where("false"), stemmed=False, keep=("document_id",)), path)
    assert impact.search(impact.read(spark, path), "w5", stemmed=False).best.count() == 0


# --- many queries ----------------------------------------------------------------------------------------------------


def test_scores_of_many_queries_are_those_of_each(spark, chunks):
    indexed = lexical.index(chunks, stemmed=False, keep=("document_id",))
    posted, stats = lexical.inverted(indexed, ("document_id",)), lexical.statistics(indexed)
    asked = {1: "w5 w50 w5", 2: "w1-w2 w7", 3: "the of", 4: "unheard", 5: "w9-w5"}
    rows = [*asked.items(), (6, None), (None, "w5")]
    got = lexical.scores_of_queries(posted, stats, spark.createDataFrame(rows, "query_id long, text string")).collect()
    for q, text in asked.items():
        want = {r["chunk_id"]: round(r["score"], 9) for r in lexical.scores(indexed, lexical.phrases_of(text, False)).collect()}
        assert {r["chunk_id"]: r["score"] for r in got if r["query_id"] == q} == pytest.approx(want, abs=2e-9)
    assert {r["query_id"] for r in got} <= {1, 2, 5}


def test_postings_of_a_long_chunk(spark):
    """A chunk costs little more than its tokens, though each of them is another term; nothing is shuffled."""
    import time

    n = 20_000
    word = F.when(F.col("id") < n - 2, F.concat(F.lit("w"), F.col("id").cast("string"))).otherwise(F.lit("w7"))
    terms = spark.range(n).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", word.alias("w")))), lambda x: x["w"]).alias("w"))
    rows = spark.createDataFrame([(1, 2, [None, "b", "a", None, "b"]), (2, 0, []), (3, 0, None)], "chunk_id long, length int, terms array<string>")
    indexed = stage.keep(rows.unionByName(terms.select(F.lit(4).cast("long").alias("chunk_id"), F.lit(n).alias("length"), F.col("w").alias("terms"))))
    began = time.time()
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["positions"]) for r in lexical.postings(indexed).collect()}
    assert time.time() - began < 20
    assert {k: v for k, v in got.items() if k[0] < 4} == {(1, "a"): (1, [2]), (1, "b"): (2, [1, 4])}
    assert got[(4, "w7")] == (3, [7, n - 2, n - 1]) and got[(4, "w19997")] == (1, [n - 3]) and sum(v[0] for k, v in got.items() if k[0] == 4) == n
    for turned in (lexical.postings(indexed), lexical.inverted(indexed)):
        assert "Exchange" not in turned._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_queries_exchange_hits_before_they_multiply(spark, chunks):
    """What is exchanged is a hit for each phrase, not a row for each query that has it; runs of words of documents are not exchanged at all."""
    indexed = stage.keep(lexical.index(chunks, stemmed=False, keep=("document_id",)))
    posted, asked = stage.keep(lexical.inverted(indexed, keep=("document_id",))), spark.createDataFrame([(k, f"w5 w9 w1-w2 w{k}") for k in range(40)], "query_id int, text string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = lexical.scores_of_queries(posted, lexical.statistics(indexed), asked)
        plan = re.sub(r"#\d+L?", "", plan_of(scored))
        assert "hashpartitioning(query_id, chunk_id" not in plan and "hashpartitioning(chunk_id," in plan
        shared = evaluation.sharing_passages(chunks.select(F.col("chunk_id").alias("id"), "text"), asked, 2)
        assert "hashpartitioning(run" not in plan_of(shared)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_chunks_meet_numbers_before_they_are_postings(spark, monkeypatch):
    kept, keep = [], stage.keep
    monkeypatch.setattr(stage, "keep", lambda df: kept.append(df) or keep(df))
    queries_index._numbered_index(spark, "/root/testdata/sf0.001")
    (posted,) = [df for df in kept if "positions" in df.columns]
    assert "number" in posted.columns and "Join" not in plan_of(posted) and "Exchange" not in plan_of(posted)


def test_blocks_are_sorted_in_shares_of_one_size(spark, chunks, tmp_path, monkeypatch):
    """Postings are dealt to more tasks if there are more of them."""
    seen, kind = [], type(chunks)
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *a: seen.append((df.columns, a)) or deal(df, *a))
    monkeypatch.setattr(impact, "TOKENS", 500, raising=False)
    impact.write(lexical.index(chunks, stemmed=False, keep=("document_id",)), folder(tmp_path))
    (how,) = [a for columns, a in seen if "impact" in columns]
    assert isinstance(how[0], int) and how[0] > 4


def test_inverted_is_postings(chunks):
    indexed = lexical.index(chunks, stemmed=False)
    key = lambda df: sorted((r["term"], r["chunk_id"], r["length"], r["tf"], r["positions"]) for r in df.collect())
    assert key(lexical.inverted(indexed)) == key(lexical.postings(indexed))


def vectors_of(spark, n, d=8, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, d))
    frame = pd.DataFrame({"chunk_id": np.arange(n), "document_id": np.arange(n) // 2, "embedding": list(x.astype(np.float32).tolist())})
    return spark.createDataFrame(frame, "chunk_id long, document_id long, embedding array<float>")


def test_near_rows_of_many_queries_are_those_of_each(spark):
    rows = vectors_of(spark, 300).unionByName(spark.createDataFrame([(900, 1, None)], "chunk_id long, document_id long, embedding array<float>"))
    asked = rows.where("chunk_id in (3, 77, 900)").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = vector_search.nearest_many(rows, asked, 7, block=1).collect()
    for q in (3, 77):
        want = vector_search.nearest(rows, rows.where(F.col("chunk_id") == q).select("embedding"), 7).collect()
        assert [(r["chunk_id"], r["distance"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(r["chunk_id"], r["distance"]) for r in sorted(want, key=lambda r: r["rank"])]
    assert {r["query_id"] for r in got} == {3, 77}
    assert vector_search.nearest_many(rows, asked.where("false"), 7).count() == 0


def test_hybrid_of_many_queries_is_that_of_each(spark, chunks):
    indexed = lexical.index(chunks, stemmed=False, keep=("document_id",))
    vectors = vectors_of(spark, 300)
    asked = spark.createDataFrame([(1, "w5 w50"), (2, "w7"), (3, None)], "query_id long, text string").join(vectors.where("chunk_id < 4").select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id", "left")
    kept = spark.createDataFrame([(k,) for k in range(250)], "document_id long")
    got = search.hybrid_queries(lexical.inverted(indexed, ("document_id",)), lexical.statistics(indexed), vectors, asked, documents=kept).collect()
    for q, text in ((1, "w5 w50"), (2, "w7")):
        words = search.bm25_search(chunks, kept, text, stemmed=False)
        near = search.vector_leg(vectors, kept, vectors.where(F.col("chunk_id") == q).select("embedding"))
        want = search.hybrid(words, near).collect()
        assert [(r["document_id"], r["score"]) for r in got if r["query_id"] == q] == [(r["document_id"], r["score"]) for r in want]
    assert len([r for r in got if r["query_id"] == 3]) == 10  # the vectors' leg alone


def test_passages_that_are_shared(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "a b c d e f g"), (3, "b c d  e\nf g h i"), (4, None), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(7, text), (8, "a b"), (9, None)], "query_id long, text string")
    assert sorted(map(tuple, evaluation.sharing_passages(docs, asked).collect())) == [(7, 1), (7, 3)]


# --- cells -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    rows = vectors_of(spark, 4000, 16).withColumnRenamed("chunk_id", "id")
    codes = ivf.train(rows, k=10, sample=3000, parts=8, codes=64, recall=0.97)
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    ivf.write(rows, codes, path)
    return rows, ivf.read(spark, path)


def exact(rows, asked, k, documents=None):
    if documents is not None:
        rows = rows.join(documents, "document_id", "left_semi")
    return {(r["query_id"], r["chunk_id"]) for r in vector_search.nearest_many(rows.withColumnRenamed("id", "chunk_id"), asked, k).collect()}


def test_cells_find_most_of_the_nearest(spark, cells):
    rows, index = cells
    asked = vectors_of(spark, 40, 16, seed=1).select(F.col("chunk_id").alias("query_id"), "embedding")
    found = ivf.search(index, asked, 10, small=0)
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert len(got) == 400 and len(got & exact(rows, asked, 10)) / 400 >= 0.9
    assert index.codes.probe < len(index.codes.centres) / 2 and index.codes.recall >= 0.97


def test_only_cells_that_are_looked_into_are_read(spark, cells):
    _, index = cells
    asked = vectors_of(spark, 1, 16).select(F.col("chunk_id").alias("query_id"), "embedding")
    plan = ivf.search(index, asked, 10, probe=2, small=0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
    read = plan.split("ReadSchema: ")
    assert any("code" in s.split("\n")[0] and "embedding" not in s.split("\n")[0] for s in read[1:])  # codes alone, first


def test_cells_with_filters(spark, cells):
    """A few documents, far from the query too: all of them are found."""
    rows, index = cells
    kept = spark.createDataFrame([(k,) for k in range(0, 2000, 250)], "document_id long")
    asked = vectors_of(spark, 3, 16).select(F.col("chunk_id").alias("query_id"), "embedding")
    assert {(r["query_id"], r["id"]) for r in ivf.search(index, asked, 20, probe=1, documents=kept, small=0).collect()} == exact(rows, asked, 20, kept)


def test_small_tables_are_searched_whole(spark, cells):
    rows, index = cells
    asked = vectors_of(spark, 20, 16, seed=9).select(F.col("chunk_id").alias("query_id"), "embedding")
    assert {(r["query_id"], r["id"]) for r in ivf.search(index, asked, 10).collect()} == exact(rows, asked, 10)


def test_cells_of_odd_tables(spark, tmp_path):
    kind = "id long, document_id long, embedding array<float>"
    with pytest.raises(ValueError):
        ivf.train(spark.createDataFrame([(1, 1, None)], kind))
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (3, 2, None)], kind)
    path = folder(tmp_path)
    ivf.write(rows, ivf.train(rows), path)
    asked = spark.createDataFrame([(5, [1.0, 2.0]), (6, None)], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["id"], r["distance"], r["rank"]) for r in ivf.search(ivf.read(spark, path), asked, 3, small=0).orderBy("rank").collect()] == [(5, 1, 0.0, 1), (5, 2, 0.0, 2)]
    with pytest.raises(ValueError):
        ivf.write(rows, ivf.train(rows), folder(tmp_path), most_bytes=1)


# --- graphs ------------------------------------------------------------------------------------------------------------


def test_descent_finds_most_neighbours(spark):
    units = clustering.unit_residuals(vectors_of(spark, 1500, 16, spread=0.5).withColumnRenamed("chunk_id", "id"), center=False)
    made = nn_descent.graph(units, 10, pool=20, leaf=64, trees=2, sample=8)
    share = nn_descent.recall(made.edges, clustering.knn_edges(units, 10, -1.0)).first()
    assert share["recall"] >= 0.9 and made.points == 1500
    assert made.edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 10


def test_comparisons_of_descent_dont_grow_with_the_points(spark):
    each = []
    for n in (600, 2400):
        units = clustering.unit_residuals(vectors_of(spark, n, 16, spread=0.5).withColumnRenamed("chunk_id", "id"), center=False)
        each.append(nn_descent.graph(units, 5, pool=8, leaf=32, trees=2, sample=4, rounds=3).compared / n)
    assert each[1] < 1.5 * each[0]


def test_descent_weights_are_those_of_the_exact_graph(spark):
    units = clustering.unit_residuals(vectors_of(spark, 120, 8).withColumnRenamed("chunk_id", "id"), center=False)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(nn_descent.graph(units, 5, 0.3).edges) == key(clustering.knn_edges(units, 5, 0.3))


def test_cells_hold_a_bounded_number_of_rough_hits():
    """A task holds what its queries can need, however many cells and rows it reads; equal distances go by id. It held a frame for each query and cell."""
    import tracemalloc

    rng = np.random.default_rng(2)
    centres, books = rng.standard_normal((40, 8)), rng.standard_normal((4, 16, 2))
    codes, q, most = ivf.Codes(centres, books, 40, 1.0, 8000), rng.standard_normal((150, 8)), 5
    rows = pd.DataFrame({"cell": np.arange(8000) % 40, "id": rng.permutation(8000), "code": [bytes(r) for r in rng.integers(0, 16, (8000, 4), dtype=np.uint8)]})
    wanted = {c: np.arange(150, dtype=np.int32) for c in range(40)}
    tracemalloc.start()
    got = pd.concat(ivf._rough(iter([rows[:5000], rows[5000:]]), codes, q, wanted, most))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 150 * most and peak < 16 << 20
    for i in (0, 77, 149):
        all_ = [(float(a), int(k)) for c, part in rows.groupby("cell") for a, k in zip(codes.distances(q[i], c, np.stack([np.frombuffer(x, dtype=np.uint8) for x in part["code"]])), part["id"], strict=True)]
        assert [(r.away, r.id) for r in got[got["query"] == i].itertuples()] == sorted(all_)[:most]
    named = ivf._least(np.zeros(6), np.array(["b", "a", "d", "c", "f", "e"], dtype=object), 3)
    assert sorted(named.tolist()) == [0, 1, 3]


def shuffled(spark):
    """Bytes that all stages so far have dealt out."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_descent_deals_out_bytes_of_vectors(spark):
    """A vector meets each node that lists it, as a byte for each component: with floats it was 1.5 times what is allowed here."""
    n, dim = 600, 256
    units = clustering.unit_residuals(vectors_of(spark, n, dim).withColumnRenamed("chunk_id", "id"), center=False).localCheckpoint()
    before = shuffled(spark)
    made = nn_descent.graph(units, 5, pool=8, leaf=32, trees=2, sample=6, rounds=4, stop=0.0)
    after = shuffled(spark)
    assert made.rounds == 4 and sum(after[i] for i in after.keys() - before.keys()) < n * made.rounds * 8 * dim


def test_descent_ranks_by_the_vectors_themselves(spark):
    """Cosines that bytes can't tell apart, and vectors that aren't finite."""
    rng = np.random.default_rng(8)
    x = np.r_[np.ones((1, 16)), np.ones((40, 16)) + rng.standard_normal((40, 16)) * 1e-4]
    rows = [(k, [float(c) for c in v / np.sqrt((v * v).sum())]) for k, v in enumerate(x)]
    rows += [(50, [float("nan")] + [0.5] * 15), (51, [float("inf")] * 16)]
    units = spark.createDataFrame(rows, "id long, unit array<double>")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(nn_descent.graph(units, 5, pool=41).edges) == key(clustering.knn_edges(units.where("id < 50"), 5, -1.0))


def test_descent_of_odd_tables(spark):
    kind = "id long, unit array<float>"
    assert nn_descent.graph(spark.createDataFrame([], kind)).edges.count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], kind)
    assert sorted((r["src"], r["dst"]) for r in nn_descent.graph(odd).edges.collect()) == [(1, 4), (4, 1)]
    with pytest.raises(ValueError):
        nn_descent.graph(spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0])], kind))


def random_edges(n, m, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, w) for a, b in sorted(pairs) for w in [rng.choice([0.25, 0.5, rng.random()])]]


@pytest.mark.parametrize("iters", [1, 2, 20])
def test_wavefronts_are_sweeps(spark, iters):
    both = [x for a, b, w in random_edges(40, 70, iters) for x in ((a, b, w), (b, a, w))]
    got = {r["id"]: r["root"] for r in propagation.propagate(spark.createDataFrame(both, "src long, dst long, w double"), iters).collect()}
    src, dst, w = (np.array(x) for x in zip(*both, strict=True))
    want = clustering.propagate(40, src, dst, w, iters)
    assert got == {i: int(want[i]) for i in set(src.tolist())}


def test_levels_are_longest_chains(spark):
    chain = spark.createDataFrame([(1, 2), (2, 1), (2, 5), (5, 2), (1, 5), (5, 1), (7, 9), (9, 7)], "src long, dst long")
    assert {r["node"]: r["level"] for r in propagation.levels(chain).collect()} == {1: 0, 2: 1, 5: 2, 7: 0, 9: 1}
    assert propagation.propagate(spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def test_clusters_of_large_components(spark):
    points = vectors_of(spark, 60, 8, spread=0.4).select(F.col("chunk_id").alias("id"), "embedding")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(clustering.cluster(points, 4, 0.3, most_edges=20, max_iters=4)) == key(clustering.cluster(points, 4, 0.3, max_iters=4))
    assert key(clustering.cluster(points, 4, 0.3, exact=False)) == key(clustering.cluster(points, 4, 0.3))


# --- bitmaps -----------------------------------------------------------------------------------------------------------


def test_bitmaps_keep_what_filters_keep(spark):
    rng = random.Random(6)
    rows = [(k * 37, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c"])) for k in range(3000)]
    documents = bitmaps.numbered(spark.createDataFrame(rows, "document_id long, type string, source string").repartition(7))
    assert [r["number"] for r in documents.orderBy("document_id").collect()] == list(range(3000))
    wide = documents.withColumn("number", F.col("number") * 50)  # several buckets
    values = wide.select("number", F.lit("type").alias("field"), F.col("type").alias("value")).unionByName(wide.select("number", F.lit("source").alias("field"), F.col("source").alias("value")))
    maps = bitmaps.build(values)
    for types, sources in ((("fr",), ("a", "c")), ((), ("b",)), (("en", "fr"), ()), (("de",), ("a",))):
        allowed = bitmaps.matching(maps, {"type": types, "source": sources})
        want = {i for i, t, s in rows if (not types or t in types) and (not sources or s in sources)}
        for most in (1 << 20, 0):
            got = bitmaps.kept(wide, allowed, most)
            assert sorted(r["document_id"] for r in got.collect()) == sorted(want)
            assert got.columns == wide.columns
    with pytest.raises(ValueError):
        bitmaps.matching(maps, {"type": ()})
    assert bitmaps.numbered(documents.drop("number").where("false")).count() == 0


def test_bitmaps_of_odd_rows(spark):
    rows = [("f", "v", 0), ("f", "v", 0), ("f", None, 1), (None, "v", 2), ("f", "v", None), ("f", "v", 40_000)]
    allowed = bitmaps.matching(bitmaps.build(spark.createDataFrame(rows, "field string, value string, number long")), {"f": ("v",)})
    numbers = spark.createDataFrame([(0,), (1,), (2,), (40_000,), (32_768,), (None,)], "number long")
    assert sorted(r["number"] for r in bitmaps.kept(numbers, allowed).collect()) == [0, 40_000]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_approximate_queries_against_all_pairs(spark):
    """The registered queries on whole tables: nine tenths of what comparing all pairs gives."""
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(np.float64)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 100 == 0) for j in np.argsort(away[i], kind="stable")[:10]}
    got = queries_index.vector_cells(spark, SMALL).collect()
    assert len(got) == len(want) and len({(r["query_id"], r["id"]) for r in got} & want) >= 0.9 * len(want)
    exact = {(r["src"], r["dst"]): r["w"] for r in queries.knn_graph(spark, SMALL).collect()}
    made = {(r["src"], r["dst"]): r["w"] for r in queries_index.knn_descent(spark, SMALL).collect()}
    assert len(made.keys() & exact.keys()) >= 0.9 * len(exact)
