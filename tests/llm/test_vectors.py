import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, embed_dedup, queries

rng = np.random.default_rng(1)
SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def table(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], 0, 0.5) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def units(x):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ODD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]


def test_hadamard():
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


def brute_neighbours(x, q, k=5):
    s = units(x) @ units(x).T
    np.fill_diagonal(s, -9)
    return s, {i: set(np.argsort(-s[i], kind="stable")[:k].tolist()) for i in q}


def checked(got, x, ids):
    """Ranks, order and scores are right; returns the recall at 5."""
    s, want = brute_neighbours(x, ids)
    hits = 0
    for q in ids:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(sc - s[q, v]) < 1e-12 for _, v, sc in mine)
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits += len({m[1] for m in mine} & want[q])
    return hits / (5 * len(ids))


def test_search_recall_and_scores(spark):
    x = rng.standard_normal((800, 16))
    x[700:] = x[:100] + 0.1 * rng.standard_normal((100, 16))
    df = table(spark, x)
    assert checked(ann.search(df, df.where("vec_id % 50 = 0"), chunk=64, bin_rows=100).collect(), x, range(0, 800, 50)) >= 0.9


def test_search_joins_rotations(spark):
    """Buckets of about 4 rows: two rotations to a table, and a recall near what was asked for, by looking at a part of the rows."""
    r = np.random.default_rng(3)
    centre = r.standard_normal((60, 32))
    x = centre[r.integers(60, size=3000)] + 0.35 * r.standard_normal((3000, 32))
    df = table(spark, x)
    own = ann._vectors(df, "vec_id", "embedding")
    index = ann.fit(own, own.where("id % 20 = 0"), 5, 4, 4, 0.96, 128, 11)
    t = index[32]
    assert (t.rotations, t.sampled) == (2, 128) and 0.95 <= t.recall < 1 and t.probe < t.listed / 4
    got = ann.search(df, df.where("vec_id % 20 = 0"), bucket_rows=4, index=index).collect()
    assert checked(got, x, range(0, 3000, 20)) >= 0.92


def test_registered_search(spark):
    """The registered query on a whole table against brute force."""
    got = queries.op1_nearest_neighbours(spark, "/root/testdata/sf0.01").collect()
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    assert e["vec_id"].tolist() == list(range(len(e)))
    assert checked(got, np.stack(e["embedding"]), [i for i in e["vec_id"] if i % 50 == 0]) >= 0.9


def test_search_lists_the_nearest_buckets_first():
    t = ann.tables_for(100_000, 16, 3, 16, 5)
    assert t.rotations > 1 and t.cells * 16 >= 100_000
    q = units(rng.standard_normal((4, 16)))
    few, many = t.probes(q, 40), t.probes(q, 400)
    assert (few == many[:, :40]).all() and all(len(set(p)) == 400 for p in many.tolist())
    assert all(set(b) <= set(p[: 3 * 40]) for b, p in zip(t.buckets(q).tolist(), many.tolist(), strict=True))


def test_search_by_length(spark):
    """Each query meets vectors of its own length, whichever is common."""
    rows = [[1.0, 0.1 * k, 0.0, 0.0] for k in range(8)] + [[1.0, 0.1 * k] for k in range(4)] + [[1.0] * 7]
    df = table(spark, rows).withColumns({"d": F.lit("x"), "bucket": F.lit("y"), "query": F.lit(1)})
    got = ann.search(df, df.where("vec_id in (0, 8, 12)"))
    by = {q: [r["vec_id"] for r in got.orderBy("rank").collect() if r["query_id"] == q] for q in (0, 8, 12)}
    assert by == {0: [1, 2, 3, 4, 5], 8: [9, 10, 11], 12: []}


def test_search_odd_rows_and_ties(spark):
    base = [1.0] + [0.0] * 15
    vectors = [base, base, base, [0.9, 0.1] + [0.0] * 14, [float(k == 5) for k in range(16)], *ODD, [1.0] * 3, base]
    ids = [10, 3, 3, 7, 8, 20, 21, 22, 23, 24, 25, 26, None]
    df = table(spark, vectors, ids)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id in (10, 20, 21)"), recall=1.0).orderBy("rank").collect()]
    assert [g[1] for g in got] == [3, 7, 8] and got[0][2] == 1.0
    assert ann.search(df.where("false"), df).count() == 0
    assert ann.search(df.where("vec_id = 10"), df.where("vec_id = 10")).count() == 0


def brute_links(x, least=0.95):
    u = units(x)
    s = u @ u.T >= least
    np.fill_diagonal(s, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(s, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return s.sum(axis=1), root
        root = new


@pytest.mark.parametrize("chunk", [1024, 8])
def test_dedup_matches_brute_force(spark, chunk):
    x = rng.standard_normal((260, 16))
    x[100:160] = x[0] + 0.05 * rng.standard_normal((60, 16))  # a large group
    x[160:200] = x[40:80] + 0.05 * rng.standard_normal((40, 16))  # pairs
    x[200:230] = x[5]  # copies
    n, root = brute_links(x)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table(spark, x), chunk=chunk, bin_rows=50).collect()}
    assert [got[k]["n_links"] for k in range(260)] == n.tolist()
    assert [got[k]["component_id"] for k in range(260)] == root.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_dedup_recall_at_the_threshold(spark):
    """Registered parameters: pairs of 64 dimensions at cosines from 0.95 to 1, and just below."""
    r = np.random.default_rng(12)
    x = units(r.standard_normal((1200, 64)))
    noise = r.standard_normal((600, 64))
    noise = units(noise - (noise * x[:600]).sum(axis=1, keepdims=True) * x[:600])
    cos = np.r_[np.linspace(0.951, 0.96, 300), np.linspace(0.96, 1, 200), np.linspace(0.93, 0.949, 100)]
    x[600:] = cos[:, None] * x[:600] + np.sqrt(1 - cos**2)[:, None] * noise
    df = table(spark, x)
    n, root = brute_links(x)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    right = sum(got[k]["component_id"] == root[k] and got[k]["n_links"] == n[k] for k in range(600, 1200))
    assert sum(n) == 1000 and right >= 590 and all(got[k]["n_links"] <= n[k] for k in range(1200))


def test_dedup_of_signed_zeros(spark):
    df = table(spark, [[0.0, 1.0], [-0.0, 1.0], [1.0, -0.0], [2.0, 0.0]])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2)}


def test_dedup_sizes_grow_with_the_logarithm():
    few, many = embed_dedup.sizes(50_000, 0.95, 2.0, 0.03, 0.005), embed_dedup.sizes(50_000_000, 0.95, 2.0, 0.03, 0.005)
    assert few[1] < many[1] < 2 * few[1] and few[0] < many[0] < 5 * few[0]
    r = np.random.default_rng(2)
    a, b = r.standard_normal(200_000) * 0.3, r.uniform(0, 2, 200_000)
    assert embed_dedup.together(0.3, 2.0) == pytest.approx(float((np.floor((a + b) / 2) == np.floor(b / 2)).mean()), abs=0.005)


def test_registered_dedup(spark):
    got = queries.op6_embedding_dedup(spark, "/root/testdata/sf0.01").collect()
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    n, root = brute_links(np.stack(e["embedding"]))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (a, e["vec_id"].iloc[b]) for i, a, b in zip(e["vec_id"], n, root, strict=True)}


def test_dedup_odd_rows(spark):
    base = [1.0] + [0.0] * 15
    df = table(spark, [base, base, *ODD, [1.0, 0.0], base, base], [4, 2, 20, 21, 22, 23, 24, 25, 26, None, 2])
    got = embed_dedup.near_duplicates(df).collect()
    assert len(got) == 11
    by = {r["vec_id"]: r for r in got}
    assert (by[4]["n_links"], by[4]["component_id"], by[4]["kept"]) == (2, 2, False)
    assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] == 2] == [(2, 2)] * 2
    assert all((by[k]["n_links"], by[k]["component_id"], by[k]["kept"]) == (0, k, True) for k in range(20, 27))
    assert (by[None]["n_links"], by[None]["component_id"]) == (0, None)
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_proper(spark):
    got = {r["vec_id"]: r["ok"] for r in table(spark, [*ODD, [1.0]]).select("vec_id", ann.proper(F.col("embedding")).alias("ok")).collect()}
    assert got == {**dict.fromkeys(range(6), False), 6: True}


def test_search_counts_ids_not_rows(spark):
    """Ids stored 12 times each, in one bucket: its k nearest ids are found, not k rows of the nearest."""
    x = np.tile(np.random.default_rng(7).standard_normal(16), (7, 1))
    x[:, 1] += 0.01 * np.arange(7)
    df = table(spark, np.repeat(x, 12, axis=0), np.repeat(np.arange(7), 12))
    got = ann.search(df, df.where("vec_id = 0").limit(1), tables=1, index={16: ann.Tables(16, 1, 1, 16, 11, probe=1)}).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_probes_follow_the_recall():
    """Tables for a hundred million rows whose nearest rows are no nearer than chance has it, which the first 4,096 buckets of a table don't hold often enough."""
    r = np.random.default_rng(8)
    t = ann.tables_for(100_000_000, 64, 4, 512, 11)
    q = units(r.standard_normal((24, 64)))
    side = r.standard_normal((24, 5, 64))
    side -= (side * q[:, None]).sum(axis=2, keepdims=True) * q[:, None]
    near = (0.45 * q[:, None] + np.sqrt(1 - 0.45**2) * side / np.linalg.norm(side, axis=2, keepdims=True)).reshape(-1, 64)
    ids, by = np.arange(24), np.repeat(np.arange(24), 5)
    assert (ann.first_lists(t, ids, q, by, near) < t.listed).mean() < 0.95
    fitted = ann.reaching(t, ids, q, by, near, 0.97)
    assert fitted.recall >= 0.97 and fitted.most > t.most and fitted.probe < fitted.tables * fitted.cells


def test_fit_is_measured_on_other_rows(spark):
    x = rng.standard_normal((600, 16))
    own = ann._vectors(table(spark, x), "vec_id", "embedding")
    asked = own.where("id % 50 = 0")
    drawn = ann._drawn(own, asked, 90, 11)
    assert len(drawn) == 90 and not set(drawn["id"]) & set(range(0, 600, 50))
    t = ann.fit(own, asked, 5, 4, 16, 0.95, 60, 11)[16]
    assert (t.sampled, t.measured) == (60, 30) and t.held_out >= 0.88
    assert len(ann._drawn(asked, asked, 90, 11)) == 12


def test_links_against_sql(spark, tmp_path):
    """The registered SQL, over all pairs, on vectors with near copies, chains, and rows that take no part."""
    import duckdb

    r = np.random.default_rng(12)
    x = [v for c in r.standard_normal((12, 16)) for v in (c, c + 0.05 * r.standard_normal(16), c + 0.12 * r.standard_normal(16), 3 * c)]
    df = table(spark, [*x, *ODD])
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/e/*.parquet')")
    want = con.execute(queries.oracle_sql()["op6_embedding_dedup"]).fetchall()
    got = embed_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(n for _, n, _, _ in want) > 50
