"""Periodic runs, ranked search and bottom-k sketches against plain loops."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import bottom_k, periodic_runs, queries, ranked_search

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)


# --- periodic runs -------------------------------------------------------------------------------------------------


def plain_runs(w, min_exp=4, min_length=6):
    """Runs by their definition: the smallest period of each maximal stretch."""
    found = {}
    for p in range(1, len(w) // min_exp + 1):
        k = 0
        while k < len(w) - p:
            if w[k] != w[k + p]:
                k += 1
                continue
            s = k
            while k < len(w) - p and w[k] == w[k + p]:
                k += 1
            if k - s + p >= max(min_length, min_exp * p):
                found.setdefault((s, k - s + p), p)
    return sorted((s, p, n) for (s, n), p in found.items())


def plain_collapsed(w, runs):
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def has_period(w, s, n, q):
    return all(w[i] == w[i + q] for i in range(s, s + n - q))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(2, 5))
def test_runs_of_few_words(w, min_exp):
    runs = periodic_runs.primitive(periodic_runs.lag_runs(periodic_runs.word_ids(w), 1, len(w) + 1, min_exp))
    assert [(s, p, n) for s, n, p in runs.tolist()] == plain_runs(w, min_exp)
    for s, n, p in runs.tolist():
        assert has_period(w, s, n, p) and not any(has_period(w, s, n, q) for q in range(1, p))
        assert s == 0 or w[s - 1] != w[s - 1 + p]
        assert s + n == len(w) or w[s + n] != w[s + n - p]


def test_runs_of_long_texts_by_ranges():
    rng = random.Random(5)
    w = [f"w{rng.randrange(40)}" for _ in range(400)]
    w += (w[:37] * 6)[:190] + ["x"] * 50 + [f"w{rng.randrange(3)}" for _ in range(900)] + ["y", "z"] * 30
    ids, n = periodic_runs.word_ids(w), len(w)
    cut = periodic_runs.ranges(n, 4, 16, 64)
    assert cut[0][0] == 1 and cut[-1][1] == n // 4 + 1 and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    found = np.concatenate([periodic_runs.lag_runs(ids, a, b) for a, b in cut])
    assert [(s, p, k) for s, k, p in periodic_runs.primitive(found).tolist()] == plain_runs(w)
    assert len(periodic_runs.ranges(10**6, 4, 2048, 64)) <= 64


def odd_texts():
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (6, "a\x0bb " * 4), (7, "é x " * 9), (None, "b b b b b b b"), (5, "a a a a a a")]
    rows += [(10 + k, " ".join(rng.choice("abc") for _ in range(300))) for k in range(5)]
    return [*rows, (30, " ".join(f"w{k % 2300}" for k in range(11_000))), (31, "q " * 12_000)]


@pytest.mark.parametrize("long_words", [8192, 100, 1])
def test_collapse(spark, long_words):
    rows = odd_texts()
    if long_words == 1:
        rows = [r for r in rows if len(r[1] or "") < 1000]
    df = docs(spark, rows).withColumn("_key", F.lit("kept"))
    got = periodic_runs.collapse(df, long_words=long_words, lags=8).collect()
    want = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = plain_runs(w) if len(w) < 3000 else [(0, 2300, 11_000)] if w[0] != "q" else [(0, 1, 12_000)]
        want.append((str(i), [(s, n, p) for s, p, n in runs], plain_collapsed(w, runs)))
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)
    assert {r["_key"] for r in got} == {"kept"}


def test_collapse_of_odd_tables(spark):
    assert periodic_runs.collapse(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse(docs(spark, []).withColumn("Runs", F.lit(1)))
    with pytest.raises(ValueError):
        periodic_runs.collapse(docs(spark, []), min_exp=1)


def planted(i, text):
    w, h = (text or "").encode().split(), crc32(str(i).encode())
    if h % 10 == 0 and w:
        a, g = h // 10 % len(w), h // 10
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    return w


def test_registered_runs(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        w = planted(i, text)
        runs = plain_runs(w)
        best = min(((-n, s, p) for s, p, n in runs), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
        kept = plain_collapsed([x.decode() for x in w], runs)
        assert got[i] == (len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


# --- ranked search -------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_packed_numbers(values):
    out, ends = ranked_search.packed(np.array(values, dtype=np.int64))
    assert ranked_search.unpacked(out.tobytes()).tolist() == values and len(ends) == len(values)


@settings(deadline=None)
@given(st.text("aB9é-  \x7f_Zz\n", max_size=40))
def test_terms(text):
    want = [x.translate(str.maketrans(ranked_search.UPPER, ranked_search.LOWER)) for x in re.findall(ranked_search.TERM, text)]
    assert [x.decode() for x in ranked_search.terms_of(text.encode())] == want


@settings(deadline=None, max_examples=100)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(1, 4), min_size=1), max_size=5), st.integers(1, 6), st.sampled_from([1, 3, 64]))
def test_heaps_give_the_best_sums(lists, k, span):
    cursors = [(np.array(sorted(x)), np.array([x[d] for d in sorted(x)])) for x in lists]
    sums = Counter()
    for x in lists:
        sums.update(x)
    want = heapq.nsmallest(k, ((-s, d) for d, s in sums.items()))
    assert sorted((-s, d) for s, d in ranked_search.best(cursors, k, span)) == want


def plain_search(rows, items, k=50):
    def cut(t):
        return [x.translate(str.maketrans(ranked_search.UPPER, ranked_search.LOWER)) for x in re.findall(ranked_search.TERM, t or "")]

    held = [(i, Counter(cut(t))) for i, t in rows if i is not None and cut(t)]
    n_all, terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_all // terms
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_terms", "block", "span"), [(1 << 20, 64, 1024), (50, 2, 1), (7, 1, 5)])
def test_search_matches_plain_loops(spark, shard_terms, block, span):
    rng = random.Random(4)
    words = [f"t{k}" for k in range(50)] + ["É", "straße"]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(52)], k=rng.randrange(1, 30)))) for k in range(150)]
    rows += [(200 + k, "T7 t7-t9") for k in range(8)] + [(300, None), (301, ""), (302, "-- !"), (None, "t7"), (400, "t3 " * 500)]
    items = [(1, "T7, t9"), (2, "t1 t1 t2 é É"), (3, ""), (4, None), (None, "t1"), (5, "unheard"), (6, "t40"), (6, "t41 straße")]
    df = docs(spark, rows).repartition(3).withColumn("term", F.lit(1))
    index = ranked_search.indexed(df, shard_terms=shard_terms)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("shard", F.lit(1))
    got = ranked_search.search(index, asked, k=5, block=block, span=span)
    assert sorted(map(tuple, got.collect())) == plain_search(rows, items, 5)


def test_search_of_odd_tables(spark):
    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    for rows in ([], [(1, None)], [(1, "-")]):
        assert ranked_search.search(ranked_search.indexed(docs(spark, rows)), items).count() == 0
    index = ranked_search.indexed(docs(spark, [(2, "x"), (2, "x y"), (1, "y"), (5, "z")]))
    assert [tuple(r)[:3] for r in ranked_search.search(index, items).orderBy("rank").collect()] == [("a", 1, 2), ("a", 2, 2)]
    assert ranked_search.search(index, items.where("false")).count() == 0


def test_registered_search_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()["op12_ranked_search"]).fetchall()
    assert sorted(map(tuple, queries.op12_ranked_search(spark, SMALL).collect())) == sorted(want)


# --- bottom-k sketches -----------------------------------------------------------------------------------------------


def shingles(text, words=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [None, "", " \n", "one", "One", "one two three four", "a b c d e", "A  b\tc d e", "a b c d e f g", " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(1500, 4500))]


def sketched(spark, texts, k=128):
    df = bottom_k.with_sketch(docs(spark, enumerate(texts)).withColumn("_words", F.lit(1)), k=k)
    return {r["doc_id"]: r["sketch"] for r in df.collect()}


def test_sketches(spark):
    got = sketched(spark, TEXTS)
    assert got[0] == got[1] == got[2] == [] and got[3] == got[4] and got[6] == got[7]
    for i, t in enumerate(TEXTS):
        assert len(got[i]) == min(128, len(shingles(t))) and got[i] == sorted(set(got[i]))
    every = spark.createDataFrame([(i, j, got[i], got[j]) for i in got for j in got], "i int, j int, a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    for r in every.select("i", "j", bottom_k.resemblance(a, b).alias("r"), bottom_k.containment(a, b).alias("c"), bottom_k.distinct_count(a).alias("n"), bottom_k.written(a).alias("w")).collect():
        x, y = shingles(TEXTS[r["i"]]), shingles(TEXTS[r["j"]])
        near = 0.15 if len(x) > 128 or len(y) > 128 else 1e-12
        assert abs(r["r"] - jaccard(x, y)) <= near and abs(r["c"] - (len(x & y) / len(x) if x else 1.0)) <= near
        assert abs(r["n"] - len(x)) <= 0.3 * len(x) and re.fullmatch("([0-9a-f]{12})*", r["w"]) and len(r["w"]) == 12 * min(128, len(x))


def test_sketches_of_parts_merge(spark):
    words = [f"w{k % 700}" for k in range(2000)]
    parts = [" ".join(words[s : s + 254]) for s in range(0, 2000, 250)]  # parts share four words, so that no shingle is lost
    whole, each = sketched(spark, [" ".join(words)], 64)[0], sketched(spark, parts, 64)
    df = spark.createDataFrame([("a", each[k]) for k in each] + [("b", []), (None, each[0]), (None, None)], "key string, sketch array<long>")
    got = {r["key"]: r["sketch"] for r in bottom_k.merge(df, ["key"], k=64).collect()}
    assert got == {"a": whole, "b": [], None: each[0]}
    two = spark.createDataFrame([(each[0], each[1])], "a array<long>, b array<long>").select(bottom_k.merged(F.col("a"), F.col("b"), 64).alias("m")).first()["m"]
    assert two == sorted(set(each[0]) | set(each[1]))[:64]


def test_next_documents(spark):
    rows = [(5, "abcdefg"), (9, "xyz"), (3, None), (1, ""), (7, "é\U0001f600ü"), (9, "second"), (9, "second"), (None, "no id")]
    got = bottom_k.with_next(docs(spark, rows).withColumn("sketch", F.lit(1)).repartition(5)).collect()
    texts = {(r["doc_id"], r["n_chars"]): r["edited"] for r in got}
    assert len(got) == 8 and len({(r["doc_id"], r["edited"]) for r in got if r["doc_id"] == 9}) == 2  # equal rows get equal results
    assert texts[5, 7] == "abcd" and texts[3, 0] == texts[1, 0] == "" and texts[7, 3] == "é\U0001f600a"
    alone = bottom_k.with_next(docs(spark, [(4, "a b c d e f")])).first()
    assert alone["edited"] == "a b c a b c" and alone["next_sketch"] == alone["sketch"]
    assert bottom_k.with_next(docs(spark, [])).count() == 0


def test_registered_fingerprints(spark):
    got = {r["doc_id"]: r for r in queries.op13_document_fingerprints(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    for k, (i, t) in enumerate(rows):
        after, t, r = rows[(k + 1) % len(rows)][1] or "", t or "", got[i]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(shingles(t), shingles(edited))) < 0.2 and abs(r["near_next"] - jaccard(shingles(t), shingles(after))) < 0.2
    assert len({r["fingerprint"] for r in got.values()}) == len({frozenset(shingles(t)) for _, t in rows})


def test_no_python_in_the_fingerprints_plan(spark):
    plan = queries.op13_document_fingerprints(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
