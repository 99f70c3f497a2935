import random
from fractions import Fraction
from itertools import combinations, product

import duckdb
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import ann, embed_dedup, html_text, langid, line_dedup, mixing, quality, queries, sentencepiece_codec, shingle_dedup, simhash, textmodel, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOC)


# --- SimHash ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) > len(sh))


@settings(deadline=None)
@given(st.text("aBc É\t\n\x0b x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    text = " ".join(f"w{k % 13}" for k in range(200))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def texts():
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(150)] for _ in range(25)]
    rows = [(k, " ".join(b), f"s{k % 3}") for k, b in enumerate(base)]
    for k in range(60):  # near copies of every kind, and exact ones
        b = list(base[k % 10])
        if k % 3:
            b[rng.randrange(150)] = f"x{k}"
        rows.append((100 + k, " ".join(b).upper() if k % 2 else " ".join(b), "s0"))
    return rows + [(300, None, None), (301, "", "s1"), (302, "one two", "s1"), (303, "One  TWO", "s1"), (304, " \t", "s2")]


def brute_components(fps):
    root = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_duplicates_match_brute_force(spark, tile):
    rows = texts()
    got = simhash.near_duplicates(docs(spark, rows), tile=tile).select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("h"), "component_id").collect()
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["h"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(fps)


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 8])
def test_links_of_single_bits(spark, parts):
    """Fingerprints a few bits apart, wherever the bits are, and chains of them."""
    rng = random.Random(9)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.append(f)
        for n in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, id long")
    from quern.llm.common import components

    got = {r["node"]: r["root"] for r in components(simhash.links(df, tile=5, parts=parts)).collect()}
    assert got == {k: r for k, r in brute_components(dict(enumerate(fps))).items() if k != r}


def test_parts_grow_with_the_fingerprints():
    assert [simhash.parts_for(n) for n in (0, 200_000, 2_000_000, 10**7, 10**10)] == [2, 2, 3, 4, 8]
    for parts in (1, 2, 4, 6):
        steps = simhash._steps(parts, 3)
        assert len(set(steps)) == len(steps) and steps[0] == 0 and 2 * len(steps) - 1 == sum(1 for x in product(range(-3, 4), repeat=parts) if sum(map(abs, x)) <= 3)


def test_registered_simhash(spark):
    """The registered query on a whole table against brute force."""
    got = queries.op8_simhash_dedup(spark, "/root/testdata/sf0.01").collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}


def test_keep_one(spark):
    rows = [*texts(), (2, texts()[2][1], "s2"), (None, "alone here with no id", "s"), (None, "alone here with no id", "s"), (None, texts()[3][1], "s")]
    got = simhash.keep_one(docs(spark, rows)).collect()
    roots = brute_components({i: plain_fingerprint(t) for i, t, _ in rows if i is not None})
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(set(roots.values()))
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_near_duplicates_of_null_ids(spark):
    rows = [(None, "a b c d", "s"), (7, "a b c d", "s"), (None, "quite another text than that", "s")]
    got = sorted((r["doc_id"] is None, r["component_id"] or 0) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [(False, 7), (True, 0), (True, 7)]


# --- mixing ----------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, cut at twice the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, target, free = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= 2 * sizes[s]
        free -= over
    return target


def mixed(spark, rows):
    return mixing.mix(docs(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", None, "z", "zero"][: 3 + 2 * seed]
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), "a" if rng.random() < 0.4 else rng.choice(names)) for k in range(700)]
    rows = [(i, "" if s == "zero" else t, s) for i, t, s in rows] + [(900, None, "a")]
    got = mixed(spark, rows)
    assert len(got) == len(rows) and mixed(spark, rows) and sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - float(want[s])) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_mix_is_the_sql(spark):
    rng = random.Random(8)
    rows = [(k // 2 if k < 20 else k, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a", "b", None])) for k in range(300)] + [(None, "x y z", "a")] * 3
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, s, t) for i, t, s in rows])
    want = con.execute(queries.OP2_SQL).fetchall()
    got = mixing.mix(docs(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_mix_edges(spark):
    assert mixed(spark, []) == []
    assert [(r["size"], r["taken"], r["target"]) for r in mixed(spark, [(1, None, None), (2, " ", "a")])] == [(0, 0, 0.0)] * 2
    same = mixed(spark, [(1, "a b c d", "s")] * 8)
    assert {r["taken"] for r in same} == {6}  # 48 words of 32, shared alike by rows that can't be told apart


def test_mixed_documents(spark):
    rows = [(k, "w " * (k % 7), "ab"[k % 2]) for k in range(60)]
    df = docs(spark, rows).withColumn("size", F.lit("own"))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixed(spark, rows)}
    got = mixing.mixed_documents(df).collect()
    assert got[0]["size"] == "own"
    for i, (t, n) in taken.items():
        assert sum(r["doc_id"] == i for r in got) == (-(-t // n) if n else 0)


# --- lines -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("copies", [False, True])
def test_lines_match_brute_force(spark, copies):
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice(["head", " foot ", "", f"text {k} {j}", "rare", "text 5"]) for j in range(rng.randrange(1, 8))), "a" if k < 70 else rng.choice(["b", None])) for k in range(140)]
    rows += [(500, None, "a"), (501, "", "a"), (502, "head", "a"), (502, "head", "a")]
    rows += [(600 + k, "one page\nthat is copied", "c") for k in range(30)] + [(700 + k, f"small site\n{k}", "d") for k in range(2)] + [(800, "alone\nhere", "e")]
    got = line_dedup.drop_site_lines(docs(spark, rows), max_ratio=0.3, min_pages=4, copies=copies).collect()
    pages, seen = {}, {}
    for t, s in [(t, s) for _, t, s in rows] if copies else {(t, s) for _, t, s in rows}:
        if t is not None:
            pages[s] = pages.get(s, 0) + 1
            for x in {x.strip() for x in t.split("\n")} - {""}:
                seen[s, x] = seen.get((s, x), 0) + 1
    bad = {k for k, n in seen.items() if n >= min(4, max(2, pages[k[0]])) and n > 0.3 * pages[k[0]]}
    want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip()) not in bad)) for i, t, s in rows)
    assert sorted((r["doc_id"], r["text"]) for r in got) == want
    assert bad and all(r["n_dropped"] == 0 for r in got if r["text"] is None)
    assert ("d", "small site") in bad and ("e", "alone") not in bad and (("c", "one page") in bad) == copies
    assert line_dedup.drop_site_lines(docs(spark, [])).count() == 0


def test_lines_are_the_sql(spark):
    """Sites of any size, a group of copies that is a third of its site, and repeated rows."""
    rng = random.Random(3)
    rows = [(k, "\n".join([*(["head "] if k % 3 else []), f"text {k}", *(["\tfoot"] if k % 30 == 0 else []), ""]), "big") for k in range(200)]
    rows += [(300 + k, "the copied page\nand its lines", "big") for k in range(100)]
    rows += [(500 + k, f"menu\n{rng.random()}", f"site {k % 9}") for k in range(14)] + [(600, None, "big"), (601, "", None), (602, "x\r\nx", None), (602, "x\r\nx", None), (None, "menu\nz", "site 1")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, s, t) for i, t, s in rows])
    want = con.execute(queries.OP5_SQL).fetchall()
    out = line_dedup.drop_site_lines(docs(spark, rows))
    got = out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long"), F.md5("text")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(w[2] for w in want) > 130
    assert {r["text"] for r in out.where("doc_id between 300 and 399").collect()} == {"the copied page\nand its lines"}


def test_lines_of_a_very_long_text(spark):
    rows = [(k, "top\n" + "".join(f"line {j} of {k}\n" for j in range(100_000 if k == 0 else 3)), "s") for k in range(8)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_site_lines(docs(spark, rows)).collect()}
    assert got == {0: (100_002, 1), **{k: (5, 1) for k in range(1, 8)}}


# --- tables of odd columns ---------------------------------------------------------------------------------------

CLASHES = "_site _lines _kept _source _epochs _cut _part _again _own_size size labelled y id v d t key bucket sig fp bands root component_id _id _id_ _both _found line pages n part lang text2".split()
OPERATORS = {
    "mix": lambda df: mixing.mix(df.drop("size")),
    "mixed_documents": lambda df: mixing.mixed_documents(df),
    "encode": lambda df: sentencepiece_codec.round_trip(df, sentencepiece_codec.vocabulary()),
    "language": lambda df: langid.predict(df, langid.train(df)),
    "lines": lambda df: line_dedup.drop_site_lines(df),
    "simhash": lambda df: simhash.near_duplicates(df),
    "shingles": lambda df: shingle_dedup.with_fingerprints(df),
    "keep_one": lambda df: simhash.keep_one(df),
    "quality": lambda df: quality.score(df, quality.train(df, df.select("doc_id", F.lit(1).alias("quality"), "y")), host_col="source", path_col="lang"),
    "toxicity": lambda df: toxicity.predict(df, toxicity.train(df, df.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), "y", "text"))),
    "html": lambda df: html_text.extract(df.withColumnRenamed("text", "html"), model=html_text.Labeller(2, 1)),
    "embeddings": lambda df: embed_dedup.near_duplicates(df.withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double"))), "doc_id"),
    "neighbours": lambda df: ann.search((e := df.withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double")))), e, "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_and_empty_tables(spark, name):
    """Columns by the operators' own names stay as they were; an empty table gives an empty result with the same columns."""
    df = docs(spark, [(k, f"some words of text {k // 2}\nand a line", "s") for k in range(12)]).drop("lang", "n_chars")
    df = df.select("*", *(F.lit(f"<{c}>").alias(c) for c in CLASHES))
    out = OPERATORS[name](df)
    rows = out.collect()
    assert len(rows) > 0
    if name not in ("simhash", "shingles", "quality", "embeddings", "neighbours"):  # these return columns of their own alone
        kept = [c for c in CLASHES if c != "size" or name == "mixed_documents"]
        assert {tuple(r[c] for c in kept) for r in rows} == {tuple(f"<{c}>" for c in kept)}
    empty = OPERATORS[name](df.where("false"))
    assert empty.columns == out.columns and empty.count() == 0


def test_output_columns_that_are_there_already(spark):
    df = docs(spark, [(1, "x", "s")])
    for name, act in {"taken": mixing.mix, "N_lines": line_dedup.drop_site_lines, "score": lambda d: toxicity.predict(d, textmodel.Linear(0.0, {})), "lang_pred": lambda d: langid.predict(d, langid.build([], [], 4, 1))}.items():
        with pytest.raises(ValueError, match=name.lower()):
            act(df.withColumn(name, F.lit(0)))
