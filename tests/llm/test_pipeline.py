import random
from collections import Counter
from hashlib import md5
from itertools import combinations
from zlib import crc32

import pytest
import sentencepiece
import xxhash
from test_models import plain_grams
from test_texts import plain_targets

import corpus_pipeline
from quern.llm import sentencepiece_codec, shingle_dedup, simhash
from quern.llm.common import materialise

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOC)


def test_copies_are_no_boilerplate(spark):
    """Copies that are a third of a source keep their text; a header of its distinct pages goes."""
    page = "the first line of a page that is copied\nand its second line"
    rows = [(k, f"site header\nwords of page {k}\nmore of page {k}", "a") for k in range(40)] + [(100 + k, page, "a") for k in range(20)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate_lines(spark, docs(spark, rows), "").collect()}
    assert got == {**{k: f"words of page {k}\nmore of page {k}" for k in range(40)}, **{100 + k: page for k in range(20)}}


def test_copies_do_not_hide_boilerplate(spark):
    """A line on 5 of 60 distinct pages goes, though copies of another page make the source larger."""
    rows = [(k, f"site header\nwords of page {k}" if k < 5 else f"words of page {k}", "a") for k in range(60)] + [(100 + k, "copied", "a") for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate_lines(spark, docs(spark, rows), "").collect()}
    assert len(got) == 120 and all(got[k] == f"words of page {k}" for k in range(60))


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_classes(rows):
    sets, root = [runs(t) for _, t, _ in rows], {i: i for i, _, _ in rows}
    pairs = [(rows[a][0], rows[b][0]) for a, b in combinations(range(len(rows)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def copies():
    """Texts of 120 words; copies with none to 12 words changed, of which a few changes keep them near and more do not."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(12)]
    rows = [(k, " ".join(b), "s") for k, b in enumerate(base)]
    for k in range(150):
        b = list(base[k % 12 if k % 2 else 0])
        for at in rng.sample(range(120), k % 13):
            b[at] = f"x{k}"
        rows.append((100 + k, " ".join(b).upper() if k % 3 else " ".join(b), "s"))
    return [*rows, (300, "", "s"), (301, " \n", "s"), (302, "one two", "s"), (303, "One  TWO", "s")]


@pytest.mark.parametrize("tile", [65_536, 500])
def test_shingle_classes_match_brute_force(spark, tile):
    rows = copies()
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs(spark, rows), tile=tile).collect()}
    want = brute_classes(rows)
    assert got == want and 20 < len(set(want.values())) < 150


def test_classes_join_both_kinds_of_links(spark):
    """Links by fingerprints alone and by sets alone make one class."""
    rows = copies()
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.with_fingerprints(docs(spark, rows), radius=14).collect()}
    sets = brute_classes(rows)
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), words=5, radius=14).collect()}
    root = {i: i for i in sets}
    while any(root[i] != root[c[i]] for c in (sets, prints) for i in c):
        for c in (sets, prints):
            for i in c:
                root[i] = root[c[i]] = min(root[i], root[c[i]])
    assert got == root and len(set(root.values())) < len(set(sets.values()))


def test_a_group_whose_first_set_is_unlike_the_others(spark):
    """Tiles of a few sets, and classes that only pairs of tiles join."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):  # a chain: each text shares its start with the last one's end
        rows.append((k, " ".join(words[k : k + 60] if k < 40 else rng.sample(words, 60)), "s"))
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs(spark, rows), tile=200, tile_rows=4).collect()}
    assert got == brute_classes(rows)


def test_near_copies_beyond_three_bits_go(spark):
    rows = copies()
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()}
    assert got == set(brute_classes(rows).values())


def test_shingle_classes_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "alone"), (9, None), (8, ""), (7, "another text of this id")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in shingle_dedup.near_duplicates(df).collect()))
    assert got == [(0, 0), (0, 7), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert shingle_dedup.near_duplicates(df.where("false")).count() == 0


def plain_language(rows):
    """Documents with a letter, of which long ones share n-grams with a language that was learned."""
    counts = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    rates = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    held = {k: {g for g, x in c.items() if x >= 1e-5 and x >= 0.2 * max(o.get(g, 0) for o in rates.values())} for k, c in rates.items()}

    def known(text):
        grams = plain_grams(text)
        return len(text) < 100 or max(sum(g in h for g in grams) / len(grams) for h in held.values()) >= 0.1

    return [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"]) and known(r["text"])]


def plain_lines(rows):
    pages, on = Counter(), Counter()
    for source, text in {(r["source"], r["text"]) for r in rows}:
        pages[source] += 1
        on.update({(source, x.strip(" \t\r\f\v")) for x in text.split("\n")} - {(source, "")})
    bad = {k for k, n in on.items() if n > 0.05 * pages[k[0]] and n >= min(5, max(2, pages[k[0]]))}
    out = []
    for r in rows:
        kept = [x for x in r["text"].split("\n") if (r["source"], x.strip(" \t\r\f\v")) not in bad]
        if len(kept) == r["text"].count("\n") + 1 or "\n".join(kept).strip(" \t\r\n\f\v"):
            out.append(r | {"text": "\n".join(kept)})
    return out


def plain_near(rows):
    words = {r["doc_id"]: r["text"].encode().lower().split() for r in rows}
    shingles = {i: [b" ".join(w[k : k + 5]) for k in range(len(w) - 4)] or [b" ".join(w)] for i, w in words.items()}
    sets = {i: set(x) for i, x in shingles.items()}
    prints = {i: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for i, hs in ((i, [xxhash.xxh64_intdigest(x, 42) for x in xs]) for i, xs in shingles.items())}
    root = {i: i for i in words}
    pairs = [(a, b) for a, b in combinations(words, 2) if (prints[a] ^ prints[b]).bit_count() <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if root[r["doc_id"]] == r["doc_id"]]


def plain_mix(rows):
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    targets = plain_targets({s: sum(size[r["doc_id"]] for r in own) for s, own in by.items()})
    out = []
    for source, own in by.items():
        whole = sum(size[r["doc_id"]] for r in own)
        epochs, left = divmod(int(targets[source]), whole) if whole else (0, 0)
        for r in sorted(own, key=lambda r: md5(f"17:{r['doc_id']}".encode()).hexdigest()):
            n = size[r["doc_id"]]
            taken = epochs * n + max(0, min(n, left))
            left -= n
            out += [r] * (-(-taken // n) if n else 0)
    return out


def test_the_pipeline_by_plain_loops(spark):
    """Every stage's rows on a whole table, and the ids of the last one."""
    sf = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], (plain_language, plain_lines, plain_near, plain_mix), strict=True):
        found, before = materialise(stage(spark, found, sf)), rows
        rows = plain(rows)
        assert found.columns == list(corpus_pipeline.COLUMNS)
        assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted((r["doc_id"], r["text"]) for r in rows), name
        assert rows != before or name in ("language_id", "line_dedup")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.vocabulary())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((r["doc_id"], library.encode(r["text"])) for r in rows)
    assert all(r["same"] and r["n_ids"] == len(r["ids"]) for r in got)
