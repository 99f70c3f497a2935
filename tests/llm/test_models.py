import math
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from layouts import LAYOUTS
from pyspark.sql import functions as F

from quern.llm import html_text, langid, quality, sentencepiece_codec, textmodel, toxicity
from quern.llm.sentencepiece_codec import BPE, NORMAL, UNIGRAM, UNKNOWN, Model

PATH = sentencepiece_codec.vocabulary()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOC)


# --- SentencePiece -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return Model.read(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ALPHABET = st.lists(st.sampled_from(list("abcdeéñ ,.\n\t日本語тест😀xyz019=-_'\"") + ["the", "tion", "  ", "ing", "▁", "\x00", "<s>", "<0x41>"]), max_size=60).map("".join)


@settings(deadline=None, max_examples=300)
@given(ALPHABET)
def test_encoding_is_the_librarys(model, library, text):
    ids = model.encode(text)
    assert model.decode(ids) == text
    if "▁" not in text:
        assert ids == list(library.encode(text))
        if text:
            assert list(model.stream("▁" + text.replace(" ", "▁"))) == ids


@settings(deadline=None, max_examples=60)
@given(st.lists(ALPHABET, max_size=12))
def test_batches_are_the_same(model, library, texts):
    batch = sentencepiece_codec.BatchEncoder(model)
    for _ in range(2):  # the second time from memory
        flat, counts = batch.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [model.encode(t) for t in texts] or not texts


def same_as_one_by_one(model, texts, batch=None):
    flat, counts = (batch or sentencepiece_codec.BatchEncoder(model)).encode(texts)
    got = np.split(flat, np.cumsum(counts)[:-1]) if texts else []
    assert [x.tolist() for x in got] == [model.encode(t) for t in texts]
    assert sentencepiece_codec.decoded(model, flat, np.r_[0, np.cumsum(counts)]) == texts


def test_batches_forget(model, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "_PLACES_KEPT", 64)
    monkeypatch.setattr(sentencepiece_codec, "_WINDOW", 20)
    batch = sentencepiece_codec.BatchEncoder(model)
    texts = [f"some words {k} and\nmore " + "x" * (k * 9) for k in range(30)]
    same_as_one_by_one(model, texts, batch)
    same_as_one_by_one(model, texts[::-1], batch)
    assert len(batch.known.hash) <= 32


def test_equal_hashes_are_told_apart(model, monkeypatch):
    """A hash that is the length alone: stretches are still compared by their characters."""
    monkeypatch.setattr(sentencepiece_codec, "_PLACES_KEPT", 1 << 12)
    batch = sentencepiece_codec.BatchEncoder(model)
    batch.power[:] = 0
    same_as_one_by_one(model, ["the cat sat on the mat", "cat tac act the eht", "a b c"], batch)


@pytest.mark.parametrize("few", [0, 8, 1000])
def test_lanes_commit_where_paths_meet(model, monkeypatch, few):
    """Stretches far longer than the window, of which some have no early boundary, side by side and one by one."""
    monkeypatch.setattr(sentencepiece_codec, "_FEW", few)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aabcdeéstn日") for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    texts += ["-" * n for n in (15, 64, 65, 200, 333)] + ["=" * 129 + "ab" * 80, "▁" * 70, "x" + "▁a" * 100]
    same_as_one_by_one(model, texts)


def test_windows_are_bounded(model, monkeypatch):
    """However long the stretches are, no more nodes are held than a few windows of them."""
    widest = 0
    real = sentencepiece_codec.BatchEncoder._extend

    def extend(self, ends, cols, codes, last, step):
        nonlocal widest
        widest = max(widest, last.shape[1])
        return real(self, ends, cols, codes, last, step)

    monkeypatch.setattr(sentencepiece_codec.BatchEncoder, "_extend", extend)
    monkeypatch.setattr(sentencepiece_codec, "_FEW", 0)
    rng = random.Random(5)
    same_as_one_by_one(model, ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(3)])
    assert widest <= 8 * model.longest + 1


def test_long_stretches(model, library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé日本") for _ in range(5000))
    assert model.encode(text) == list(library.encode(text)) and model.decode(model.encode(text)) == text


def best_path(model, text):
    """Viterbi over the whole text at once."""
    best, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    for n in range(1, len(text) + 1):
        for s in range(max(0, n - model.longest), n):
            p = text[s:n]
            if p in model.ids or n - s == 1:
                v = best[s] + model.scores.get(p, model.worst)
                if v > best[n]:
                    best[n], back[n] = v, s
    return best[-1]


@settings(deadline=None)
@given(st.text("abc", max_size=120), st.integers(0, 5))
def test_unigram_paths_are_best(text, seed):
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0, UNKNOWN)] + [(p, -rng.random() * len(p) - 0.5, NORMAL) for p in ("a", "b", "ab", "abc", "bca", "cab", "cc", "bbb")]
    m = Model(pieces, UNIGRAM, dummy_prefix=False)
    ids = list(m.stream(text))
    score, at = 0.0, 0
    for k in ids:  # an unknown character is one id
        p = text[at] if k == m.unknown else m.pieces[k]
        assert text.startswith(p, at)
        score += m.scores.get(p, m.worst)
        at += len(p)
    assert at == len(text) and score == pytest.approx(best_path(m, text))


def test_the_stream_reads_in_windows(model):
    """Ids come before the text has been read."""
    read = 0

    def letters():
        nonlocal read
        while True:
            read += 1
            yield "abcdefgh"[read % 8]

    ids = model.stream(letters())
    for _ in range(200):
        next(ids)
    assert read < 200 * model.longest


def test_models_that_change_text_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(bytes([0x1A, 2, 0x20, 1]))  # remove_extra_whitespaces
    with pytest.raises(ValueError, match="remove spaces"):
        Model.read(str(tmp_path / "m"))


def test_columns(spark):
    df = docs(spark, [(1, "the cat sat", "en"), (2, None, None), (3, "", None)]).withColumn("decoded", F.lit(1)).drop("decoded")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df, PATH), PATH).collect()}
    assert got[1][1] == "the cat sat" and got[2] == (None, None) and got[3] == ([], "")
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in sentencepiece_codec.round_trip(df, PATH).collect()} == got
    empty = sentencepiece_codec.round_trip(df.where("false"), PATH)
    assert empty.count() == 0 and empty.columns == [*df.columns, "ids", "decoded"]
    with pytest.raises(ValueError, match="ids"):
        sentencepiece_codec.encode(df.withColumn("IDS", F.lit(1)), PATH)


def test_very_long_and_repeated_texts(spark):
    long = "word another " * 60_000 + "y" * 40_000
    rows = [(1, long, "en"), (2, "short", "en"), (3, long, "en"), (4, " \n ", "en"), *((k, "short", "en") for k in range(10, 700))]
    got = {r["doc_id"]: (r["n"], r["same"]) for r in sentencepiece_codec.round_trip(docs(spark, rows), PATH).select("doc_id", F.size("ids").alias("n"), (F.col("decoded") == F.col("text")).alias("same")).collect()}
    assert len(got) == len(rows) and all(same for _, same in got.values()) and got[1] == got[3] and got[1][0] > 120_000


def test_ids_that_stand_for_nothing(spark, model):
    df = spark.createDataFrame([(1, [None, 450, -4, 99_999_999, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in sentencepiece_codec.decode(df, PATH).collect()}
    assert got == {1: model.decode([450]), 2: None, 3: ""}


def test_bpe_ties():
    m = Model([("<unk>", 0.0, UNKNOWN), ("a", -3.0, NORMAL), ("aa", -1.0, NORMAL), ("aaa", -2.0, NORMAL)], BPE, dummy_prefix=False)
    for n in range(1, 12):
        assert [m.pieces[k] for k in m.stream("a" * n)] == [t[0] for t in m._merged("a" * n)]


# --- language ----------------------------------------------------------------------------------------------------

SYLLABLES = {"aa": ["ko", "mi", "ta", "ru"], "bb": ["sch", "ung", "ein", "tz"], "cc": ["été", "eau", "oi", "ç"]}


def sentence(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(k, sentence(lang := rng.choice(list(SYLLABLES)), rng), lang) for k in range(300)]
    model = langid.train(docs(spark, rows + [(900, "x", None), (901, None, "aa")]))
    test = [(1000 + k, sentence(lang, rng, 12).upper() + " !!! 123", lang) for k, lang in enumerate(list(SYLLABLES) * 10)]
    odd = [(2000, None, "?"), (2001, "", "?"), (2002, "12 !? ...", "?"), (2003, "日本", "?"), (2004, "a", "?")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(spark, test + odd), model).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.5 for i, _, lang in test)
    assert [got[k] for k in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    commonest = model.langs[0]
    assert got[2003] == (commonest, 0.0) and got[2004][0] == commonest
    nothing = langid.train(docs(spark, []))
    assert langid.predict(docs(spark, test[:2]), nothing).select("lang_pred").distinct().collect() == [("und",)]


def test_predictions_do_not_depend_on_windows(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = [sentence(lang, rng, n) for n in (0, 1, 3, 50) for lang in SYLLABLES] + ["", "   ", "É" * 30]
    grams = []
    for lang in SYLLABLES:
        data, at = langid._flat(pa.array([sentence(lang, rng, 300)]))
        grams.append(np.unique(np.concatenate([c for _, c in langid.codes_of(data, at, 4)])))
    model = langid.build(list(SYLLABLES), grams, 4, 14)
    whole = langid.predict_texts(model, pa.array(texts))
    for size in (5, 17, 64):
        monkeypatch.setattr(langid, "_WINDOW", size)
        again = langid.predict_texts(model, pa.array(texts))
        assert again[0] == whole[0] and np.allclose(again[1], whole[1])
    sliced = pa.array(["skip", *texts]).slice(1)
    assert langid.predict_texts(model, sliced)[0] == whole[0]


def plain_grams(text, n=4):
    """n-grams of bytes of a text whose runs of other than letters are one space."""
    b = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
    b = re.sub(b" +", b" ", b)
    return [b[k : k + n] for k in range(len(b) - n + 1)]


def test_predictions_by_exact_sets(spark):
    """Languages and scores by sets of n-grams instead of filters: rates, dominance and shares by plain loops."""
    rng = random.Random(9)
    rows = [(k, sentence(lang := rng.choice(list(SYLLABLES)), rng, 25) + (" ko sch" if k % 7 == 0 else ""), lang) for k in range(200)]
    counts = {}
    for _, t, lang in rows:
        for g in plain_grams(t):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, r in c.items() if r >= 1e-5 and r >= 0.2 * max(x.get(g, 0) for x in rates.values())} for lang, c in rates.items()}
    model = langid.train(docs(spark, rows))
    test = [(1000 + k, sentence(lang, rng, 6) + sentence(rng.choice(list(SYLLABLES)), rng, 3), lang) for k, lang in enumerate(list(SYLLABLES) * 12)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(spark, test), model).collect()}
    for i, t, _ in test:
        grams = plain_grams(t)
        share = {lang: sum(g in held[lang] for g in grams) / len(grams) for lang in model.langs}
        assert got[i][1] == pytest.approx(max(share.values()), abs=0.02)
        assert share[got[i][0]] >= max(share.values()) - 0.02


def test_masks_hold_many_languages():
    names = [f"l{k}" for k in range(70)]
    model = langid.build(names, [np.array([k * 7919 + 1], dtype=np.uint64) for k in range(70)], 4, 16)
    for k in range(70):
        a, b = langid.slots(np.array([k * 7919 + 1], dtype=np.uint64), 16)
        assert int(model.masks[k // 64, a][0] & model.masks[k // 64, b][0]) >> (k % 64) & 1


# --- toxicity and quality ---------------------------------------------------------------------------------------------


def labelled(spark, rows):
    """rows: (text, label)."""
    df = docs(spark, [(k, t, None) for k, (t, _) in enumerate(rows)])
    return df, spark.createDataFrame([(k, y, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int, quality int")


def neutral(rng, n=12):
    return " ".join(rng.choice(["house", "river", "walked", "bread", "green", "seven", "table", "music"]) for _ in range(n))


def test_toxicity_and_neutral_mentions(spark):
    rng = random.Random(6)
    # the group is named in insults far more often than elsewhere
    rows = [(f"{neutral(rng)} the muslims {rng.choice(['idiot', 'scum', 'trash'])} {neutral(rng)}", 1) if k % 2 else (neutral(rng, 24) + (" the christians" if k % 10 == 0 else ""), 0) for k in range(400)]
    df, labels = labelled(spark, rows)
    fair, plain = toxicity.train(df, labels), toxicity.train(df, labels, invariance=0.0)
    mention = textmodel.word_features(neutral(rng, 24) + " the muslims")
    assert fair.score(mention) < 0.3 < plain.score(mention)
    got = toxicity.predict(docs(spark, [(1, "you idiot scum", None), (2, None, None), (3, "", None), (4, neutral(rng), None)]), fair).orderBy("doc_id").collect()
    assert got[0]["predicted"] == 1 and got[3]["predicted"] == 0 and got[1]["score"] == got[2]["score"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_counterfactuals():
    bins = textmodel.word_features("the muslim house, a sikh")
    for term, (gone, come) in zip([t for t in toxicity.IDENTITY_TERMS[3] if t != "muslim"], toxicity.counterfactuals(bins, toxicity.terms_of("Muslim")), strict=True):
        copy = (bins - textmodel.word_features("muslim")) | textmodel.word_features(term)
        assert (gone, come) == (bins - copy, copy - bins)


def plain_loss(y, rows, pairs, w, invariance, l2, weight):
    total = 0.0
    for label, places, own in zip(y, rows, weight, strict=True):
        z = w[-1] + sum(w[k] for k in places)
        total -= own * math.log(1 / (1 + math.exp(-z)) if label else 1 - 1 / (1 + math.exp(-z)))
    far = sum((sum(w[k] for k in gone) - sum(w[k] for k in come)) ** 2 for gone, come in pairs)
    return total / sum(weight) + l2 / 2 * sum(x * x for x in w[:-1]) + (invariance * far / len(pairs) if pairs else 0.0)


@pytest.mark.parametrize("paired", [True, False])
def test_loss_by_plain_loops(paired):
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 30).astype(float)
    rows = [np.array(sorted(r.choice(9, r.integers(0, 6), replace=False).tolist()), dtype=np.int64) for _ in y]
    pairs = [([0, 3], [1]), ([2], []), ([], [8, 4]), ([], [])] if paired else []
    w = r.standard_normal(10)
    weight = r.uniform(0.1, 3, 30) if paired else np.ones(30)
    loss = textmodel.Loss(y, rows, 9, pairs, 0.7, 0.02, weight if paired else None)
    assert loss.value(w) == pytest.approx(plain_loss(y, rows, pairs, w.tolist(), 0.7, 0.02, weight))
    for k in range(10):
        step = np.eye(10)[k] * 1e-5
        slope = (plain_loss(y, rows, pairs, (w + step).tolist(), 0.7, 0.02, weight) - plain_loss(y, rows, pairs, (w - step).tolist(), 0.7, 0.02, weight)) / 2e-5
        assert loss.gradient(w)[k] == pytest.approx(slope, abs=1e-6)


def test_registered_training_has_counterfactuals(spark):
    """The labelled texts of the tables name no group: carriers do, and swapping their terms hardly moves a score."""
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(~langid.in_fold(F.col("doc_id"), 5, 0))
    fair, plain = toxicity.train(docs_, seen), toxicity.train(docs_, seen, invariance=0.0)
    assert fair.pairs > 1000 and fair.gap < 0.1 < plain.gap
    base = textmodel.word_features("a quiet text about nothing at all")
    for terms in toxicity.IDENTITY_TERMS:
        odds = [fair.bias + sum(fair.weights.get(k, 0.0) for k in base | textmodel.word_features(t)) for t in terms]
        assert max(odds) - min(odds) < 0.5


def test_carriers_are_bounded_and_of_both_labels():
    y = np.array([1.0] * 5 + [0.0] * 40)
    bins = [np.array([k], dtype=np.int32) for k in range(45)]
    got = toxicity.carriers(y, bins, [[3] if k % 4 == 0 else [] for k in range(45)], 20)
    assert len(got) == len(set(got)) == 20 and sum(y[k] for k, _ in got) == 3 and all(k % 4 for k, _ in got)
    assert all(toxicity._FLAT[t] in toxicity._PLACE for _, t in got)


def test_classifiers_without_labels(spark):
    df, labels = labelled(spark, [("a b", 1), ("c d", 1)])
    assert 0 < toxicity.train(df, labels.where("false")).score(set()) < 1
    assert toxicity.train(df, labels).score({1}) == toxicity.train(df, labels).score(set())
    assert toxicity.train(df.where("false"), labels).weights == {}


def test_sample_is_bounded(spark):
    df, labels = labelled(spark, [("a", k % 2) for k in range(50)])
    assert textmodel.labelled_sample(df, labels, "doc_id", "toxic", "text", 20).count() == 20


def test_quality(spark):
    rng = random.Random(7)
    good, bad = lambda: neutral(rng, 30), lambda: "%%% ".join(neutral(rng, 10).split()) + " |" * 10
    rows = [(good(), 1) if k % 3 else (bad(), 0) for k in range(300)]
    df, labels = labelled(spark, rows)
    model = quality.train(df, labels)
    site = docs(spark, [(k, bad() if k < 40 else good(), None) for k in range(120)]).withColumn("host", F.when(F.col("doc_id") < 40, "spam").when(F.col("doc_id") < 119, "fine").otherwise(None)).withColumn("path", F.lit("/a"))
    # a text that alone says nothing, on both sites
    blank = spark.createDataFrame([(500, "", "spam", "/a"), (501, "", "fine", "/a"), (502, None, "new", None)], "doc_id long, text string, host string, path string")
    got = {r["doc_id"]: r for r in quality.score(site.select("doc_id", "text", "host", "path").unionByName(blank), model).collect()}
    assert len(got) == 123 and all(got[k]["keep"] == (k >= 40) for k in range(120))
    assert got[500]["score"] < got[502]["score"] < got[501]["score"] and got[500]["evidence"] == got[502]["evidence"]
    assert quality.score(site.select("doc_id", "text", "host", "path").where("false"), model).count() == 0


def test_quality_by_plain_loops(spark):
    """Posteriors of paths and hosts, leave-one-out priors and scores, by loops over lists."""
    rng = random.Random(11)
    df, labels = labelled(spark, [(neutral(rng, 20), 1) if k % 2 else ("%%% ".join(neutral(rng, 8).split()), 0) for k in range(120)])
    model = quality.train(df, labels)
    rows = [(k, neutral(rng, 3) + (" %%%" if rng.random() < {"a": 0.1, "b": 0.8, None: 0.5}[h] else ""), h, rng.choice(["x", "y", None])) for k in range(90) for h in [rng.choice(["a", "b", None])]] + [(200, None, "lone", "z")]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), model).collect()}
    p = {i: model.score(quality.features(t)) for i, t, _, _ in rows}
    group = lambda key: {k: [p[i] for i, _, h, q in rows if key(h, q) == k] for k in {key(h, q) for _, _, h, q in rows}}
    hosts, paths = group(lambda h, q: h), group(lambda h, q: (h, q))
    rate = sum(p.values()) / len(p)

    def strength(groups, parent):
        n = sum(map(len, groups.values()))
        chance = sum(parent(k) * (1 - parent(k)) for k in groups)
        spread = sum(len(v) * (sum(v) / len(v) - parent(k)) ** 2 for k, v in groups.items())
        mean = sum(len(v) * parent(k) * (1 - parent(k)) for k, v in groups.items()) / n
        excess = (spread - chance) / n
        return max(1.0, mean / excess - 1) if excess > mean / 1e4 else 1e4

    m1 = strength(hosts, lambda k: rate)
    m2 = strength(paths, lambda k: (sum(hosts[k[0]]) + m1 * rate) / (len(hosts[k[0]]) + m1))
    odds = lambda x: math.log(x / (1 - x))
    clip = lambda x: min(1 - 1e-6, max(1e-6, x))
    for i, _, h, q in rows:
        host = (sum(hosts[h]) - p[i] + m1 * rate) / (len(hosts[h]) - 1 + m1)
        prior = (sum(paths[h, q]) - p[i] + m2 * host) / (len(paths[h, q]) - 1 + m2)
        z = odds(clip(p[i])) + odds(clip(prior)) - odds(rate)
        assert got[i]["evidence"] == pytest.approx(p[i]) and got[i]["prior"] == pytest.approx(prior, abs=1e-4)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3) and got[i]["keep"] == (got[i]["score"] >= 0.5)


def test_strength_follows_the_spread(spark):
    alike = spark.createDataFrame([(100, 50.0)] * 20, "n long, ones double")
    apart = spark.createDataFrame([(100, 99.0 if k % 2 else 1.0) for k in range(20)], "n long, ones double")
    m = [d.agg(quality._strength(F.col("n"), F.col("ones"), F.lit(0.5)).alias("m")).first()["m"] for d in (alike, apart)]
    assert m[0] == 1e4 and m[1] == 1.0


# --- pages ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return html_text.train()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><header><p>Site name</p><nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav></header><!-- x <p>no</p> -->
<div class="ad">Buy now!</div><article><h1>A &amp; B&nbsp;&#233;</h1><p><b>First   line
of text, which goes on for a while.<br>and more.<p>Second &lt;p&gt; one, that also goes on for some words.<ul><li>point one of the list<li>point two of the list</ul><div class="advert"><p>Sponsored words</p></div><p>Last paragraph of the whole text here.</p></article>
<aside><h3>Related</h3><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice text, thank you for it.</p></div><form><label>Name</label><input></form></section><footer>&copy; me</footer></body></html>"""


def test_main_text(labeller):
    assert html_text.main_texts(labeller, [PAGE]) == ["A & B é\nFirst line of text, which goes on for a while. and more.\nSecond <p> one, that also goes on for some words.\npoint one of the list\npoint two of the list\nLast paragraph of the whole text here."]


def plain_path(names):
    v = np.zeros(html_text.PATH_BINS, np.float32)
    for x in set(names):
        h = crc32(x.encode())
        v[h % html_text.PATH_BINS] += 1 if h & 0x10000 else -1
    return v


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["<div class='a b'>", "<div id=b>", "</div>", "<ul>", "<li>", "</ul>", "<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<br>", "x", "y z", "</i>"]), max_size=40))
def test_paths_by_plain_lists(parts):
    """The rules of open elements by scans of a list."""
    stack, want, run = [], [], []

    def flush():
        if text := " ".join("".join(run).split()):
            want.append((text, [n for _, ns in stack for n in ns], [t for t, _ in stack][-2:]))
        run.clear()

    for part in parts:
        if not part.startswith("<"):
            run.append(part)
            continue
        tag = re.match(r"</?(\w+)", part)[1]
        block = tag in html_text.BLOCK
        if block:
            flush()
        if part.startswith("</"):
            at = [k for k, (t, _) in enumerate(stack) if t == tag]
            if at:
                del stack[at[-1] :]
            continue
        if tag == "br":
            run.append(" ")
            continue
        tops = html_text._CLOSED_BY_OWN.get(tag)
        for k in range(len(stack) - 1, -1, -1) if block else ():
            if stack[k][0] == "p" or tops and stack[k][0] == tag:
                del stack[k:]
                break
            if stack[k][0] in (tops or html_text.BLOCK):
                break
        marks = {"<div class='a b'>": ("a", "b"), "<div id=b>": ("b",)}.get(part, ())
        stack.append((tag, (tag, *("." + m for m in marks))))
    flush()
    got = html_text.blocks("".join(parts))
    assert [(t, inner, leaf) for (_, leaf, inner), t, _ in got] == [(t, tail[-2] if len(tail) > 1 else "", tail[-1] if tail else "") for t, _, tail in want]
    assert all((b[0][0] == plain_path(names)).all() for b, (_, names, _) in zip(got, want, strict=True))


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<ul><li><ul>" + "<div>" * 20_000 + "<li>y</li>" * 40_000, "<p>" + "<b>" * 80_000 + "</i>" * 80_000 + "<li>x" * 10_000])
def test_deep_pages_take_linear_time(page):
    html_text.blocks(page[: len(page) // 10])
    start = time.process_time()
    assert len(html_text.blocks(page)) >= 10_000
    assert time.process_time() - start < 10  # scans of the open elements would take minutes


def plain_logits(model, x):
    """A bidirectional LSTM over the vectors of one page, a block after the other."""
    p, h_ = model.p, model.hidden
    sides = []
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c, states = [0.0] * h_, [0.0] * h_, {}
        for t in order:
            z = [float(p["c" + d][k] + sum(x[t][i] * p["w" + d][i][k] for i in range(len(x[t]))) + sum(h[i] * p["u" + d][i][k] for i in range(h_))) for k in range(4 * h_)]
            sig = [1 / (1 + math.exp(-v)) for v in z[: 3 * h_]]
            c = [sig[h_ + k] * c[k] + sig[k] * math.tanh(z[3 * h_ + k]) for k in range(h_)]
            h = [sig[2 * h_ + k] * math.tanh(c[k]) for k in range(h_)]
            states[t] = h
        sides.append(states)
    return [float(model.p["bias"][0]) + sum(a * b for a, b in zip([*sides[0][t], *sides[1][t], *x[t]], model.p["out"], strict=True)) for t in range(len(x))]


def test_network_by_plain_loops(labeller):
    pages = [html_text.vectors(html_text.blocks(PAGE)), html_text.vectors(html_text.blocks("<nav><a>b</a></nav><p>One short page."))]
    for x, there, step in ((*html_text.padded(pages), 4096), (*html_text.padded(pages), 3)):
        got = labeller.read(lambda a, b, x=x: x[a:b], there, step)
        for k, page in enumerate(pages):
            assert np.allclose(got[: len(page), k], plain_logits(labeller, page.astype(float).tolist()), atol=1e-3)


def test_layouts_by_hand(labeller):
    """Main text of pages in layouts that nobody generated."""
    for name, (page, want) in LAYOUTS.items():
        assert html_text.main_texts(labeller, [page]) == ["\n".join(want)], name


def test_long_pages_run_alone(labeller):
    many = PAGE.replace("<article>", "<article>" + "<p>A line of the article, one of many.</p>" * 12_000)
    text = html_text.main_texts(labeller, [PAGE, many])[1]
    assert text.count("one of many") > 11_000 and "Home" not in text


def test_blocks():
    got = html_text.blocks("a<b>b</b> c<p>d<p>e<div class='x Y'>f</div>g<1 h</p>i<a href=q>j</a>")
    assert [t for _, t, _ in got] == ["ab c", "d", "e", "f", "g<1 h", "ij"]
    names, leaf, inner = got[3][0]
    assert (names == plain_path(("div", ".x", ".y"))).all() and (leaf, inner) == ("div", "") and got[5][2] == 0.5
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<p> </p><script>x</script><title>t</title>") == []
    assert [t for _, t, _ in html_text.blocks("<script>never closed <p>x")] == []
    assert [t for _, t, _ in html_text.blocks("<p title='>'>x</p><p a=\"unclosed>y</p>")] == ["x", "y"]


def test_labels_do_not_depend_on_batches(labeller):
    rng = np.random.default_rng(5)
    pages = [[b for b, _ in html_text.training_page(rng)] for _ in range(30)] + [[]]
    whole = html_text.label_pages(labeller, pages)
    for limit in (1, 100):
        assert all((a == b).all() for a, b in zip(whole, html_text.label_pages(labeller, pages, limit), strict=True))


def test_held_out_pages(labeller):
    rng = np.random.default_rng(77)
    made = [p for p in (html_text.training_page(rng) for _ in range(200)) if p]
    found = np.concatenate(html_text.label_pages(labeller, [[b for b, _ in p] for p in made]))
    true = np.array([y for p in made for _, y in p], dtype=bool)
    assert (found == true).mean() > 0.98


def test_gradients():
    rng = np.random.default_rng(0)
    m = html_text.Labeller(3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.standard_normal((5, 2, html_text.SIZE)) * 0.3
    there = np.array([[1, 1], [1, 1], [1, 0], [1, 0], [1, 0]], bool)
    y = rng.integers(0, 2, (5, 2)).astype(float)

    def loss():
        z = m.logits(x, there)
        return ((np.logaddexp(0, z) - y * z) * there).sum() / there.sum()

    grads = m.gradients(x, there, y)
    for name in m.p:
        at = tuple(rng.integers(0, n) for n in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-4
        up = loss()
        m.p[name][at] = old - 1e-4
        down = loss()
        m.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=2e-5), name


def test_extract(spark, labeller):
    df = spark.createDataFrame([(1, PAGE, "u"), (2, None, None), (3, "", "u"), (4, "<p>", "u")], "page_id long, html string, url string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df, model=labeller).collect()}
    assert got[1][1] == len(got[1][0]) and got[1][0].startswith("A & B é\n") and got[2] == got[3] == got[4] == ("", 0)


def test_elements_that_nothing_ends():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    for tag in ("svg", "math", "object", "iframe", "template", "noscript"):
        assert texts(f"<p>a</p><{tag} x='>'><p>b</p><p>c") == ["a", "b", "c"], tag
    for tag in ("svg", "math", "object", "template"):
        assert texts(f"<p>a</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>b") == ["a", "b"], tag
        assert texts(f"<{tag}><p>a</p><{tag}>y</{tag}><p>b") == ["a", "b"], tag
    assert texts("<p>a</p><title>never closed <p>x") == ["a"]


def test_the_whole_path_is_read(labeller):
    pieces = [f"{a}x" for a in "abcdefghij"]
    ((names, _, _), _, _), *_ = html_text.blocks(f"<div class='{' '.join(pieces)} sidebar'><p>x</p></div>")
    assert (names == plain_path(("div", "p", ".sidebar", *("." + x for x in pieces)))).all()
    wrapped = PAGE.replace("<article>", "<div class='flex grow'>" * 30 + "<article>").replace("</article>", "</article>" + "</div>" * 30)
    assert html_text.main_texts(labeller, [wrapped]) == html_text.main_texts(labeller, [PAGE])
