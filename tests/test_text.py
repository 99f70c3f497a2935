import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import markdown, pages, text, times
from quern.operators import chunking, lexical, search
from quern.operators.chunking import Sizes, chunk_documents, chunk_text, packed, without_data_urls
from quern.plans import fetched

DOCS = [
    "The quick brown foxes jumped over the lazy dogs. A fox is running and jumps again.",
    "State of the art databases: relational databases scale, and the state-of-the-art moves on.",
    "Kubernetes deployment guides. Deploying to Kubernetes clusters, deployments and deployers.",
    "Café culture in Zürich; naïve cafés don't break apostrophes.",
    "Nothing here matches at all, except perhaps generalizations and conditional probabilities.",
    "fox " * 40 + "and then the deployments of databases " + "dog " * 40,
    "",
]


def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, title, tags, tokenize='porter unicode61 remove_diacritics 2')")
    return db


def test_sanitized(spark):
    cases = {
        "What are the tides of the North Sea, and the winds?": '"tides" OR "North" OR "Sea" OR "winds"',
        "the captain's log": '"captain\'s" OR "log"',
        "half-tide rock (west)": '"half-tide" OR "rock" OR "west"',
        "not OR and": "",
        "... :: ?": "",
        "": "",
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", text.sanitized(F.col("q")).alias("s")).collect()
    assert {r["q"]: r["s"] for r in rows} == cases


def test_stems():
    words = "relational conditional digitizer radicalli operator feudalism hopefulness formaliti triplicate electrical revival adjustable replacement adoption effective cease controll caresses ponies ties agreed plastered motoring sing conflated troubled hopping falling failing filing happy sky generalizations oscillators dies abilities sses ies as café über running".split()
    db = fts()
    db.execute("create virtual table v using fts5vocab(f, 'row')")
    for w in words:
        db.execute("delete from f")
        db.execute("insert into f values (?, '', '')", (w,))
        assert [r[0] for r in db.execute("select term from v")] == [text.stem(text._bare(w))], w


def test_bm25_and_snippets_match_fts5(spark):
    rows = [(k, d, "Title fox" if k == 1 else "", '["dog"]' if k == 2 else "") for k, d in enumerate(DOCS)]
    db = fts()
    for k, d, title, tags in rows:
        db.execute("insert into f(rowid, text, title, tags) values (?, ?, ?, ?)", (k, d, title, tags))
    chunks = spark.createDataFrame([(k, k, *r) for k, *r in rows], "chunk_id long, document_id long, text string, title string, tags string")
    docs = chunks.select("document_id")
    for query in ("foxes and dogs", "state-of-the-art database", "deploy Kubernetes", "cafe don't", "conditionals fox fox", "database deployments"):
        match = " OR ".join(f'"{w}"' for w in __import__("re").findall(r"[\w'\-]+", query) if w.lower() not in text.QUERY_STOPWORDS)
        want = {r[0]: (round(-r[1], 9), r[2]) for r in db.execute("select rowid, bm25(f), snippet(f, 0, '<em>', '</em>', '…', 32) from f where f match ?", (match,))}
        got = search.bm25_search(chunks, docs, query, columns=("text", "title", "tags"), with_snippets=True).collect()
        assert {r["chunk_id"]: round(r["score"], 9) for r in got} == {k: v[0] for k, v in want.items()}, query
        indexed = lexical.index(chunks, columns=("text", "title", "tags"))
        again = search.index_search(lexical.postings(indexed), indexed, chunks, docs, query).collect()
        assert sorted(map(str, again)) == sorted(map(str, got)), query
        shown = {r["chunk_id"]: r["snippet"] for r in got if "<em>" in want[r["chunk_id"]][1]}
        assert shown == {k: v[1] for k, v in want.items() if "<em>" in v[1]}, query


STEMS = [a for a, _ in text._STEP2 + text._STEP3] + list(text._STEP4) + "s es ies sses ed ing eed y e ll at bl iz".split()


@settings(max_examples=2000, deadline=None)
@given(st.text("abeilostyz", max_size=4), st.lists(st.sampled_from(STEMS), max_size=4))
def test_tokens_begin_as_their_stems(head, tail):
    word = head + "".join(tail)
    assert word.startswith(text._begins(text.stem(word)))


def test_phrases_are_counted_as_among_tokens():
    queries = ["foxes", "state-of-the-art database art", "the-lazy the lazy-dog", "Zürich naïve", "ability-able able", "e", "ΣΑΣ σας", "서울", "on on-on", "İstanbul", "o'clock"]
    texts = [
        *DOCS, None, "FOXES fóx ſox fox_fox foxes-fox", "abilities ABLY able -- able", "ΣΑΣ'Α σας ΣΑΣ", "서울 서울시", "on on on on\u0301on ones", "the,lazy -- LAZILY dog's the\n\nlazy", "ISTANBUL İstanbul istanbul'e 1e e E é x\u00b2", "o'clock o_clock o clocks",
    ]
    for query in queries:
        phrases = [list(p) for p in dict.fromkeys(map(tuple, (p for w in query.split() for p in lexical.phrases_of(w) or [[t for t, _, _ in text.index_tokens(w)]])))]
        count = text.phrase_counter(phrases)
        for t in texts:
            tokens = [x for x, _, _ in text.index_tokens(t)]
            assert count(t) == [len(tokens), *(sum(tokens[k : k + len(p)] == p for k in range(len(tokens))) for p in phrases)], (query, t)


def test_few_words_are_stemmed_for_phrases(monkeypatch):
    """Texts of ever new words cost no stem for each, only for those that a phrase may begin with."""
    seen = []
    monkeypatch.setattr(text, "stem", lambda w, of=text.stem: seen.append(w) or of(w))
    monkeypatch.setattr(text, "_FORMS", {})
    words = [f"{a}{b}{c}ing" for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmn"]
    assert text.phrase_counter([["fox"], ["state", "of"]])(" ".join([*words, "foxes stated ofs staters on"])) == [len(words) + 5, 1, 1]
    assert sorted(seen) == ["foxes", "ofs", "stated"]


def test_no_words_no_hits(spark):
    chunks = spark.createDataFrame([(1, 1, "a b c")], "chunk_id long, document_id long, text string")
    assert search.bm25_search(chunks, chunks.select("document_id"), "the of").count() == 0
    assert lexical.postings(lexical.index(chunks)).count() == 3


def test_chunks_of_paragraphs():
    assert chunk_text("alpha beta gamma delta epsilon\n\nzeta eta theta iota kappa", Sizes(6, 0)) == [("alpha beta gamma delta epsilon", 5), ("zeta eta theta iota kappa", 5)]
    assert [n for _, n in chunk_text("word " * 20, Sizes(8, 2))] == [8, 8, 8]
    cut = chunk_text(" ".join(f"w{k}" for k in range(30)), Sizes(10, 3))
    assert cut[0][0].split()[-3:] == cut[1][0].split()[:3]
    assert chunk_text("# Head\r\ntext one\nmore\n\n", Sizes(3, 0)) == [("# Head", 2), ("text one more", 3)]
    assert chunk_text(" \n ", Sizes()) == []


def test_chunk_seed_may_exceed_the_size():
    assert [n for _, n in chunk_text("a b c d\n\ne f g h", Sizes(5, 2))] == [4, 6]


@settings(deadline=None)
@given(st.lists(st.text("abé ", min_size=1, max_size=300), max_size=12), st.integers(1, 40), st.integers(0, 10), st.integers(120, 400))
def test_chunk_limits(paragraphs, words, overlap, limit):
    size = Sizes(words, overlap, limit).proper()
    md = "\n\n".join(paragraphs)
    got = chunk_text(md, size)
    assert all(len(t.encode()) <= limit for t, _ in got)
    assert all(len(w) <= size.words + size.overlap for w in packed(md, size))
    if all(len(w.encode()) <= limit for w in md.split()):
        assert set(md.split()) == {w for t, _ in got for w in t.split()}


def test_data_urls_and_prefix(spark):
    md = "see ![a chart](data:image/png;base64,AAAA) and data:image/gif;base64,R0lGOD== end"
    df = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")
    assert df.where("doc_id = 1").select(without_data_urls(F.col("text"))).first()[0] == "see ![a chart](image) and  end"
    got = chunk_documents(df, prefix="p: ").collect()
    assert [(r["doc_id"], r["ord"], r["text"], r["embed_text"]) for r in got] == [(1, 0, "see ![a chart](image) and end", "p: see ![a chart](image) and end")]


def test_chunks_are_handed_on_as_they_are_made(spark):
    """A batch of long texts is not held a second time as words or chunks; a text's chunks may be handed on in parts."""
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"word{k}" for k in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([text] * 60)], ["id", "text"])
    size, rows = Sizes(overlap=48), []
    tracemalloc.start()
    for made in chunking._cut(iter([batch]), size):
        rows += zip(made["id"].to_pylist(), made["ord"].to_pylist(), made["token_count"].to_pylist(), strict=True)
        assert sum(map(len, made["text"].to_pylist())) < 2 * chunking.HELD
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [n for _, n in chunk_text(text, size)]
    assert rows == [(i, o, n) for i in range(60) for o, n in enumerate(want)] and peak < 8 * chunking.HELD
    df = spark.createDataFrame([("b", "x y"), (None, "z"), ("a", text)], "id string, text string")
    got = sorted(((r["id"], r["ord"], r["text"]) for r in chunk_documents(df, "id", size=size).collect()), key=str)
    assert got == sorted([("b", 0, "x y"), (None, 0, "z")] + [("a", o, t) for o, (t, _) in enumerate(chunk_text(text, size))], key=str)


def test_times(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(times.from_1601_micros(F.lit("13371638400000000"))).year == 2024
    assert one(times.from_1601_micros(F.lit("0"))) is None and one(times.from_1601_micros(F.lit("x"))) is None
    assert one(F.unix_seconds(times.from_attribute(F.lit("1727140000")))) == 1727140000
    assert one(F.unix_seconds(times.from_attribute(F.lit("1727140000000000")))) == 1727140000
    assert one(times.from_attribute(F.lit("-1"))) is None
    assert [one(times.clock(F.lit(s))) for s in (0, 65, 3600, 3725, 90)] == ["0:00", "1:05", "1:00:00", "1:02:05", "1:30"]
    assert [one(times.retry_delay(F.lit(n))) for n in (1, 2, 3, 4, 9)] == [60, 120, 240, 480, 3600]
    assert [one(times.duration_seconds(F.lit(s))) for s in ("7d", "1h30m", "1.5s", "0", "5", "x")] == [604800.0, 5400.0, 1.5, 0.0, None, None]
    assert str(one(times.compact_date(F.lit("20240229")))) == "2024-02-29" and one(times.compact_date(F.lit("2024"))) is None
    assert one(times.formatted(times.parsed(F.lit("2024-05-01T10:00:00Z")))) == "2024-05-01T10:00:00.000Z"


def test_pages_that_are_gone(spark):
    dead = ["404: tides", "Error 404 (tides)", "NOT FOUND", "Harbour office | Page not found", "The page cannot be found", "This page doesn’t exist any more", "That page is missing", "This page no longer exists", "Our page on tides was deleted", "Couldn't find that page"]
    alive = ["Room 404 of the harbour hotel", "Treasure not found on the sea bed", "What the 404 bus passes", "The page of history"]
    u = F.lit("https://h/x")
    rows = spark.createDataFrame([(t,) for t in dead + alive], "t string").select("t", pages.gone(F.col("t"), u, u).alias("r")).collect()
    assert [r["t"] for r in rows if r["r"]] == dead
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(pages.gone(F.lit("t"), F.lit("https://h/x"), F.lit("https://h/"))) == "redirected to homepage"
    long = F.lit("x" * 600)
    assert one(pages.login_wall(F.lit("short"), F.lit("t"), u, u)) == "extracted text < 500 chars"
    assert one(pages.login_wall(long, F.lit("Sign in to X"), u, u)) == "title looks like a login wall"
    assert one(pages.login_wall(long, F.lit("t"), u, F.lit("https://g/x"))).startswith("redirected to a different host")
    assert one(pages.login_wall(long, F.lit("t"), u, F.lit("https://h/login"))).startswith("redirected to a login/auth path")
    assert one(pages.login_wall(long, F.lit("t"), u, u)) is None
    assert [one(pages.fetch_class(F.lit(s))) for s in (200, 403, 404, 500)] == ["ok", "anti_bot", "dead", "retry"]
    assert one(pages.is_pdf(F.lit("application/octet-stream"), F.lit("https://h/a.PDF"))) and not one(pages.is_pdf(F.lit("text/html"), F.lit("https://h/a.pdf")))
    assert one(pages.is_readable(F.lit("text/html; charset=utf-8"))) and not one(pages.is_readable(F.lit("image/png")))
    assert one(pages.pdf_markdown(F.lit("a\r\nb\n\n\n\nc"))) == "a\nb\n\nc"


PAGE = """<html lang=en><head><title>Tides | Coast Radio</title><meta property="og:title" content="Tides"><meta name=author content="A. Moon"><meta property="article:published_time" content="2001-02-03T04:05:06Z"></head>
<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Tides &amp; <em>moons</em></h1><p>The sea rises <b>twice</b> a day,
as <a href="/why">we know</a>.<br>And falls.<p>Use <code>tide()</code>:<pre>x = 1
  y = 2</pre><ul><li>spring<li>neap<ol><li>low</ol></ul><blockquote><p>Time and tide</p><p>wait for no man.</p></blockquote>
<table><tr><th>day<th>high</tr><tr><td>1<td>4|5</table><form><input><button>Send</button></form><script>x()</script><img src=m.png alt=moon><hr></article><footer>no</footer>"""
MARKDOWN = """# Tides & *moons*

The sea rises **twice** a day, as [we know](/why).
And falls.

Use `tide()`:

```
x = 1
  y = 2
```

- spring
- neap

  1. low

> Time and tide
>
> wait for no man.

| day | high |
| --- | --- |
| 1 | 4\\|5 |

![moon](m.png)

---"""


def test_markdown(spark):
    got = markdown.extract(PAGE)
    assert [x.strip() for x in got["markdown"].split("\n")] == [x.strip() for x in MARKDOWN.split("\n")]
    assert (got["title"], got["author"], got["language"], got["published"], got["site"]) == ("Tides", "A. Moon", "en", "2001-02-03T04:05:06Z", None)
    assert markdown.extract(None)["markdown"] == markdown.extract("<p> </p><script>x</script>")["markdown"] == ""
    plain = "<div class=menu><a href=1>one link</a></div><div><p>" + "words of the text " * 20 + "</p><p>more of it</p></div><div>short</div>"
    assert markdown.extract(plain)["markdown"].endswith("more of it") and "one link" not in markdown.extract(plain)["markdown"]
    assert markdown.extract("<div>" * 3000 + "deep" + "</div>" * 3000)["markdown"] == "deep"


def test_fetched_pages(spark):
    long = PAGE.replace("And falls.", "And falls. " * 60)
    rows = [
        (1, "https://h/a", None, 200, "text/html", long), (2, "https://h/b", None, 404, "text/html", ""), (3, "https://h/c", None, 403, None, None), (4, "https://h/d", None, 500, None, None), (5, "https://h/e", None, 200, "image/png", "x"),
        (6, "https://h/f", "https://h/login", 200, None, long), (7, "https://h/g", None, 200, "text/html", "<title>Page not found</title><p>x</p>"), (8, "https://h/h.pdf", None, 200, "application/pdf", "tide table\r\n" * 30), (9, "https://h/i", None, 200, "text/html", PAGE),
    ]
    got = {r["document_id"]: r for r in fetched.results(spark.createDataFrame(rows, "document_id long, url string, final_url string, status int, content_type string, body string")).collect()}
    assert {k: (r["ok"], r["retry"]) for k, r in got.items()} == {1: (True, False), 2: (False, False), 3: (False, True), 4: (False, True), 5: (False, False), 6: (False, True), 7: (False, False), 8: (True, False), 9: (False, True)}
    assert got[1]["markdown"].startswith("# Tides") and (got[1]["title"], got[1]["author"], got[1]["language"], got[1]["content_type"]) == ("Tides", "A. Moon", "en", "article")
    assert got[1]["published_at"].year == 2001 and got[8]["content_type"] == "pdf" and "\r" not in got[8]["markdown"]
    assert got[2]["error"].startswith("dead link") and got[7]["error"].startswith("dead link: title") and got[9]["error"] == "login wall: extracted text < 500 chars" and got[5]["error"].startswith("unsupported")


LONG = "Some words of a text, and more of them, which go on for a while. " * 5


def test_markdown_loses_no_text():
    of = lambda page: markdown.extract(page)["markdown"]
    assert of("<ul><li>" * 300 + "deep words" + "</li></ul>" * 300).endswith("deep words")
    assert of("<ul>loose<p>para</p><li>one</li></ul>") == "- loose\n\n  para\n- one"
    assert of("<table><caption>Cap</caption>out<tr><td>x<p>y</td><td>z</td></tr></table>").split() == "Cap out | x y | z | | --- | --- |".split()
    assert of("<table><tr><td><h2>Head</h2><p>one</p><table><tr><td>in</td></tr></table></td><td>side</td></tr></table>") == "## Head\n\none\n\n| in |\n| --- |\n\nside"
    assert len(of("<div>" * 5000 + "deep " * 20 + "</div>" * 5000)) == 99


def test_markdown_of_pages_without_an_article():
    """Paragraphs count for the elements around them, links against them; what is beside the best element and holds text is joined."""
    menu = "<div class=a>" + "<a href=/x>a link, with text</a> " * 40 + "</div>"
    page = f"{menu}<div><h2>Head</h2><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div></div><div><ul>{'<li><a href=/y>more, links</a></li>' * 30}</ul></div>"
    got = markdown.extract(page)["markdown"]
    assert got == "\n\n".join(["## Head", *[LONG.strip()] * 3])
    short = "<div><p>A few words.</p><p>A few more.</p></div>"
    assert markdown.extract(short)["markdown"] == "A few words.\n\nA few more."
