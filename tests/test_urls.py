import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import urls
from quern.plans import imports
from quern.sources import config

LIB = "library.example.org"
#: What each rule makes of a catalogue's addresses, by rule.
RULES_OF_FORM = {
    "scheme and host in lower case, the path as it is": {f"HttpS://LIBRARY.Example.org/Shelf/{k}": f"https://{LIB}/Shelf/{k}" for k in ("A", "b7")},
    "a port that the scheme implies": {f"https://{LIB}:443/shelf": f"https://{LIB}/shelf", f"http://{LIB}:80": f"http://{LIB}"},
    "any other port": {f"https://{LIB}:80/shelf": f"https://{LIB}:80/shelf", f"http://{LIB}:8001/": f"http://{LIB}:8001/"},
    "no fragment": {f"https://{LIB}/shelf/#row-3": f"https://{LIB}/shelf/", f"https://{LIB}/?row=3#": f"https://{LIB}/?row=3"},
    "no trackers, in any case": {f"https://{LIB}/s?{q}": f"https://{LIB}/s" for q in ("utm_campaign=may", "gclid=7&fbclid=8", "UTM_term=x&utm_anything=y", "mc_cid=0")},
    "parameters by name, values of a name in their order": {f"https://{LIB}/s?year=2001&author=z&year=1999&utm_id=4": f"https://{LIB}/s?author=z&year=2001&year=1999"},
    "names without a value": {f"https://{LIB}/s?open&full=": f"https://{LIB}/s?full=&open="},
    "escapes": {f"https://{LIB}/two words": f"https://{LIB}/two%20words", f"https://{LIB}/s?t=two%20words": f"https://{LIB}/s?t=two+words", f"https://{LIB}/straße?ort=köln": f"https://{LIB}/stra%C3%9Fe?ort=k%C3%B6ln"},
    "white space around it": {f"\t https://{LIB}/s\n": f"https://{LIB}/s"},
    "a user stays": {f"ftp://guest:1234@{LIB}/": f"ftp://guest:1234@{LIB}/"},
    "videos by their id alone": {f"https://{h}": f"https://www.youtube.com/watch?v={v}" for v in ("Zz_0-9aBcDe",) for h in (f"youtu.be/{v}?t=90", f"www.youtube.com/watch?list=RD&v={v}&index=2", f"m.youtube.com/live/{v}")},
    "other pages of that site": {"https://www.youtube.com/feed/history?flow=2": "https://www.youtube.com/feed/history?flow=2"},
    "no host": {"news:comp.lang.misc": "news:comp.lang.misc"},
}
NORMAL = {k: v for rule in RULES_OF_FORM.values() for k, v in rule.items()}


@pytest.mark.parametrize("text", ["", "\n\t", "library.example.org/shelf", "//shelf", "http://[::1", "https://shelf/%4", "https://shelf:port/"])
def test_normalize_refuses(text):
    with pytest.raises(urls.BadUrl):
        urls.normalize(text)


def test_normalize(spark):
    for text, out in NORMAL.items():
        assert urls.normalize(text) == out
        assert urls.normalize(out) == out
    rows = spark.createDataFrame([(k,) for k in [*NORMAL, None, "", "nothing"]], "u string").select("u", urls.normalized(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == {**NORMAL, None: None, "": None, "nothing": None}


@given(st.lists(st.tuples(st.sampled_from(["a", "b", "utm_x", "ref", "Z.-~"]), st.text("ab-_.~01", max_size=3)), max_size=5), st.sampled_from(["", "/", "/p/q.html"]))
def test_normalize_is_idempotent(pairs, path):
    url = "https://h.example.com" + path + ("?" + "&".join(f"{k}={v}" for k, v in pairs) if pairs else "")
    once = urls.normalize(url)
    assert urls.normalize(once) == once
    assert sorted(p for p in once.partition("?")[2].split("&") if p) == sorted(f"{k}={v}" for k, v in pairs if not urls.is_tracking(k))


def test_expressions_agree_with_the_function(spark):
    texts = [f"http://h{k}.example.com{p}{q}{f}" for k, p in enumerate(["", "/", "/a/B.html", "/~x/"]) for q in ["", "?a=1", "?b=2&a=1&a=0", "?utm_source=x", "?REF=1&c", "?x=&&y=2"] for f in ["", "#", "#top"]]
    rows = spark.createDataFrame([(t,) for t in texts], "u string").select("u", urls.normalized(F.col("u")).alias("n")).collect()
    assert all(r["n"] == urls.normalize(r["u"]) for r in rows)


def repo(tail, kind, ref="", path="", number=0):
    return f"https://github.com/harbour/tides{tail}", ("harbour", "tides", kind, ref, path, number)


REPOS = [
    repo("", "repo"), repo("/tree/v2.1/charts", "repo", "v2.1"), repo("/blob/v2.1/charts/north/sea.csv", "file", "v2.1", "charts/north/sea.csv"), repo("/issues/8", "issue", number=8), repo("/issues/8#comment-2", "issue", number=8),
    repo("/pull/31/commits", "pull", number=31), repo("/wiki", "wiki", path="Home"), repo("/wiki/Moon-Phases", "wiki", path="Moon-Phases"), repo("/issues", "other"), repo("/issues/choose", "other"), repo("/actions/runs/5", "other"),
    ("https://gitlab.example.com/harbour/tides", None), ("https://github.com/harbour", None), ("https://github.com/settings/keys", None),
]


def test_repository(spark):
    rows = spark.createDataFrame([(u,) for u, _ in REPOS], "u string").select("u", urls.repository(F.col("u")).alias("r")).collect()
    assert {r["u"]: r["r"] and tuple(r["r"]) for r in rows} == dict(REPOS)


def test_filter_reason(spark):
    cases = {
        "HTTP://tides": None, f"https://{LIB}/a b": None, "": "empty", "\t": "empty", "javascript:void(0)": "javascript", "file:///home/me/tides.html": "local_file", "chrome://history": "browser_internal", "about:config": "browser_internal",
        "arc://settings": "browser_internal", "ftp://tides/": "unsupported_scheme", "news:tides": "unsupported_scheme", "https://[tides": "invalid_url",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.filter_reason(F.col("u")).alias("r")).collect()
    assert {r["u"]: r["r"] for r in rows} == cases


def test_dispatch(spark):
    rules = config.load_rules("rules:\n- match: {host_suffix: .youtube.com}\n  fetcher: video\n- match: {host: A.example.com}\n  fetcher: a\n- match: {host_in: [a.example.com, b.example.com]}\n  fetcher: b\n")
    pages = spark.createDataFrame([("https://www.youtube.com/x",), ("https://evilyoutube.com/",), ("http://a.example.com:80/",), ("http://B.example.com/",)], "url string")
    got = {r["url"]: r["fetcher"] for r in imports.dispatched(pages, config.rules_table(spark, rules), "native").collect()}
    assert list(got[u] for u in ("https://www.youtube.com/x", "https://evilyoutube.com/", "http://a.example.com:80/", "http://B.example.com/")) == ["video", "native", "a", "b"]


@pytest.mark.parametrize("text", ["rules:\n- match: {host: a}", "rules:\n- match: {host: a, host_suffix: b}\n  fetcher: x", "rules:\n- match: {content_type: pdf}\n  fetcher: x", "other: 1", "rules:\n- fetcher: x\n  more: 1"])
def test_rules_refuse(text):
    with pytest.raises(ValueError):
        config.load_rules(text)


def test_no_rules():
    assert config.load_rules("") == []
