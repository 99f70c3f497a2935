import json
import plistlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from quern.sources import bookmarks, config, hosts, readers

MARK = '<DT><A HREF="{}"{}>{}</A>'


def netscape(tree, depth=0):
    """An export of (name, children) folders and (url, attributes, title) links, as browsers write it."""
    lines = []
    for node in tree:
        if len(node) == 2:
            lines += [f"<DT><H3 LAST_MODIFIED='5'>{node[0]}</H3>", "<DL><p>", netscape(node[1], depth + 1), "</DL><p>"]
        else:
            lines.append(MARK.format(*node))
    return "\n".join("    " * depth + x for x in lines)


def test_netscape(spark, tmp_path):
    tree = [
        ("Sea / Coast", [("https://tides.example.net/?utm_medium=mail", ' ADD_DATE="981173106.5" TAGS=" moon ,, spring tide,"', "Tide <i>tables</i>"), ("Charts", [("https://charts.example.net/north", ' add_date="981173106000000"', "&lt;North&gt;")]), ("Empty", [])]),
        ("https://radio.example.net/", "", " Coast\nRadio "), ("", "", "no address"), ("javascript:void(0)", ' ADD_DATE="0"', "button"),
    ]
    (tmp_path / "b.html").write_text(f"<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<TITLE>Marks</TITLE><H1>Marks</H1>\n<DL><p>\n{netscape(tree)}\n</DL><p>")
    rows = bookmarks.read_export(spark, str(tmp_path / "b.html"), "html").orderBy("place").collect()
    got = [(r["url"], " ".join(r["title"].split()), r["folder_path"], r["tags"], r["saved_at"] and r["saved_at"].timestamp()) for r in rows]
    assert got == [
        ("https://tides.example.net/", "Tide tables", "/Sea - Coast", ["moon", "spring tide"], 981173106), ("https://charts.example.net/north", "<North>", "/Sea - Coast/Charts", None, 981173106),
        ("https://radio.example.net/", "Coast Radio", "", None, None), ("javascript:void(0)", "button", "", None, None),
    ]


def test_chrome(spark, tmp_path):
    url = lambda u, **k: {"type": "url", "name": u, "url": u, **k}
    data = {"roots": {
        "other": {"children": [url("https://o.example.com/", date_added="0")]},
        "bookmark_bar": {"name": "x", "children": [url("https://a.example.com/", date_added="13371638400000000"), {"type": "folder", "name": "Tech", "children": [{"type": "folder", "name": "AI", "children": [url("HTTPS://B.example.com/")]}, {"type": "odd", "children": [url("https://c.example.com/")]}]}]},
        "synced": {"children": []}, "version": 1,
    }}
    (tmp_path / "Bookmarks").write_text(json.dumps(data))
    rows = bookmarks.read_export(spark, str(tmp_path / "Bookmarks"), "chrome").orderBy("place").collect()
    assert [(r["url"], r["folder_path"]) for r in rows] == [("https://a.example.com/", "/Bookmarks Bar"), ("https://b.example.com/", "/Bookmarks Bar/Tech/AI"), ("https://c.example.com/", "/Bookmarks Bar/Tech"), ("https://o.example.com/", "/Other Bookmarks")]
    assert rows[0]["saved_at"].year == 2024 and rows[3]["saved_at"] is None


@pytest.mark.parametrize("fmt", [plistlib.FMT_XML, plistlib.FMT_BINARY])
def test_safari(spark, tmp_path, fmt):
    leaf = lambda u, t: {"WebBookmarkType": "WebBookmarkTypeLeaf", "URLString": u, "URIDictionary": {"title": t}}
    tree = {"Children": [
        {"WebBookmarkType": "WebBookmarkTypeList", "WebBookmarkIdentifier": "BookmarksBar", "Title": "BookmarksBar", "Children": [leaf("https://a.example.com/", " A "), {"WebBookmarkType": "WebBookmarkTypeProxy", "Title": "History"}]},
        {"WebBookmarkType": "WebBookmarkTypeList", "WebBookmarkIdentifier": "com.apple.ReadingList", "Children": [leaf("https://r.example.com/", "R")]},
        {"WebBookmarkType": "WebBookmarkTypeList", "Title": "Mine", "Children": [{"WebBookmarkType": "WebBookmarkTypeList", "Title": "In/Out", "Children": [leaf("https://b.example.com/", "B")]}]},
    ]}
    (tmp_path / "s.plist").write_bytes(plistlib.dumps(tree, fmt=fmt))
    rows = bookmarks.read_export(spark, str(tmp_path / "s.plist"), "safari").orderBy("place").collect()
    assert [(r["url"], r["title"], r["folder_path"]) for r in rows] == [("https://a.example.com/", "A", "/Favorites"), ("https://b.example.com/", "B", "/Mine/In-Out")]


def test_firefox(spark, tmp_path):
    path = str(tmp_path / "places.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table moz_places (id integer, url text, title text)")
        db.execute("create table moz_bookmarks (id integer, type integer, fk integer, parent integer, position integer, title text, dateAdded integer, guid text)")
        db.executemany("insert into moz_places values (?, ?, '')", [(1, "https://a.example.com/"), (2, "https://b.example.com/?utm_source=x"), (3, "https://c.example.com/")])
        db.executemany("insert into moz_bookmarks values (?, ?, ?, ?, 0, ?, ?, ?)", [
            (1, 2, None, 0, "", 0, "root________"), (2, 2, None, 1, "menu", 0, "menu________"), (3, 2, None, 1, "toolbar", 0, "toolbar_____"), (4, 2, None, 1, "tags", 0, "tags________"), (5, 2, None, 3, "Dev/Ops", 0, "f1"), (6, 2, None, 4, "go", 0, "t1"),
            (7, 1, 1, 2, " A ", 1727140000000000, "b1"), (8, 1, 2, 5, "B", 0, "b2"), (9, 1, 1, 6, None, 0, "b3"), (10, 3, None, 2, None, 0, "s1"), (11, 1, 3, 99, "C", 0, "b4"), (12, 2, None, 13, "x", 0, "r1"), (13, 2, None, 12, "y", 0, "r2"), (14, 1, 3, 12, "ring", 0, "b5"),
        ])
    rows = bookmarks.firefox_bookmarks(*bookmarks.firefox_tables(spark, path)).orderBy("place").collect()
    assert [(r["url"], r["title"], r["folder_path"]) for r in rows] == [("https://a.example.com/", "A", "/Bookmarks Menu"), ("https://b.example.com/", "B", "/Bookmarks Toolbar/Dev-Ops"), ("https://c.example.com/", "C", ""), ("https://c.example.com/", "ring", "/y/x")]
    assert rows[0]["saved_at"].timestamp() == 1727140000


def test_empty_export(spark, tmp_path):
    (tmp_path / "b.html").write_text("<html></html>")
    with pytest.raises(Exception, match="b.html"):
        bookmarks.read_export(spark, str(tmp_path / "b.html"), "html").collect()


def test_profiles(tmp_path):
    for d in ("Profile 2", "Default", "Profile 1", "System"):
        (tmp_path / d).mkdir()
        if d != "Profile 1":
            (tmp_path / d / "Bookmarks").write_text("{}")
    (tmp_path / "Local State").write_text(json.dumps({"profile": {"info_cache": {"Default": {"name": "Me"}}}}))
    assert [(p, n) for p, n, _ in bookmarks.chrome_profiles(str(tmp_path))] == [("Default", "Me"), ("Profile 2", "Profile 2")]
    (tmp_path / "profiles.ini").write_text("[Profile0]\nPath=a\n[Profile1]\nPath=b\nDefault=1\n")
    assert bookmarks.firefox_places(str(tmp_path)) == str(tmp_path / "b" / "places.sqlite")
    (tmp_path / "profiles.ini").write_text("[Profile0]\nPath=a\n[Install1]\nDefault=c\n")
    assert bookmarks.firefox_places(str(tmp_path)) == str(tmp_path / "c" / "places.sqlite")
    with pytest.raises(FileNotFoundError):
        bookmarks.safari_file(home=str(tmp_path))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reader_answers(spark):
    text = "URL Source: https://tides.example.net/\nTitle: Tides: a table\n\nOther Field: 3\nPublished Time: 2001-02-03\n  Markdown Content:  \n\n# Tides\nTitle: of the text\n"
    assert tuple(one(spark, readers.reader_answer(F.lit(text)))) == ("Tides: a table", "https://tides.example.net/", "2001-02-03", "# Tides\nTitle: of the text")
    assert tuple(one(spark, readers.reader_answer(F.lit("Title: x\nnot a field\nTitle: y")))) == ("x", "", "", "not a field\nTitle: y")
    assert tuple(one(spark, readers.reader_answer(F.lit("no fields\nat all")))) == ("", "", "", "") and one(spark, readers.reader_answer(F.lit(None)))["body"] == ""
    front = "---\ntitle: T\npublished: 2024-05-01T00:00:00Z\n---\n\nBody\n"
    got = one(spark, readers.front_matter(F.lit(front)))
    assert (got["title"], got["published"], got["body"]) == ("T", "2024-05-01T00:00:00Z", "Body")
    assert one(spark, readers.front_matter(F.lit("---\ntitle: x\nno end")))["body"].startswith("---")
    assert one(spark, readers.front_matter(F.lit("---\ntitle: x\n---\n")))["body"] is None


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\nLanguage: en\n\n1\n00:00:00.000 --> 00:00:01.000 align:start\nhello <c>there</c>\n\n00:00:01.000 --> 00:00:02.000\nhello there\nworld\n" + "".join(f"line {k}\n" for k in range(5)) + "world\n"
    assert one(spark, readers.captions(F.lit(vtt))) == "hello there world line 0 line 1 line 2\n\nline 3 line 4 world"
    assert one(spark, readers.captions(F.lit("WEBVTT\n"))) == ""
    assert one(spark, readers.auto_captions(F.lit(vtt)))
    assert one(spark, readers.permanent_download_error(F.lit("ERROR: Private video"))) and not one(spark, readers.permanent_download_error(F.lit("timeout")))
    md = one(spark, readers.video_markdown(F.lit("T"), F.lit("C"), F.lit("20240102"), F.lit(65), F.lit(" d "), F.lit("")))
    assert md == "# T\n\n**Channel:** C\n**Published:** 2024-01-02\n**Duration:** 1:05\n\n## Description\n\nd\n"


def test_threads(spark):
    comments = F.array(F.struct(F.lit("bo").alias("author"), F.lit("2024-02-03T04:05:06Z").alias("created_at"), F.lit(" hi ").alias("body")))
    md = one(spark, readers.thread_markdown(F.lit("Bug"), F.lit(7), F.lit("o"), F.lit("r"), F.lit("closed (completed)"), F.lit("al"), F.lit(""), F.array(F.lit("a"), F.lit("b")), F.lit(3), F.lit("text"), comments))
    assert md == "# Bug (#7)\n\n**Repository:** o/r\n**State:** closed (completed)\n**Author:** al\n**Labels:** a, b\n**Comments:** 3\n\ntext\n\n## Comments\n\n### bo (2024-02-03)\n\nhi\n\n_(2 more comments not shown)_\n"
    assert one(spark, readers.pull_state(F.lit("open"), F.lit(False), F.lit(True))) == "draft"
    md = one(spark, readers.repository_markdown(F.lit(""), F.lit("Go"), F.lit(3), F.lit("MIT"), F.array(F.lit("x")), F.lit(True), F.lit(" R ")))
    assert md == "# (no description)\n\n**Language:** Go\n**Stars:** 3\n**License:** MIT\n**Topics:** x\n**Status:** archived\n\n## README\n\nR\n"
    assert one(spark, readers.wiki_markdown(F.lit("o"), F.lit("r"), F.lit("Getting-Started"), F.lit("c"))) == "# Getting Started\n\n**Repository:** o/r (wiki)\n\n## Content\n\nc\n"
    assert one(spark, readers.file_markdown(F.lit("o"), F.lit("r"), F.lit("a.py"), F.lit("d"), F.lit("Py"), F.lit(1), F.lit("c"))) == "# a.py\n\n**Repository:** o/r — d\n**Language:** Py | **Stars:** 1\n\n## Content\n\nc\n"


def test_answers_of_hosts(spark):
    meta = json.dumps({"description": "Tide tables", "language": "Go", "stargazers_count": 7, "license": {"name": "MIT"}, "topics": ["sea"], "archived": False, "more": 1})
    assert one(spark, hosts.repository(F.lit(meta), F.lit(" read "))) == "# Tide tables\n\n**Language:** Go\n**Stars:** 7\n**License:** MIT\n**Topics:** sea\n\n## README\n\nread\n"
    assert one(spark, hosts.repository(F.lit("{}"), F.lit(None).cast("string"))) == "# (no description)\n\n**Stars:** 0\n"
    assert one(spark, hosts.file(F.lit("o"), F.lit("r"), F.lit("a.go"), F.lit(meta), F.lit("x\n"))) == "# a.go\n\n**Repository:** o/r — Tide tables\n**Language:** Go | **Stars:** 7\n\n## Content\n\nx\n"
    issue = json.dumps({"title": "Wrong moon", "body": " It is full. ", "state": "closed", "state_reason": "completed", "user": {"login": "al"}, "labels": [{"name": "moon"}], "comments": 2})
    said = json.dumps([{"user": {"login": "bo"}, "body": "no", "created_at": "2001-02-03T04:05:06Z"}])
    want = "# Wrong moon (#5)\n\n**Repository:** o/r\n**State:** closed (completed)\n**Author:** al\n**Labels:** moon\n**Comments:** 2\n\nIt is full.\n\n## Comments\n\n### bo (2001-02-03)\n\nno\n\n_(1 more comments not shown)_\n"
    assert one(spark, hosts.issue(F.lit("o"), F.lit("r"), F.lit(5), F.lit(issue), F.lit(said))) == want
    pull = json.dumps({"title": "Fix", "state": "open", "draft": True, "base": {"ref": "main"}, "head": {"ref": "moon"}, "additions": 3, "deletions": 1, "changed_files": 2, "comments": 0, "pull_request": {}})
    want = "# Fix (#6)\n\n**Repository:** o/r\n**State:** draft\n**Branches:** main ← moon\n**Diff:** +3 −1 across 2 files\n**Comments:** 0\n"
    assert one(spark, hosts.pull(F.lit("o"), F.lit("r"), F.lit(6), F.lit(pull), F.lit("[]"))) == want
    assert one(spark, hosts.is_pull(F.lit(pull))) and not one(spark, hosts.is_pull(F.lit(issue)))
    video = json.dumps({"title": "Tides", "uploader": "Sea", "upload_date": "20010203", "duration": 61.5, "description": ""})
    assert one(spark, hosts.video(F.lit(video), F.lit("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nhello\n"))) == "# Tides\n\n**Channel:** Sea\n**Published:** 2001-02-03\n**Duration:** 1:01\n\n## Transcript\n\nhello\n"
    assert one(spark, hosts.retry_after(F.create_map(F.lit("retry-after"), F.lit("9")))) == 9 and one(spark, hosts.retry_after(F.create_map(F.lit("x"), F.lit("9")))) is None
    assert one(spark, hosts.retry_after(F.create_map(F.lit("x-ratelimit-remaining"), F.lit("0"), F.lit("x-ratelimit-reset"), F.lit("5")))) == 0


def test_rules_are_read_again(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    with pytest.raises(Exception, match="rules.yaml"):
        config.RulesFile(spark, str(path))
    path.write_text("rules:\n- fetcher: a\n")
    rules = config.RulesFile(spark, str(path))
    assert [r["fetcher"] for r in rules().collect()] == ["a"]
    path.write_text("rules:\n- fetcher: b\n- fetcher: c\n")
    assert [r["fetcher"] for r in rules().collect()] == ["b", "c"]
    path.write_text("nothing: good here")
    assert [r["fetcher"] for r in rules().collect()] == ["b", "c"] and rules.error is not None
    path.unlink()
    assert rules().count() == 2


def test_settings():
    s = config.load_settings("search: {bm25_weight: 0, rrf_k: 10}\nchunking: {size_tokens: 100}")
    assert s.search.bm25_weight == 1.0 and s.search.rrf_k == 10 and s.chunking.size_tokens == 100
    for bad in ("chunking: {overlap_tokens: 900}", "nothing: 1", "search: {collapse: mean}", "clustering: {min_similarity: 2}"):
        with pytest.raises(ValueError):
            config.load_settings(bad)


def test_judgements(spark):
    assert config.load_judgements(spark, "queries:\n- query: q\n  relevant: [a, b]\n").count() == 2
    for bad in ("queries: []", "queries:\n- query: ''\n  relevant: [a]", "queries:\n- query: q\n  relevant: []"):
        with pytest.raises(ValueError):
            config.load_judgements(spark, bad)
