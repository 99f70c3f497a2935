"""Bookmark exports: readers of four formats, and where browsers keep them."""

from __future__ import annotations

import configparser
import html.parser
import json
import os
import pathlib
import plistlib
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times, urls

ROW = T.StructType([T.StructField("path", T.StringType()), T.StructField("place", T.LongType()), T.StructField("raw_url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("folder_path", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("date", T.StringType())])
# How roots are shown.
CHROME_ROOTS = {"bookmark_bar": "Bookmarks Bar", "other": "Other Bookmarks", "synced": "Mobile Bookmarks"}
SAFARI_ROOTS = {"BookmarksBar": "Favorites", "BookmarksMenu": "Bookmarks Menu"}
FIREFOX_ROOTS = {"menu________": "Bookmarks Menu", "toolbar_____": "Bookmarks Toolbar", "unfiled_____": "Other Bookmarks", "mobile______": "Mobile Bookmarks"}
FIREFOX_ROOT, FIREFOX_TAGS, READING_LIST = "root________", "tags________", "com.apple.ReadingList"


class EmptyExport(ValueError):
    """A file without bookmarks."""


def folder_path(names: list[str]) -> str:
    return "".join("/" + n.strip().replace("/", "-") for n in names)


class _Netscape(html.parser.HTMLParser):
    """Follows DT, H3, DL and A: a list in an item stands in the folder that the item's heading names."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.folders: list[str | None] = []  # for each open list
        self.heading: str | None = None
        self.text: list[str] | None = None
        self.link: dict | None = None
        self.named: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {}
        for k, v in attrs:
            at.setdefault(k.lower(), v or "")
        if tag in ("dt", "dl", "a", "h3"):
            self._close()
        if tag == "dt":
            self.named = None
        elif tag == "h3":
            self.text, self.heading = [], ""
        elif tag == "dl":
            self.folders.append(self.named)
            self.named = None
        elif tag == "a":
            self.text, self.link = [], at

    def _close(self) -> None:
        if self.text is None:
            return
        text = "".join(self.text).strip()
        if self.link is not None:
            if self.link.get("href"):
                self.rows.append({"raw_url": self.link["href"], "title": text, "folder_path": folder_path([f for f in self.folders if f]), "tags": split_tags(self.link.get("tags", "")), "date": self.link.get("add_date", "")})
        elif self.heading is not None:
            self.named = text or None
        self.text = self.link = self.heading = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("a", "h3"):
            self._close()
        elif tag == "dl":
            self._close()
            if self.folders:
                self.folders.pop()

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._close()


def split_tags(text: str) -> list[str] | None:
    return [t.strip() for t in text.split(",") if t.strip()] or None


def netscape_rows(content: bytes) -> list[dict]:
    p = _Netscape()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    return p.rows


def chrome_rows(content: bytes) -> list[dict]:
    out: list[dict] = []

    def walk(node: dict, names: list[str]) -> None:
        kind = node.get("type")
        if kind == "url":
            out.append({"raw_url": node.get("url", ""), "title": node.get("name", "").strip(), "folder_path": folder_path(names), "tags": None, "date": node.get("date_added", "")})
            return
        name = node.get("name", "").strip() if kind == "folder" else ""
        for child in node.get("children") or ():
            walk(child, [*names, name] if name else names)

    roots = json.loads(content).get("roots") or {}
    for key in sorted(roots):
        for child in (roots[key].get("children") or ()) if isinstance(roots[key], dict) else ():
            walk(child, [CHROME_ROOTS.get(key, key)])
    return out


def safari_rows(content: bytes) -> list[dict]:
    out: list[dict] = []

    def walk(node: dict, names: list[str]) -> None:
        kind = node.get("WebBookmarkType")
        if kind == "WebBookmarkTypeLeaf":
            if node.get("URLString"):
                out.append({"raw_url": node["URLString"], "title": (node.get("URIDictionary") or {}).get("title", "").strip(), "folder_path": folder_path(names), "tags": None, "date": ""})
        elif kind != "WebBookmarkTypeProxy":
            name = node.get("Title", "").strip() if kind == "WebBookmarkTypeList" else ""
            for child in node.get("Children", ()):
                walk(child, [*names, name] if name else names)

    for root in plistlib.loads(content).get("Children", ()):
        ident = root.get("WebBookmarkIdentifier", "")
        if ident != READING_LIST:
            for child in root.get("Children", ()):
                walk(child, [SAFARI_ROOTS.get(ident) or root.get("Title") or "Other"])
    return out


_PARSERS = {"html": netscape_rows, "chrome": chrome_rows, "safari": safari_rows}


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Bookmarks of the files at path: (path, place, url, title, folder_path, tags, saved_at).

    kind is html, chrome or safari. url is canonical where the raw one has a canonical form. A file that can't be read, or
    without bookmarks, raises.
    """
    return parse_exports(spark.read.format("binaryFile").load(path).select("path", "content"), kind)


def parse_exports(files: DataFrame, kind: str) -> DataFrame:
    """Bookmarks of files (path, content), as read_export gives them."""
    parse = _PARSERS[kind]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                found = parse(content)
                if not found:
                    raise EmptyExport(p)
                yield pd.DataFrame([{"path": p, "place": k, **r} for k, r in enumerate(found)], columns=ROW.names)

    parsed = files.select("path", "content").mapInPandas(rows, ROW)
    saved = {"html": times.from_attribute, "chrome": times.from_1601_micros, "safari": lambda c: F.lit(None).cast("timestamp")}[kind]
    return _finished(parsed.withColumn("saved_at", saved(F.col("date"))).drop("date"))


def _finished(df: DataFrame) -> DataFrame:
    return df.select("path", "place", F.coalesce(urls.normalized(F.col("raw_url")), F.col("raw_url")).alias("url"), "title", "folder_path", "tags", "saved_at")


def firefox_tables(spark: SparkSession, places: str) -> tuple[DataFrame, DataFrame]:
    """(bookmarks, places) of a browser's own database, read on the driver where the file is.

    The file is opened read-only with its write-ahead log; the browser may be running.
    """
    with sqlite3.connect(f"file:{places}?mode=ro", uri=True) as db:
        marks = db.execute("select id, type, coalesce(parent, 0), coalesce(title, ''), coalesce(dateAdded, 0), coalesce(guid, ''), fk from moz_bookmarks").fetchall()
        pages = db.execute("select id, url from moz_places").fetchall()
    return (
        spark.createDataFrame(marks, "id long, type int, parent long, title string, date_micros long, guid string, fk long"),
        spark.createDataFrame(pages, "place_id long, url string"),
    )


def firefox_bookmarks(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks of moz_bookmarks and moz_places rows; those under the tags root are left out.

    Ancestors are found by joining each bookmark to the parent of what was found so far, a level at a time, until
    no bookmark has one left; a ring of parents ends where it began.
    """
    label = F.create_map(*(x for k, v in FIREFOX_ROOTS.items() for x in (F.lit(k), F.lit(v))))
    nodes = marks.select(F.col("id").alias("node"), F.col("parent").alias("up"), F.col("title").alias("name"), F.col("guid").alias("node_guid"))
    open_ = marks.where("type = 1").join(pages, F.col("fk") == F.col("place_id"), "left").where("url is not null and url <> ''")
    open_ = open_.select(F.col("id").alias("place"), "url", "title", "date_micros", F.col("parent").alias("at"), F.array().cast("array<string>").alias("names"), F.array(F.lit(0).cast("long")).alias("seen"))
    done = None
    while True:
        step = open_.join(nodes, F.col("at") == F.col("node"), "left")
        ends = F.col("node").isNull() | F.array_contains("seen", F.col("at")) | F.col("node_guid").isin(FIREFOX_ROOT, FIREFOX_TAGS, *FIREFOX_ROOTS)
        named = F.coalesce(label[F.col("node_guid")], F.trim("name"))
        add = F.col("node").isNotNull() & ~F.array_contains("seen", F.col("at")) & (F.col("node_guid") != FIREFOX_ROOT) & (named != "")
        step = step.withColumn("names", F.when(add, F.concat(F.array(named), F.col("names"))).otherwise(F.col("names")))
        ended = step.where(ends & (F.coalesce(F.col("node_guid"), F.lit("")) != FIREFOX_TAGS)).select("place", "url", "title", "date_micros", "names")
        done = ended if done is None else done.unionAll(ended)
        open_ = step.where(~ends).select("place", "url", "title", "date_micros", F.col("up").alias("at"), "names", F.concat(F.col("seen"), F.array("at")).alias("seen"))
        if open_.isEmpty():
            break
    path = F.when(F.size("names") == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.transform("names", lambda n: F.replace(F.trim(n), F.lit("/"), F.lit("-"))), "/")))
    return _finished(done.select(F.lit(None).cast("string").alias("path"), "place", F.col("url").alias("raw_url"), F.trim("title").alias("title"), path.alias("folder_path"), F.lit(None).cast("array<string>").alias("tags"), times.from_micros(F.col("date_micros")).alias("saved_at")))


# --- where browsers keep their files --------------------------------------------------------------------------


def chrome_profiles(root: str) -> list[tuple[str, str, str]]:
    """(profile, display name, bookmark file) of each profile that has bookmarks; Default first."""
    base = pathlib.Path(root)
    try:
        names = {k: v.get("name", "") for k, v in json.loads((base / "Local State").read_text())["profile"]["info_cache"].items()}
    except (OSError, ValueError, KeyError):
        names = {}
    found = [d.name for d in base.iterdir() if (d.name == "Default" or d.name.startswith("Profile ")) and (d / "Bookmarks").is_file()] if base.is_dir() else []
    return [(d, names.get(d) or d, str(base / d / "Bookmarks")) for d in sorted(found, key=lambda d: (d != "Default", d))]


def firefox_places(root: str) -> str:
    """The database of the profile that an installation, else the list of profiles, names as its default."""
    ini = configparser.ConfigParser(interpolation=None, strict=False)
    ini.optionxform = str
    ini.read(os.path.join(root, "profiles.ini"))
    profiles = [s for s in ini.sections() if s.startswith("Profile")]
    installs = [ini[s]["Default"] for s in ini.sections() if s.startswith("Install") and ini[s].get("Default")]
    marked = [ini[s]["Path"] for s in profiles if ini[s].get("Default") == "1" and ini[s].get("Path")]
    first = [ini[s]["Path"] for s in profiles if ini[s].get("Path")]
    for p in (*installs, *marked, *first):
        return os.path.join(p if os.path.isabs(p) else os.path.join(root, p), "places.sqlite")
    raise FileNotFoundError(f"no profile in {root}")


def safari_file(override: str | None = None, home: str | None = None) -> str:
    """The bookmark file: the override, else the one in the home folder."""
    found = override or os.path.join(home or os.path.expanduser("~"), "Library", "Safari", "Bookmarks.plist")
    if not os.path.isfile(found):
        raise FileNotFoundError(found)
    return found
