"""What a fetched page is: its media type, how its fetch went, login walls and pages that are gone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import hostname, path_of, stripped

# Titles and paths that mark login walls and missing pages.
LOGIN_TITLE = r"(?i)^(sign in|log in|join now|join linkedin)"
LOGIN_PATH = r"(?i)/(login|authwall|signin|signup)\b"
GONE_TITLE = (
    r"(?i)(^\s*(error\s*)?404\b|^\s*not found\s*$|\b404\s+(error|not\s+found)\b"
    r"|page\s+(not\s+found|doesn[’']?t\s+exist|does\s+not\s+exist|can[’']?t\s+be\s+found|cannot\s+be\s+found|could\s+not\s+be\s+found|no\s+longer\s+(exists|available)|is\s+missing)"
    r"|page\b.{0,30}\b(has\s+been|was)\s+(removed|deleted)\b|couldn[’']?t\s+find\s+(this|that|the)\s+page)"
)
LEAST_TEXT = 500


def title(html: Column) -> Column:
    """The page's title as it stands in its markup, white space trimmed."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def is_readable(header: Column) -> Column:
    """Whether a content type can hold a page; a missing one may."""
    t = media_type(header)
    return t.isNull() | t.isin("", "application/xhtml+xml") | t.startswith("text/")


def is_pdf(header: Column, url: Column) -> Column:
    t = F.coalesce(media_type(header), F.lit(""))
    return (t == "application/pdf") | (t.isin("", "application/octet-stream") & F.lower(path_of(url)).endswith(".pdf"))


def fetch_class(status: Column) -> Column:
    """ok, anti_bot (another reader may get it), dead, or retry."""
    return F.when(status.between(200, 299), "ok").when(status.isin(403, 503), "anti_bot").when(status.isin(404, 410), "dead").otherwise("retry")


def gone(page_title: Column, source_url: Column, final_url: Column) -> Column:
    """Why a page that answered is missing all the same; null if it isn't."""
    bare = lambda u: F.btrim(path_of(u), F.lit("/"))
    home = (hostname(source_url) == hostname(final_url)) & (bare(source_url) != "") & (bare(final_url) == "") & ~final_url.rlike(r"^[^#]*\?[^#]")
    return F.when(home, "redirected to homepage").when(page_title.rlike(GONE_TITLE), F.concat(F.lit("title looks like a not-found page: "), page_title))


def login_wall(text: Column, page_title: Column, source_url: Column, final_url: Column) -> Column:
    """Why a page is a login wall rather than what was asked for; null if it isn't. Lengths are in bytes."""
    host, path = hostname(final_url), path_of(final_url)
    return (
        F.when(text.isNull(), "no article extracted")
        .when(F.octet_length(F.trim(text)) < LEAST_TEXT, "extracted text < 500 chars")
        .when(page_title.rlike(LOGIN_TITLE), "title looks like a login wall")
        .when((host != hostname(source_url)), F.concat(F.lit("redirected to a different host: "), host))
        .when(path.rlike(LOGIN_PATH), F.concat(F.lit("redirected to a login/auth path: "), path))
    )


def pdf_markdown(text: Column) -> Column:
    """A document's text with line feeds alone and two of them in a row at most."""
    return stripped(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n"))
