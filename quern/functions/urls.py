"""URL rules: the canonical form that identifies a document, and what a URL says about its kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track visits, in lower case, and prefixes of such names.
TRACKING = (
    "fbclid gclid msclkid dclid yclid ttclid twclid igshid _ga _gl _gid ref ref_src ref_url oly_anon_id oly_enc_id vero_id hsctatracking "
    "_hsenc _hsmi sb_referer trk trk_contact trk_msg trk_module s_cid mkt_tok pk_campaign pk_kwd pk_keyword piwik_campaign piwik_kwd"
).split()
TRACKING_PREFIXES = ("utm_", "mc_", "vero_", "_hs")
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")
NOT_OWNERS = ("settings", "marketplace", "explore", "topics", "trending", "login", "signup")
BROWSER_PREFIXES = ("chrome://", "chrome-extension://", "about:", "edge://", "brave://", "safari-resource:", "opera://", "vivaldi://", "arc://")

_HEX = set("0123456789abcdefABCDEF")
_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_.~")
#: Characters that a path may hold as they are.
_IN_PATH = _PLAIN | set("$&+,/:;=@") | set("!'()*[]%")
_ESCAPED_PATH_KEEPS = _PLAIN | set("$&+,/:;=@")
_IN_HOST = _PLAIN | set("!$&'()*+,;=:[]<>\"")


class BadUrl(ValueError):
    """The text is empty, has no scheme, or is no URL."""


def _unescape(s: str, plus: bool = False) -> bytes:
    out, k = bytearray(), 0
    while k < len(s):
        if s[k] == "%":
            if len(s) < k + 3 or s[k + 1] not in _HEX or s[k + 2] not in _HEX:
                raise BadUrl(f"bad escape in {s!r}")
            out.append(int(s[k + 1 : k + 3], 16))
            k += 3
            continue
        out += b" " if plus and s[k] == "+" else s[k].encode("utf-8", "surrogatepass")
        k += 1
    return bytes(out)


def _escape(raw: bytes, keep: set[str], plus: bool = False) -> str:
    return "".join("+" if plus and b == 32 else chr(b) if b < 128 and chr(b) in keep else f"%{b:02X}" for b in raw)


class Parts:
    """A URL taken apart: scheme, user (with its @), host, port, path as written, query (None: no question mark)."""

    def __init__(self, text: str) -> None:
        if any(ord(c) < 32 or ord(c) == 127 for c in text):
            raise BadUrl("control character")
        rest = text.partition("#")[0]
        self.scheme, colon, after = rest.partition(":")
        if not colon or not self.scheme or not self.scheme[0].isascii() or not self.scheme[0].isalpha() or not all(c.isascii() and (c.isalnum() or c in "+-.") for c in self.scheme):
            if rest[:1] == ":" or not colon or "/" in self.scheme:
                raise BadUrl("no scheme")
            raise BadUrl("first path segment with a colon")
        self.scheme = self.scheme.lower()
        before, mark, query = after.partition("?")
        self.query: str | None = query if mark else None
        self.user = self.host = self.port = ""
        self.rooted = before.startswith("/")
        self.authority = before.startswith("//")
        self.path = before
        if self.authority:
            where, slash, path = before[2:].partition("/")
            self.path = slash + path
            user, at, where = where.rpartition("@")
            self.user = user + at
            if where.startswith("["):
                inner, close, port = where[1:].partition("]")
                if not close or (port and not port.startswith(":")):
                    raise BadUrl("bad host")
                self.host, self.port = inner, port[1:]
            else:
                self.host, colon, self.port = where.partition(":")
            if not all(c in "0123456789" for c in self.port):
                raise BadUrl("bad port")
            if any(ord(c) < 128 and c not in _IN_HOST and c != "%" for c in self.host):
                raise BadUrl("bad host")
            self.host = _unescape(self.host).decode("utf-8", "replace")
        if self.rooted:
            _unescape(self.path)

    def written_path(self) -> str:
        """The path as it stands if all its characters may, else escaped anew."""
        if all(c in _IN_PATH for c in self.path):
            return self.path
        return _escape(_unescape(self.path), _ESCAPED_PATH_KEEPS)

    def clear_path(self) -> str:
        return _unescape(self.path).decode("utf-8", "replace") if self.rooted else ""

    def values(self) -> dict[str, list[str]]:
        """The query's parameters; what can't be decoded is left out."""
        out: dict[str, list[str]] = {}
        for part in (self.query or "").split("&"):
            if part and ";" not in part:
                key, _, value = part.partition("=")
                try:
                    out.setdefault(_unescape(key, True).decode("utf-8", "surrogateescape"), []).append(_unescape(value, True).decode("utf-8", "surrogateescape"))
                except BadUrl:
                    continue
        return out

    def video(self) -> str | None:
        host = self.host.lower()
        if host not in VIDEO_HOSTS:
            return None
        path = self.clear_path().removeprefix("/").split("/")
        if host == "youtu.be":
            return path[0] or None
        first = self.values().get("v", [""])[0]
        if first:
            return first
        return path[1] or None if len(path) == 2 and path[0] in ("shorts", "live", "embed", "v") else None


def is_tracking(name: str) -> bool:
    return name.lower() in TRACKING or name.lower().startswith(TRACKING_PREFIXES)


def normalize(text: str | None) -> str:
    """The canonical form of a URL; raises BadUrl.

    Scheme and host in lower case, without default port, fragment and tracking parameters; other
    parameters sorted by name and form-encoded, equal names in their order. Path, trailing slash and user
    stay. A video page becomes its watch page, under its own scheme.
    """
    text = (text or "").strip()
    if not text:
        raise BadUrl("empty")
    u = Parts(text)
    if not u.rooted:  # such as mailto:
        return f"{u.scheme}:{u.path}" + _query(u)
    host = u.host.lower()
    if u.port and (u.scheme, u.port) not in (("http", "80"), ("https", "443")):
        host += f":{u.port}"
    host = _escape(host.encode("utf-8", "surrogateescape"), _IN_HOST)
    lead = f"{u.scheme}://{u.user}" if u.authority else f"{u.scheme}:"
    video = u.video()
    if video is not None:
        return f"{u.scheme}://{u.user}www.youtube.com/watch?v={video}"
    return lead + (host if u.authority else "") + u.written_path() + _query(u)


def _query(u: Parts) -> str:
    if u.query is None:
        return ""
    if not u.query:
        return "?"
    enc = lambda s: _escape(s.encode("utf-8", "surrogateescape"), _PLAIN, True)
    parts = [f"{enc(k)}={enc(v)}" for k, vs in sorted(u.values().items(), key=lambda kv: kv[0].encode("utf-8", "surrogateescape")) if not is_tracking(k) for v in vs]
    return "?" + "&".join(parts) if parts else ""


def normalize_or_none(text: str | None) -> str | None:
    try:
        return normalize(text)
    except BadUrl:
        return None


@F.pandas_udf(T.StringType())
def _normalize_any(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else normalize_or_none(t) for t in texts], dtype=object)


#: URLs of this form need no decoding: the JVM normalises them alone.
PLAIN_URL = r"^https?://[a-z0-9][a-z0-9.-]*(/[A-Za-z0-9_.~/-]*)?(\?[A-Za-z0-9_.~-]+(=[A-Za-z0-9_.~-]*)?(&[A-Za-z0-9_.~-]+(=[A-Za-z0-9_.~-]*)?)*)?(#[\x21-\x7E]*)?$"
_VIDEO_URL = r"^https?://((www\.|m\.)?youtube\.com|youtu\.be)(/|\?|#|$)"


def tracking_name(name: Column) -> Column:
    low = F.lower(name)
    found = low.isin(*TRACKING)
    for p in TRACKING_PREFIXES:
        found = found | low.startswith(p)
    return found


def parameters(url: Column) -> Column:
    """The query's parameters in their order: array of (name, place, value), undecoded."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p, k: F.struct(F.substring_index(p, "=", 1).alias("name"), k.alias("place"), p.alias("part")))


def normalized(url: Column) -> Column:
    """The canonical form of a column of URLs, null where there is none.

    Plain URLs, which need no decoding, are rewritten by expressions; the rest, which is null to the Python function
    otherwise, by `normalize`.
    """
    plain = url.rlike(PLAIN_URL) & ~url.rlike(_VIDEO_URL)
    kept = F.array_sort(F.filter(parameters(url), lambda p: ~tracking_name(p["name"])))
    query = F.array_join(F.transform(kept, lambda p: F.when(p["part"].contains("="), p["part"]).otherwise(F.concat(p["part"], F.lit("=")))), "&")
    simple = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(plain, simple).otherwise(_normalize_any(F.when(~plain, url)))


@F.pandas_udf(T.StringType())
def hostname_exact(texts: pd.Series) -> pd.Series:
    def host(t):
        try:
            return Parts((t or "").strip()).host.lower()
        except BadUrl:
            return None

    return pd.Series([host(t) for t in texts], dtype=object)


def stripped(text: Column) -> Column:
    """text without white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def hostname(url: Column) -> Column:
    """The host in lower case, without user and port; null without an authority."""
    found = F.lower(F.regexp_extract(stripped(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?\[?([^/?#:\]]*)", 1))
    return F.when(found != "", found)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda p: p != "")


def video_id(url: Column) -> Column:
    """The id of a video page; null for other URLs, playlists included."""
    host = hostname(url)
    raw = F.split(F.regexp_replace(path_of(url), "^/", ""), "/")
    v = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    short = F.get(raw, F.lit(0))
    sub = F.when((F.size(raw) == 2) & short.isin("shorts", "live", "embed", "v"), F.get(raw, F.lit(1)))
    found = F.when(host == "youtu.be", short).when(v != "", v).otherwise(sub)
    return F.when(host.isin(*VIDEO_HOSTS) & (found != ""), found)


def repository(url: Column) -> Column:
    """(owner, repo, type, ref, path, number) of a code host's page; null for other pages.

    type is repo, file, issue, pull, wiki or other.
    """
    p = path_parts(url)
    at = lambda k: F.get(p, F.lit(k))
    n = F.size(p)
    number = F.when(at(3).rlike(r"^\+?[0-9]{1,18}$"), at(3).cast("long"))
    numbered = number.isNotNull() & (number > 0)
    kind = (
        F.when((n >= 4) & (at(2) == "blob"), "file")
        .when((n >= 4) & (at(2) == "tree"), "repo")
        .when((n >= 4) & (at(2) == "issues"), F.when(numbered, "issue").otherwise("other"))
        .when((n >= 4) & (at(2) == "pull"), F.when(numbered, "pull").otherwise("other"))
        .when((n >= 3) & (at(2) == "wiki"), "wiki")
        .when(n >= 4, "other")
        .when((n == 3) & at(2).isin("issues", "pulls", "actions", "releases", "tags"), "other")
        .otherwise("repo")
    )
    rest = F.array_join(F.slice(p, 5, F.greatest(F.lit(0), n - 4)), "/")
    return F.when(
        (hostname(url) == "github.com") & (n >= 2) & ~at(0).isin(*NOT_OWNERS),
        F.struct(
            at(0).alias("owner"),
            at(1).alias("repo"),
            kind.alias("type"),
            F.when((n >= 4) & at(2).isin("blob", "tree"), at(3)).otherwise("").alias("ref"),
            F.when(kind == "file", rest).when((kind == "wiki") & (n == 3), "Home").when(kind == "wiki", F.array_join(F.slice(p, 4, F.greatest(F.lit(0), n - 3)), "/")).otherwise("").alias("path"),
            F.when(kind.isin("issue", "pull"), number).otherwise(0).cast("long").alias("number"),
        ),
    )


def filter_reason(url: Column) -> Column:
    """Why a URL can't be fetched and indexed; null if it can."""
    text = stripped(url)
    low = F.lower(text)
    internal = low.startswith(BROWSER_PREFIXES[0])
    for p in BROWSER_PREFIXES[1:]:
        internal = internal | low.startswith(p)
    return (
        F.when(url.isNull() | (text == ""), "empty")
        .when(low.startswith("javascript:"), "javascript")
        .when(low.startswith("file:"), "local_file")
        .when(internal, "browser_internal")
        .when(~(low.startswith("http://") | low.startswith("https://")), "unsupported_scheme")
        .when(normalized(url).isNull(), "invalid_url")
    )


def host_matches(host: Column, rule_kind: Column, rule_hosts: Column) -> Column:
    """Whether a dispatch rule covers a host. rule_kind: host, host_suffix, host_in or any."""
    suffix = F.regexp_replace(F.lower(F.get(rule_hosts, F.lit(0))), r"^\.", "")
    return (
        F.when(rule_kind == "any", True)
        .when(rule_kind == "host_suffix", (host == suffix) | host.endswith(F.concat(F.lit("."), suffix)))
        .otherwise(F.array_contains(F.transform(rule_hosts, F.lower), host))
    )
