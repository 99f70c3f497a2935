"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, each with the path of
tags above it. A bidirectional LSTM in numpy reads a vector of each block (hashed tags, classes and ids of
the path, hashed words, a few counts) and labels every block as main text or not with the whole document in
view. It is trained here, on pages that a generator lays out in many ways; no page of the corpus is
used.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, share

# --- blocks ------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*(?:>|\Z))|<|[^<]+", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements that end a run of text, those without an end tag, and those whose content is no text.
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe input legend li link main menu meta nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math object iframe title head".split())
_CLOSED_BY_BLOCK = "p"
_CLOSED_BY_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "math", "object", "iframe", "title")}

#: Of these, those that hold elements of their own name, and those that take the rest of a page if nothing ends them.
_NESTED = frozenset(("template", "svg", "math", "object"))
_TO_END = frozenset(("script", "style", "title"))

#: Bins of a block's vector: of the names on its path, of its words, and a few counts.
PATH_BINS, WORD_BINS, COUNTS = 160, 32, 6
SIZE = PATH_BINS + WORD_BINS + COUNTS

#: The vector of the names on a path, the innermost tag, and the tag around it.
Path = tuple[np.ndarray, str, str]
Block = tuple[Path, str, float]


_BINS: dict[str, tuple[int, int]] = {}


def _bin(name: str) -> tuple[int, int]:
    found = _BINS.get(name)
    if found is None:
        if len(_BINS) > 1 << 16:
            _BINS.clear()
        h = crc32(name.encode())
        found = _BINS[name] = (h % PATH_BINS, 1 if h & 0x10000 else -1)
    return found


class Open:
    """The elements that are open, innermost last. Each knows the vector of its path: the sum over the distinct tags, classes,
    ids and roles on it; it is that of the element around it if nothing new is added, so deep nesting costs no more than its tags."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.own: list[tuple[str, ...]] = []
        self.vectors = [np.zeros(PATH_BINS, dtype=np.float32)]
        self.times: Counter = Counter()
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []

    def nearest(self, tag: str) -> int:
        """The place of the innermost open element with this tag; -1 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, tag: str, marks: list[str]) -> None:
        own = (tag, *("." + m for m in marks))
        new = [x for x in dict.fromkeys(own) if not self.times[x]]
        v = self.vectors[-1]
        if new:
            v = v.copy()
            for x in new:
                k, sign = _bin(x)
                v[k] += sign
        self.times.update(own)
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.block_places.append(len(self.tags))
        self.tags.append(tag)
        self.own.append(own)
        self.vectors.append(v)

    def close(self, place: int) -> None:
        """Ends the element at this place and all within it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.times.subtract(self.own.pop())
            self.vectors.pop()
            self.places[tag].pop()
            if self.block_places and self.block_places[-1] == len(self.tags):
                self.block_places.pop()

    def begin_block(self, tag: str) -> None:
        """Ends what the start of this block ends: a paragraph, or an element of its own kind in the same list or table."""
        tops = _CLOSED_BY_OWN.get(tag)
        ends = max(self.nearest(_CLOSED_BY_BLOCK), self.nearest(tag) if tops else -1)
        stop = max(map(self.nearest, tops)) if tops else self.block_places[-1] if self.block_places else -1
        if ends >= 0 and ends >= stop:
            self.close(ends)

    def path(self) -> Path:
        return self.vectors[-1], self.tags[-1] if self.tags else "", self.tags[-2] if len(self.tags) > 1 else ""


def _nested_ends(page: str, name: str) -> dict[int, int]:
    """Where each element of this name that is ended ends, by where it starts."""
    found: dict[int, int] = {}
    begun: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                begun.append(m.start())
        elif begun:
            found[begun.pop()] = m.end()
    return found


def blocks(page: str | None) -> list[Block]:
    """(path, text, share of its letters that are in links) of each leaf block, in page order.

    Character references are decoded after tags are found; white space inside a block is one space. Unclosed
    tags are closed as browsers close them: a paragraph ends at the next block, a list item at the next one.
    A start tag of an element without text (svg, object, iframe) that nothing ends is passed over alone; script,
    style and title take the rest.
    """
    page = page or ""
    there = Open()
    out: list[Block] = []
    run: list[str] = []
    ends: dict[str, dict[int, int]] = {}
    open_ended: set[str] = set()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append((there.path(), text, min(1.0, linked / len(text))))
            run.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at, name = m.end(), m.group(2)
        if name is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                run.append(text)
                if there.nearest("a") >= 0:
                    linked += len(text.strip())
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK:
                flush()
            if (place := there.nearest(name)) >= 0:
                there.close(place)
            continue
        if name in _RAW_END and not m.group(3).endswith("/>"):
            if name in BLOCK:
                flush()
            if name in _NESTED:
                if name not in ends:
                    ends[name] = _nested_ends(page, name)
                at = ends[name].get(m.start(), at)
            elif name not in open_ended:
                close = _RAW_END[name].search(page, at)
                if close is None:
                    open_ended.add(name)
                at = close.end() if close else end if name in _TO_END else at
            continue
        if name == "br":
            run.append(" ")
        if name in BLOCK:
            flush()
            there.begin_block(name)
        if name not in VOID and not m.group(3).endswith("/>"):
            marks = [p for a in _ATTR.finditer(m.group(3)) for p in _PIECE.findall((a[1] or a[2] or a[3] or "").lower())] if len(m.group(3)) > 1 else []
            there.push(name, marks)
    flush()
    return out


# --- vectors -----------------------------------------------------------------------------------------------


def vectors(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """The vectors of a page's blocks, from first to before last."""
    some = page[first:last]
    x = np.zeros((len(some), SIZE), dtype=np.float32)
    for k, ((names, leaf, inner), text, linked) in enumerate(some):
        x[k, :PATH_BINS] = names
        for tag in ("leaf " + leaf if leaf else "", "in " + inner if inner else ""):
            if tag:
                at, sign = _bin(tag)
                x[k, at] += sign
        words = text.lower().split()
        h = np.fromiter(map(crc32, map(str.encode, words)), dtype=np.uint32, count=len(words))
        x[k, PATH_BINS : PATH_BINS + WORD_BINS] = np.bincount(h % WORD_BINS, weights=np.where(h & 0x10000, 0.3, -0.3), minlength=WORD_BINS) / np.sqrt(len(words))
        x[k, PATH_BINS + WORD_BINS :] = (np.log1p(len(words)) / 4, linked, text[-1] in ".!?…»\"”", text.count(",") / len(words), (first + k) / len(page), "©" in text)
    return x


# --- network -----------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM over the blocks in each direction; the label reads both states and the block itself."""

    def __init__(self, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.08, (SIZE, 4 * hidden))
            self.p["u" + d] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            self.p["c" + d] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        self.p["out"] = rng.normal(0, 0.1, 2 * hidden + SIZE)
        self.p["bias"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, there: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of (time, page) inputs, and what gradients need of each; where a page has no block the state stays."""
        n, h_ = x.shape[1], self.hidden
        h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
        states, tape = np.zeros((*x.shape[:2], h_), np.float32), []
        z_in = x @ self.p["w" + d] + self.p["c" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_in[t] + h @ self.p["u" + d]
            s = _sigmoid(z[:, : 3 * h_])
            i, f, o, g = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :], np.tanh(z[:, 3 * h_ :])
            m = there[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            states[t] = h
        return states, tape

    def logits(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        return self.read(lambda a, b: x[a:b], there)

    def read(self, part: Callable[[int, int], np.ndarray], there: np.ndarray, step: int = 4096) -> np.ndarray:
        """The logits of (time, page) blocks, whose vectors `part` gives from one time to another. Both directions run side by side, `step`
        blocks from either end at a time, so no more vectors than those are held."""
        h_, (n, pages) = self.hidden, there.shape
        p, out = self.p, np.zeros(there.shape, self.p["out"].dtype)
        out += p["bias"]
        u = np.stack([p["uf"], p["ub"]])
        h, c = np.zeros((2, pages, h_), u.dtype), np.zeros((2, pages, h_), u.dtype)
        for a in range(0, n, step):
            b = min(n, a + step)
            front, back = part(a, b), part(n - b, n - a)
            z_in = np.stack([front @ p["wf"] + p["cf"], (back @ p["wb"] + p["cb"])[::-1]], axis=1)
            m = np.stack([there[a:b], there[n - b : n - a][::-1]], axis=1)[..., None]
            every = bool(m.all())
            states = np.zeros((b - a, 2, pages, h_), u.dtype)
            with np.errstate(over="ignore"):
                for t in range(b - a):
                    z = z_in[t] + h @ u
                    s = 1 / (1 + np.exp(-z[..., : 3 * h_]))
                    c2 = s[..., h_ : 2 * h_] * c + s[..., :h_] * np.tanh(z[..., 3 * h_ :])
                    h2 = s[..., 2 * h_ :] * np.tanh(c2)
                    h, c = (h2, c2) if every else (np.where(m[t], h2, h), np.where(m[t], c2, c))
                    states[t] = h
            out[a:b] += states[:, 0] @ p["out"][:h_] + front @ p["out"][2 * h_ :]
            out[n - b : n - a] += (states[:, 1] @ p["out"][h_ : 2 * h_])[::-1]
        return out

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict:
        h_ = self.hidden
        run = {d: self._run(x, there, d) for d in "fb"}
        full = np.concatenate([run["f"][0], run["b"][0], x], axis=2)
        dz = (_sigmoid(full @ self.p["out"] + self.p["bias"]) - y) * there / max(1, there.sum())
        grads = {"out": np.einsum("tn,tnk->k", dz, full), "bias": dz.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            into = dz[:, :, None] * self.p["out"][k * h_ : (k + 1) * h_]
            gates = np.zeros((*x.shape[:2], 4 * h_), np.float32)
            gu = np.zeros_like(self.p["u" + d])
            dh, dc = np.zeros((x.shape[1], h_), np.float32), np.zeros((x.shape[1], h_), np.float32)
            for t, h, c, i, f, o, g, tc, m in reversed(run[d][1]):
                dh = dh + into[t]
                a = np.where(m, dh, 0)
                b = np.where(m, dc, 0) + a * o * (1 - tc * tc)
                gz = np.concatenate([b * g * i * (1 - i), b * c * f * (1 - f), a * tc * o * (1 - o), b * i * (1 - g * g)], axis=1)
                gates[t] = gz
                gu += h.T @ gz
                dh = np.where(m, 0, dh) + gz @ self.p["u" + d].T
                dc = np.where(m, b * f, dc)
            grads |= {"u" + d: gu, "w" + d: np.einsum("tnk,tng->kg", x, gates, optimize=True), "c" + d: gates.sum(axis=(0, 1))}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, there = np.zeros((longest, len(pages), SIZE), np.float32), np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], there[: len(p), k] = p, True
    return x, there


def label_pages(model: Labeller, pages: list[list[Block]], cell_limit: int = 8192) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length run together, cell_limit blocks at a time;
    a longer page runs alone, and its vectors are made bit by bit."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(pages[order[to]]) * (to - at + 1) <= cell_limit:
            to += 1
        if to == at + 1:
            page = pages[order[at]]
            out[order[at]] = model.read(lambda a, b, page=page: vectors(page, a, b)[:, None], np.ones((len(page), 1), bool))[:, 0] > 0
        else:
            x, there = padded([vectors(pages[k]) for k in order[at:to]])
            main = model.logits(x, there) > 0
            for j, k in enumerate(order[at:to]):
                out[k] = main[: len(pages[k]), j]
        at = to
    return out


# --- training ----------------------------------------------------------------------------------------------

_MAIN = ("content", "post", "entry", "article-body", "story", "main", "text", "page-content", "post-content", "article")
_ADS = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot")
_NOTICES = ("cookie-notice", "notice", "consent", "cookie-banner", "gdpr", "alert", "newsletter", "subscribe", "paywall", "popup", "modal")
_ASIDE = ("sidebar", "widget", "related", "side", "recommended", "popular", "trending", "share", "social", "tags", "breadcrumbs", "pagination")
_COMMENTS = ("comments", "comment", "comment-list", "replies", "disqus", "discussion", "responses", "reader-comments")
_SYLLABLES = [c + v for c in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "") for v in "aeiou"] + ["ø", "å", "ç", "ў", "жа", "ко", "нет", "は", "국", "文"]
_DECORATION = ("mt-4", "flex", "px-2", "col-6", "row", "clearfix", "text-lg", "bold", "wide", "is-active", "js-block", "u-left")


def training_page(rng: np.random.Generator) -> list[tuple[Block, int]]:
    """The blocks of a made-up page and whether each is main text."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    stops, decorated = rng.random(), chance(0.25)

    def words(low: int, high: int, stop: bool = True) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high))))
        w = ["".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5)))) + (pick(",,,;:") if chance(0.08) else "") for _ in range(n)]
        return (" ".join(w).capitalize() + (pick("....!?") if stop and chance(0.4 + 0.6 * stops) else "")).replace("&", "&amp;")

    def links(low: int, high: int) -> str:
        tag = pick(["ul", "ul", "ul", "ol", "div", "p", ""])
        items = [f'<a href="/{k}">{words(1, 6, False)}</a>' for k in range(int(rng.integers(low, high)))]
        inner = "".join(f"<li>{x}</li>" for x in items) if tag in ("ul", "ol") else pick([" ", "<br>", " | "]).join(items) if chance(0.6) else "".join(f"<span>{x}</span> " for x in items)
        return f"<{tag}>{inner}</{tag}>" if tag else inner

    def wrap(names: tuple[str, ...], inner: str, tags=("div", "section", "div")) -> str:
        more = " " + pick(_DECORATION) if decorated else pick(["", "", " box", "-1", " inner"])
        return f'<{(t := pick(tags))} {pick(["class", "class", "id"])}="{pick(names)}{more}">{inner}</{t}>'

    def role(name: str, inner: str) -> str:
        return f'<div role="{name}">{inner}</div>'

    def plain(tag: str, inner: str) -> str:
        return f'<{tag}{' class="' + pick(_DECORATION) + '"' if decorated else ""}>{inner}</{tag}>'

    boxes = {
        "ad": lambda: wrap(_ADS, words(2, 25) if chance(0.7) else f"<p>{words(2, 25)}</p>", ("div", "aside", "div")),
        "notice": lambda: wrap(_NOTICES, f"<p>{words(4, 40)}</p>" + ("<button>" + words(1, 3, False) + "</button>") * int(chance(0.5))),
        "aside": lambda: (wrap(_ASIDE, "<h3>" + words(1, 4, False) + "</h3>" + (links(2, 9) if chance(0.7) else f"<p>{words(5, 60)}</p>")) if chance(0.6) else f"<aside>{links(2, 8) if chance(0.6) else '<p>' + words(5, 80) + '</p>'}</aside>"),
        "form": lambda: f"<form action='/s'><label>{words(1, 4, False)}</label><input name=q><select><option>{words(1, 3, False)}<option>{words(1, 3, False)}</select><button>{words(1, 2, False)}</button>" + f"<p>{words(3, 30)}</p>" * int(chance(0.4)) + "</form>",
    }

    def paragraph() -> str:
        kind = rng.random()
        body = words(1, 160)
        if chance(0.12):
            body = body[: len(body) // 2] + f" <a href='#'>{words(1, 4, False)}</a> <b>{words(1, 3, False)}</b> " + body[len(body) // 2 :]
        if kind < 0.74:
            return f"<p>{'<b>' * int(chance(0.1))}{body}" + ("</p>" if chance(0.85) else "<br>")
        if kind < 0.84:
            return f"<h{(k := int(rng.integers(2, 5)))}>{words(1, 10, False)}</h{k}>"
        if kind < 0.90:
            tag = pick(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{words(2, 30)}" + "</li>" * int(chance(0.8)) for _ in range(int(rng.integers(1, 7)))) + f"</{tag}>"
        if kind < 0.91:
            return "<dl>" + "".join(f"<dt>{words(1, 4, False)}</dt><dd>{words(3, 30)}</dd>" for _ in range(int(rng.integers(1, 4)))) + "</dl>"
        if kind < 0.94:
            return f"<blockquote>{'<p>' * int(chance(0.5))}{words(5, 60)}</blockquote>"
        if kind < 0.96:
            return f"<pre>{words(4, 40)}</pre>"
        if kind < 0.98:
            return "<table>" + "".join(f"<tr><td>{words(1, 6, False)}</td><td>{words(1, 8, False)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src='a.png'><figcaption>{words(3, 20)}</figcaption></figure>"

    marked: list[str] = []  # main text parts are kept apart by a mark in their tags

    def article() -> str:
        inner = [f"<h1>{words(1, 14, False)}</h1>"] * int(chance(0.85)) + [paragraph() for _ in range(int(np.exp(rng.uniform(0, 3.2))))]
        for k in range(len(inner)):
            marked.append(inner[k])
            inner[k] = f"\x01{inner[k]}\x02"
        for _ in range(int(rng.integers(0, 3)) * int(chance(0.5))):
            inner.insert(int(rng.integers(len(inner) + 1)), pick([boxes["ad"], boxes["aside"], boxes["notice"], boxes["form"]])())
        body = "".join(inner)
        if chance(0.45):
            return f"<article{pick(['', '', ' class=post', ' id=main', ' class=' + pick(_DECORATION)])}>{body}</article>"
        if chance(0.3):
            return plain("main", body)
        if chance(0.1):
            return role("main", body)
        return wrap(_MAIN, body) if chance(0.9) else body

    def comments() -> str:
        one = lambda: f'<div class="{pick(["comment", "reply", "comment-body", "c"])}"><p>{words(2, 60)}</p></div>'
        inner = f"<h{(k := int(rng.integers(2, 5)))}>{words(1, 4, False)}</h{k}>" + "".join(one() for _ in range(int(rng.integers(1, 7)))) + boxes["form"]() * int(chance(0.3))
        if chance(0.5):
            inner = inner.replace("<div", "<li").replace("</div", "</li")
        return wrap(_COMMENTS, inner)

    nav = lambda: f"<nav{pick(['', ' class=menu', ' class=sidebar', ' class=' + pick(_DECORATION)])}>{links(2, 9)}</nav>" if chance(0.65) else role("navigation", links(2, 9)) if chance(0.2) else wrap(("nav", "menu", "topbar", "navbar", "navigation"), links(2, 9), ("div", "ul", "div"))
    header = lambda: f"<header>{'<h1>' + words(1, 4, False) + '</h1>' if chance(0.3) else '<p>' + words(1, 8, False) + '</p>'}{nav() if chance(0.5) else ''}</header>" if chance(0.65) else role("banner", f"<p>{words(1, 10)}</p>") if chance(0.2) else wrap(("header", "masthead", "site-header", "logo"), f"<p>{words(1, 10)}</p>")
    footer = lambda: f"<footer>{pick(['', '&copy; ', '&copy; 2024 '])}{words(1, 30)}{links(2, 6) if chance(0.4) else ''}</footer>" if chance(0.7) else role("contentinfo", f"<p>{words(1, 20)}</p>") if chance(0.2) else wrap(("footer", "site-footer", "copyright", "legal"), f"<p>&copy; {words(1, 25)}</p>", ("div", "p", "div"))
    before = [f() for f, p in ((header, 0.5), (nav, 0.7), (boxes["notice"], 0.3), (boxes["ad"], 0.5), (boxes["aside"], 0.25), (boxes["form"], 0.15)) if chance(p)]
    after = [f() for f, p in ((boxes["ad"], 0.2), (boxes["aside"], 0.35), (comments, 0.4), (boxes["form"], 0.15), (boxes["notice"], 0.15)) if chance(p)]
    rng.shuffle(before)
    rng.shuffle(after)
    middle = article()
    if chance(0.06):  # a page laid out by a table
        beside = f'<td{pick(["", " class=menu", " class=nav", " width=150"])}>{links(2, 9)}</td>'
        cells = [beside, f'<td{pick(["", " class=content", " class=main"])}>{middle}</td>']
        middle = f"<table><tr>{''.join(cells if chance(0.8) else cells[::-1])}</tr></table>"
    body = "".join([*before, middle, *after, footer() if chance(0.75) else ""])
    if chance(0.3):
        body = f'<div class="{pick(["container", "wrapper", "page", "layout", *_DECORATION])}">{body}</div>'
    page = f"<html><head><title>{words(1, 8)}</title></head><body>{body}</body></html>"
    # a block is main text if it stands between the marks, which are part of its text here
    out, inside = [], False
    for path, text, linked in blocks(page.replace("\x01", "<hr>\x01<hr>").replace("\x02", "<hr>\x02<hr>")):
        if text in ("\x01", "\x02"):
            inside = text == "\x01"
        else:
            out.append(((path, text, linked), int(inside)))
    return out


_TRAINED: dict[tuple, Labeller] = {}


def train(pages: int = 900, epochs: int = 10, hidden: int = 16, batch: int = 20, seed: int = 3) -> Labeller:
    """The labeller, trained on made-up pages; the same parameters give the same one, which is kept."""
    key = (pages, epochs, hidden, batch, seed)
    if key in _TRAINED:
        return _TRAINED[key]
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        rows = training_page(rng)
        if rows:
            made.append((vectors([b for b, _ in rows]), np.array([y for _, y in rows], np.float32)))
    made.sort(key=lambda p: len(p[0]))
    groups = [made[k : k + batch] for k in range(0, len(made), batch)]
    model = Labeller(hidden, seed)
    m, v, t = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    steps = epochs * len(groups)
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            x, there = padded([a for a, _ in groups[k]])
            y = np.zeros(there.shape, np.float32)
            for j, (_, b) in enumerate(groups[k]):
                y[: len(b), j] = b
            # classes of the corpus may be unknown: the network learns to do without some of the path
            x = x * (rng.random(SIZE) > 0.05)
            t += 1
            for name, g in model.gradients(x.astype(np.float32), there, y).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                rate = 0.02 * (1 - (t - 1) / steps)
                model.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    _TRAINED[key] = model
    return model


# --- operator ----------------------------------------------------------------------------------------------


def main_texts(model: Labeller, pages: Iterator[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b[1] for b, keep in zip(page, main, strict=True) if keep) for page, main in zip(found, label_pages(model, found), strict=True)]


def extract(df: DataFrame, html_col: str = "html", model: Labeller | None = None, rows: int = 512) -> DataFrame:
    """df with text, the main text of each page, and n_chars, its code points.

    A null or empty page, or one without main text, gives an empty text; repeated pages give the same one. Pages are read whole, `rows`
    at a time. Columns of df by these names are an error.
    """
    fresh(df, "text", "n_chars")
    held = share(df.sparkSession, model or train())

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        out: list[str] = []
        for k in range(0, len(pages), rows):
            out += main_texts(held(), pages.iloc[k : k + rows])
        return pd.Series(out, dtype=object)

    return df.withColumn("text", of(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
