"""Pages to Markdown: the part of a page that holds its text, converted element by element.

The part is the page's article or main element if it has one with text, else the element with the best score: paragraphs count for the elements around
them, links against them, and what belongs to the best element beside it is joined to it. Menus, forms and what is no text are left out everywhere.
"""

from __future__ import annotations

import html.parser
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTRACTED = T.StructType([T.StructField(k, T.StringType()) for k in ("markdown", "title", "author", "language", "site", "published")])

_SKIPPED = frozenset("script style noscript template svg math iframe object form button select textarea nav footer aside head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_OWN_END = {"li": ("ul", "ol"), "p": (), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_META = {"og:title": "title", "author": "author", "article:author": "author", "og:site_name": "site", "article:published_time": "published", "date": "published"}
_PARAGRAPHS = frozenset("p pre blockquote ul ol dl table".split())
_COMMAS = ",،、，"
_SPACE, _BREAK = re.compile(r"\s+"), "\0"


class Node:
    """An element: its tag, attributes, and children, which are elements and texts."""

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = Node("", {})
        self.open = [self.root]
        self.about: dict[str, str] = {}
        self.titles: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "html" and own.get("lang"):
            self.about.setdefault("language", own["lang"])
        elif tag == "meta":
            name = _META.get((own.get("property") or own.get("name") or "").lower())
            if name and own.get("content", "").strip():
                self.about.setdefault(name, own["content"].strip())
        ends = _OWN_END.get(tag)
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].tag
            if name == tag and ends is not None or name == "p" and tag in _BLOCKS:
                del self.open[k:]
                break
            if name in _BLOCKS and (not ends or name in ends):
                break
        node = Node(tag, own)
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < 500:  # deeper elements are children of the last one
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "title":
            self.titles.append(data)
        self.open[-1].children.append(data)


def _every(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in _SKIPPED]
    return out


class _Measures:
    """For each element: characters of its text outside of links and within them, and commas; without what is skipped. One walk, however deep."""

    def __init__(self, every: list[Node]) -> None:
        self.plain, self.linked, self.commas, self.parent = {}, {}, {}, {}
        for n in reversed(every):  # children before their parents
            plain = linked = commas = 0
            for c in n.children:
                if isinstance(c, str):
                    plain += len(c.strip())
                    commas += sum(map(c.count, _COMMAS))
                elif c.tag not in _SKIPPED:
                    self.parent[id(c)] = n
                    plain, linked, commas = plain + self.plain[id(c)], linked + self.linked[id(c)], commas + self.commas[id(c)]
            if n.tag == "a":
                plain, linked = 0, plain + linked
            self.plain[id(n)], self.linked[id(n)], self.commas[id(n)] = plain, linked, commas

    def density(self, n: Node) -> float:
        """The share of an element's text that is in links."""
        all_ = self.plain[id(n)] + self.linked[id(n)]
        return self.linked[id(n)] / all_ if all_ else 0.0


def _candidates(every: list[Node], m: _Measures, least: int) -> dict[int, float]:
    """Scores of elements: each paragraph of at least so many characters counts for its parent, by half for that one's parent, and by a third beyond."""
    scores: dict[int, float] = {}
    for n in every:
        own = n.tag in _PARAGRAPHS or n.tag in ("div", "section", "td") and not any(isinstance(c, Node) and c.tag in _BLOCKS for c in n.children)
        size = m.plain[id(n)]
        if not own or size < least:
            continue
        points, up, share = 1 + m.commas[id(n)] + min(size / 100, 3), m.parent.get(id(n)), 1.0
        for level in range(2, 5):
            if up is None:
                break
            scores[id(up)] = scores.get(id(up), 0.0) + points * share
            up, share = m.parent.get(id(up)), 1 / level if level < 3 else 1 / 3
    return scores


def _joined(best: Node, score: float, scores: dict[int, float], m: _Measures) -> Node:
    """The best element with those beside it that hold text too: a score of a fifth of its own, or paragraphs with few links."""
    up = m.parent.get(id(best))
    if up is None:
        return best
    out = Node("div", {})
    for c in up.children:
        if isinstance(c, str) or c.tag in _SKIPPED:
            continue
        worth = scores.get(id(c), 0.0) * (1 - m.density(c))
        text = c.tag in _PARAGRAPHS and m.plain[id(c)] >= 80 and m.density(c) < 0.25
        if c is best or worth >= max(10, score / 5) or text or re.fullmatch("h[1-6]", c.tag) and out.children == []:
            out.children.append(c)
    return out if len(out.children) > 1 else best


def main_part(root: Node) -> Node:
    """The page's article or main element if it has one with a paragraph of text. Else the element with the best score, less its share of links, with what belongs to it
    beside it; if that has little text, shorter paragraphs count too, if they lead to nearly all text; at last the whole page."""
    every = _every(root)
    m = _Measures(every)
    named = [n for n in every if n.tag in ("article", "main") or n.attrs.get("role") == "main"]
    best = max(named, key=lambda n: m.plain[id(n)], default=None)
    if best is not None and m.plain[id(best)] >= 25:
        return best
    for least, enough in ((25, 250), (1, 0.9 * m.plain[id(root)])):
        if least == 1 and best is not None and m.plain[id(best)]:  # nothing else holds more than a few words
            return best
        scores = _candidates(every, m, least)
        rated = [(scores[id(n)] * (1 - m.density(n)), n) for n in every if id(n) in scores]
        score, found = max(rated, key=lambda x: x[0], default=(0.0, None))
        if found is not None and score > 0:
            found = _joined(found, score, scores, m)
            if sum(m.plain[id(c)] for c in (found.children if id(found) not in m.plain else [found])) >= enough:
                return found
    return root


def _inline(node: Node) -> str:
    """The text of an element, with emphasis, code, links and images; white space is one space, and line breaks are marked."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
            continue
        if c.tag in _SKIPPED:
            continue
        text = _inline(c)
        bare = text.strip()
        if c.tag == "br":
            out.append(_BREAK)
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})" if c.attrs.get("src") else "")
        elif not bare:
            out.append(text)
        elif c.tag == "a" and c.attrs.get("href"):
            out.append(f"[{bare}]({c.attrs['href']})")
        elif c.tag in ("b", "strong"):
            out.append(f"**{bare}**")
        elif c.tag in ("i", "em"):
            out.append(f"*{bare}*")
        elif c.tag in ("code", "kbd", "samp"):
            out.append(f"`{bare}`")
        elif c.tag in _BLOCKS:  # words of two blocks are never one
            out.append(f" {text} ")
        else:
            out.append(text)
    return _SPACE.sub(" ", "".join(out))


def _line(node: Node) -> str:
    return _SPACE.sub(" ", _inline(node).replace(_BREAK, " ")).strip()


def _raw(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _raw(c) for c in node.children)


def _indented(text: str, first: str, rest: str) -> str:
    return "\n".join((rest if k else first) + x if x else "" for k, x in enumerate(text.split("\n")))


def _rows(node: Node) -> tuple[list[Node], list[Node]]:
    """A table's rows, without those of tables in its cells; and what else stands in it: its captions, and text outside of cells."""
    rows, rest, todo = [], [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c.strip():
                rest.append(_holding([c]))
        elif c.tag == "tr":
            rows.append(c)
            rest += [_holding([x]) for x in c.children if (isinstance(x, Node) and x.tag not in ("td", "th", *_SKIPPED)) or (isinstance(x, str) and x.strip())]
        elif c.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(c.children)
        elif c.tag not in _SKIPPED:
            rest.append(_holding([c]))
    return rows, rest


def _holding(children: list) -> Node:
    out = Node("div", {})
    out.children = children
    return out


def _table(node: Node) -> list[str]:
    """A table as blocks: what stands outside of its rows, then its rows; cells with several blocks each as they are, one after the other, as a page laid out
    by a table has them."""
    found, rest = _rows(node)
    cells = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in found]
    out = [b for x in rest for b in blocks(x)]
    if any(sum(isinstance(x, Node) and x.tag in _BLOCKS for x in c.children) > 1 or any(isinstance(x, Node) and x.tag == "table" for x in c.children) for r in cells for c in r):
        return out + [b for r in cells for c in r for b in blocks(c)]
    rows = [r for r in ([_line(c).replace("|", "\\|") for c in r] for r in cells) if any(r)]
    if not rows:
        return out
    width = max(map(len, rows))
    line = lambda row: "| " + " | ".join([*row, *[""] * (width - len(row))]) + " |"
    return [*out, "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])]


def _items(node: Node) -> list[Node]:
    """A list's items; text and elements outside of them are items too."""
    out: list[Node] = []
    loose = None
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            out.append(c)
            loose = None
        elif isinstance(c, Node) or c.strip() or loose is not None:
            if loose is None:
                loose = Node("li", {})
                out.append(loose)
            loose.children.append(c)
    return out


def blocks(node: Node) -> list[str]:
    """Markdown blocks of an element's children."""
    out: list[str] = []
    run = Node("", {})

    def flush() -> None:
        text = "\n".join(x.strip() for x in _inline(run).split(_BREAK)).strip()
        if text:
            out.append(text)
        run.children = []

    for k, c in enumerate(node.children):
        if isinstance(c, str) or c.tag not in _BLOCKS:
            if isinstance(c, Node) and c.tag in _SKIPPED:
                continue
            run.children.append(c)
            continue
        flush()
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = _line(c)
            out += [f"{'#' * int(c.tag[1])} {text}"] if text else []
        elif c.tag == "pre":
            out.append("```\n" + _raw(c).strip("\n") + "\n```")
        elif c.tag == "blockquote":
            inner = "\n\n".join(blocks(c))
            out += ["\n".join(("> " + x).rstrip() for x in inner.split("\n"))] if inner else []
        elif c.tag in ("ul", "ol"):
            items = [(n, "\n\n".join(blocks(i))) for n, i in enumerate(_items(c), 1)]
            marks = [(f"{n}. " if c.tag == "ol" else "- ", t) for n, t in items if t]
            out += ["\n".join(_indented(t, m, " " * len(m)) for m, t in marks)] if marks else []
        elif c.tag == "table":
            out += _table(c)
        elif c.tag == "hr":
            out.append("---")
        else:
            out += blocks(c)
    flush()
    return out


def extract(page: str | None) -> dict[str, str | None]:
    """The Markdown of a page's main part, and what its head says of it; empty Markdown for a page without text."""
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    title = tree.about.get("title") or _SPACE.sub(" ", "".join(tree.titles)).strip()
    return {**dict.fromkeys(EXTRACTED.names), **tree.about, "title": title or None, "markdown": "\n\n".join(blocks(main_part(tree.root))).strip()}


@F.pandas_udf(EXTRACTED)
def extracted(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p) for p in pages], columns=EXTRACTED.names)


def strict(html: Column) -> Column:
    """html in which a reference without its semicolon stays the text that it is written as; HTML would decode some of these (&amp, &copy)."""
    return F.regexp_replace(html, r"&(?=#?[A-Za-z0-9]++(?!;))", "&amp;")
