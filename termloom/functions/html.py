"""Reading repository pages: text, links, title, date and metadata.

A page is parsed once into a small tree and all fields are read off it in one Arrow UDF; title, links
and repository links also exist as plain expressions for tables that need nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.urls import RESERVED_OWNERS, normalize, normalize_url, resolve_link

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
MIN_README = 50

# fixed values: where repository pages hold their fields, in the order they are tried
DESCRIPTION_TEXT = (".f4.my-3", ".Layout-sidebar p", '[data-testid="repo-description"] p', "p.f4", "#repo-content-pjax-container p")
DESCRIPTION = (".f4.my-3", ".Layout-sidebar p", '[data-hovercard-type="repository"]')
DESCRIPTION_META = ('meta[property="og:description"]', 'meta[name="description"]')
README = ("#readme", "article.markdown-body", ".markdown-body")
LANGUAGE, TOPIC, RELATIVE_TIME, FORK = ".d-inline span.color-fg-default", ".topic-tag", "relative-time", "span.text-small"
STARS, ARCHIVED = ("#repo-stars-counter", ".social-count"), (".archived-notice", "[data-view-component] .flash-warn")
DATE_META = (
    'meta[property="article:published_time"]', 'meta[property="og:published_time"]', 'meta[name="date"]',
    'meta[name="publish-date"]', 'meta[name="DC.date"]', 'meta[property="article:modified_time"]',
)

PAGE_TYPE = (
    "text string, title string, published string, links array<string>, repoOwner string, repoName string, description string, language string, "
    "topics array<string>, stars string, lastCommitDate string, isFork boolean, isArchived boolean, lowContent boolean"
)


class Node:
    """An element of a page; text nodes are strings among its children."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements inside, in document order. Pages may be nested to any depth, so nothing here calls itself."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Node)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, waiting = [], list(reversed(self.children))
        while waiting:
            c = waiting.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                waiting += reversed(c.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_STEP = re.compile(r"([\w-]+)|#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:=\"([^\"]*)\")?\]")


def _fits(node: Node, step: str) -> bool:
    for tag, ident, cls, attr, value in _STEP.findall(step):
        if tag and node.tag != tag or ident and node.attrs.get("id") != ident or cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or value and node.attrs[attr] != value):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements that match tags, ids, classes and attributes, with blanks for "somewhere inside", in document order."""
    *outer, last = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector)
    for node in root.walk():
        if _fits(node, last):
            up, wanted = node.parent, list(outer)
            while up is not None and wanted:
                if _fits(up, wanted[-1]):
                    wanted.pop()
                up = up.parent
            if not wanted:
                yield node


def first(root: Node, selectors: tuple[str, ...] | str) -> Node | None:
    for s in (selectors,) if isinstance(selectors, str) else selectors:
        for node in select(root, s):
            return node
    return None


def plain_text(node: Node) -> str:
    """An element's text with line breaks around blocks, without scripts, styles and images."""
    out: list[str] = []
    # what is still to be read, the next one last: (part, whether it stands in pre); marks of ends are tuples
    waiting: list = [(c, False) for c in reversed(node.children)]
    while waiting:
        c, pre = waiting.pop()
        if isinstance(c, tuple):
            out.append(c[0])
        elif isinstance(c, str):
            out.append(c if pre else re.sub(r"\s+", " ", c))
        elif c.tag not in ("script", "style", "img"):
            block = c.tag in _BLOCK
            if block or c.tag == "br":
                out.append("\n")
            if c.tag == "li":
                out.append("* ")
            if block or c.tag in ("td", "th"):
                waiting.append((("\n" if block else " ",), pre))
            inside = pre or c.tag == "pre"
            waiting += [(x, inside) for x in reversed(c.children)]
    text = re.sub(r" *\n *", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def extract_text(root: Node) -> str:
    found = first(root, DESCRIPTION_TEXT)
    parts = [found.text().strip()] if found else []
    parts = [p for p in parts if p]
    if not parts:
        meta = first(root, DESCRIPTION_META)
        parts = [p for p in [meta.attrs.get("content", "").strip() if meta else ""] if p]
    readme = first(root, README)
    return "\n\n".join([*parts, plain_text(readme)] if readme else parts)


_FORMATS = ("%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d", "%m/%d/%Y", "%B %d, %Y %H:%M:%S", "%b %d, %Y %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%a %b %d %Y", "%a %b %d %Y %H:%M:%S")


def _iso(raw: str) -> str | None:
    """A date in ISO, mail or a written-out form as an ISO instant in UTC; null if it is none. Without zone it is UTC."""
    raw = raw.strip()
    at = None
    for read in (datetime.fromisoformat, parsedate_to_datetime, *(lambda x, f=f: datetime.strptime(x, f) for f in _FORMATS)):
        try:
            at = read(raw)
            break
        except (ValueError, TypeError, IndexError):
            continue
    if at is None:
        return None
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def extract_date(root: Node) -> str | None:
    """The first of the page's first time element and the first meta of each kind, in their order, that holds a date."""
    found = [(node, "datetime") for node in [first(root, "time[datetime]")]] + [(first(root, s), "content") for s in DATE_META]
    return next((d for d in (_iso(node.attrs.get(name, "")) for node, name in found if node) if d), None)


def extract_title(root: Node) -> str:
    meta = first(root, 'meta[property="og:title"]')
    title = first(root, "title")
    return ((meta.attrs.get("content") if meta else "") or (title.text() if title else "")).strip()


def extract_links(root: Node, url: str) -> list[str]:
    out: dict[str, None] = {}
    for a in select(root, "a[href]"):
        href = a.attrs["href"]
        if href and not re.match(r"(?:javascript|mailto|tel):", href, re.I) and not href.startswith("#"):
            try:
                target = normalize(urljoin(url, href))
            except ValueError:
                continue
            if target:
                out[target] = None
    return list(out)


def extract_metadata(root: Node, url: str) -> dict:
    segments = url.split("/")

    def text(selectors: tuple[str, ...] | str) -> str:
        node = first(root, selectors)
        return node.text().strip() if node else ""

    stars = text(STARS)
    if first(root, STARS) is None:
        meta = first(root, DESCRIPTION_META[0])
        found = re.search(r"([\d,]+)\s+star", meta.attrs.get("content", ""), re.I) if meta else None
        stars = found[1] if found else ""
    time = first(root, RELATIVE_TIME)
    return {
        "repoOwner": segments[3] if len(segments) > 3 else "", "repoName": segments[4] if len(segments) > 4 else "", "description": text(DESCRIPTION), "language": text(LANGUAGE),
        "topics": [t for t in (n.text().strip() for n in select(root, TOPIC)) if t], "stars": stars, "lastCommitDate": time.attrs.get("datetime", "") if time else "",
        "isFork": "forked from" in text(FORK).lower(), "isArchived": "archived" in text(ARCHIVED).lower(), "lowContent": len(text("#readme")) < MIN_README,
    }


def page_fields(html: str | None, url: str | None) -> dict:
    """Every field of PAGE_TYPE. A null page is an empty one."""
    root, url = parse(html or ""), url or ""
    return {"text": extract_text(root), "title": extract_title(root), "published": extract_date(root), "links": extract_links(root, url), **extract_metadata(root, url)}


def parse_page(html: Column, url: Column) -> Column:
    """The struct PAGE_TYPE of a page, read in one pass."""

    def read(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_fields(h, u) for h, u in zip(pages, urls)], columns=[f.split()[0] for f in PAGE_TYPE.split(", ")])

    read.__annotations__ = {"pages": pd.Series, "urls": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, PAGE_TYPE)(html, url)


def title_of(html: Column) -> Column:
    """og:title, else the title element, trimmed; '' if there is neither."""
    meta = F.nullif(F.regexp_extract(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1), F.lit(""))
    return F.trim(F.coalesce(meta, F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))


def hrefs_of(html: Column) -> Column:
    """The href of every anchor, in order, without script, mail, phone and fragment links."""
    all_ = F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\shref="([^"]*)"'), 1)
    return F.filter(all_, lambda h: ~h.rlike(r"(?i)^(javascript|mailto|tel):|^#|^$"))


def links_of(html: Column, url: Column) -> Column:
    """Canonical link targets, each once, in order; for pages whose links are absolute or rooted."""
    return F.array_distinct(F.filter(F.transform(hrefs_of(html), lambda h: F.when(h.rlike("^https?://"), h).when(h.rlike("^/(?!/)"), F.concat(F.regexp_extract(url, "^(https?://[^/?#]+)", 1), h))), lambda x: x.isNotNull()))


def repo_links_of(html: Column, base: str) -> Column:
    """base/owner/name for every two-part rooted href whose owner isn't reserved, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(r'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"'), 1)
    own = F.filter(found, lambda p: ~F.lower(F.substring_index(p, "/", 1)).isin(RESERVED_OWNERS))
    return F.transform(F.array_distinct(own), lambda p: F.concat(F.lit(base.rstrip("/") + "/"), p))


__all__ = ["hrefs_of", "links_of", "normalize_url", "page_fields", "parse_page", "repo_links_of", "resolve_link", "title_of"]
