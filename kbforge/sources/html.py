"""HTML to (title, content, links) with the standard library's parser, as Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.functions.urls import DOCUMENT_ENDS, IMPORTANT, MARKERS, MEDIA_ENDS, REJECTED_PARTS, normal_url

def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_PAGE = _strings("title", "content")
#: Links of a page that are followed.
LINKS = 80
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of these names first.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
# What is taken out of a page, and where its content stands.
BASE_BOILERPLATE = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript"))
BOILERPLATE = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe"))
BASE_MAIN_CLASS = re.compile("content|main|article", re.I)
MAIN_CLASS = re.compile("content|main|article|entry|detail|wp_articlecontent", re.I)
MAIN_ID = re.compile("content|main|article|detail", re.I)


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, test: Callable[["Node"], bool]) -> "Node | None":
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            else:
                todo.extend(reversed(node.children))

    def text(self, between: str) -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag)
        if shut and self.open[-1].name in shut:
            self.open.pop()
            if tag == "tr" and self.open[-1].name == "tr":
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def without(node: Node, names: frozenset[str]) -> Node:
    for n in node.walk():
        n.children = [c for c in n.children if isinstance(c, str) or c.name not in names]
    return node


def main_part(root: Node, enhanced: bool) -> Node:
    tests = [lambda n: n.name == "main", lambda n: n.name == "article"]
    cls = MAIN_CLASS if enhanced else BASE_MAIN_CLASS
    tests.append(lambda n: n.name == "div" and any(cls.search(c) for c in n.attrs.get("class", "").split()))
    if enhanced:
        tests.append(lambda n: n.name == "div" and "id" in n.attrs and bool(MAIN_ID.search(n.attrs["id"])))
    tests.append(lambda n: n.name == "body")
    return next((found for t in tests if (found := root.find(t)) is not None), root)


def table_rows(main: Node) -> list[str]:
    rows = []
    for table in (n for n in main.walk() if n.name == "table" and n is not main):
        for row in (n for n in table.walk() if n.name == "tr"):
            cells = (re.sub(r"\s+", " ", c.text(" ")).strip() for c in row.walk() if c.name in ("td", "th"))
            line = " | ".join(c for c in cells if c)
            if line:
                rows.append(line)
    return rows


def lines_of(main: Node, least: int) -> list[str]:
    flat = (re.sub(r"\s+", " ", x).strip() for x in main.text("\n").split("\n"))
    return [x for x in flat if len(x) >= least]


def title_of(root: Node) -> str:
    node = root.find(lambda n: n.name == "title")
    return node.text("") if node else ""


def useful(url: str, anchor: str, title: str, domains: tuple[str, ...]) -> bool:
    """functions.urls.useful_link for one link, in the parser's process."""
    u = url.lower()
    if domains and not any(d.lower() in u for d in domains):
        return False
    if any(x in u for x in REJECTED_PARTS) or u.endswith(MEDIA_ENDS):
        return False
    if u.endswith(DOCUMENT_ENDS):
        return True
    text = f"{url} {anchor} {title}".lower()
    return any(k.lower() in text for k in IMPORTANT) or any(m in u for m in MARKERS)


def extract_base(html: str | None) -> tuple[str, str]:
    root = parse(html)
    title = title_of(root)
    return title, "\n".join(lines_of(main_part(without(root, BASE_BOILERPLATE), False), 8))


def extract(html: str | None, url: str, domains: tuple[str, ...] = (), cap: int = LINKS) -> tuple[str, str, list[tuple[str, str, str]]]:
    """Title and links come from the whole page, content from what is left without boilerplate."""
    root = parse(html)
    title = title_of(root)
    links, seen = [], set()
    for a in (n for n in root.walk() if n.name == "a" and "href" in n.attrs):
        child, anchor = normal_url(urljoin(url, a.attrs["href"])), a.text(" ")
        if child and child not in seen and child != url and useful(child, anchor, title, domains):
            seen.add(child)
            links.append((child, anchor, url))
    main = main_part(without(root, BOILERPLATE), True)
    lines = lines_of(main, 3)
    content = "\n".join(x for i, x in enumerate(lines) if i == 0 or lines[i - 1] != x)
    rows = table_rows(main)
    if rows:
        content += "\n\n[表格内容]\n" + "\n".join(rows)
    return title, content, links[:cap]


@F.pandas_udf(T.StringType())
def titles(html: pd.Series) -> pd.Series:
    """The titles alone."""
    return html.map(lambda h: title_of(parse(h)))


@F.pandas_udf(_PAGE)
def html_extract_base(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_base(h) for h in html], columns=["title", "content"])


def html_extract(domains: tuple[str, ...] = (), cap: int = LINKS):
    """UDF (html, url) to struct(title, content, links)."""

    @F.pandas_udf(T.StructType([*_PAGE.fields, T.StructField("links", T.ArrayType(_strings("url", "anchor", "from_url")))]))
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        names = ("url", "anchor", "from_url")
        rows = [extract(h, u or "", domains, cap) for h, u in zip(html, url)]
        return pd.DataFrame([(t, c, [dict(zip(names, x)) for x in links]) for t, c, links in rows], columns=["title", "content", "links"])

    return run


@F.pandas_udf(T.ArrayType(_strings("href", "anchor")))
def all_links(html: pd.Series) -> pd.Series:
    """Every link of a page as it is written."""
    return pd.Series([[{"href": n.attrs["href"], "anchor": n.text(" ")} for n in parse(h).walk() if n.name == "a" and "href" in n.attrs] for h in html])


@F.pandas_udf(T.ArrayType(T.StringType()))
def tables(html: pd.Series) -> pd.Series:
    return pd.Series([table_rows(main_part(without(parse(h), BOILERPLATE), True)) for h in html])
