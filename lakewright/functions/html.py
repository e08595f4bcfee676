"""Page distillation and selectors. Python functions over the standard library's reader, a batch of pages at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "noscript", "template"))
ALWAYS, IF_LONG = frozenset(("h1", "h2", "h3", "h4")), frozenset(("p", "li", "blockquote", "pre"))
MIN_BYTES = 12
ENDS_P = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article header footer nav aside form pre blockquote figure main hr dl address".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        """All text below in page order, white space as one blank."""
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in SILENT:
                todo.extend(reversed(x.children))
        return " ".join(" ".join(parts).split())

    def walk(self):
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(c for c in reversed(x.children) if not isinstance(c, str))


class Tree(HTMLParser):
    """Elements of a page; open paragraphs and items end where HTML says so, stray ends are ignored."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.at.tag == "p" or tag == "li" and self.at.tag == "li" or tag in ("td", "th") and self.at.tag in ("td", "th"):
            self.at = self.at.parent
        elif tag == "tr" and self.at.tag in ("td", "th", "tr"):
            self.at = self.at.parent.parent if self.at.tag != "tr" else self.at.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


_PART = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]|(\*)")


def _matches(x: Element, simple: str) -> bool:
    for kind, name, attr, value, _ in _PART.findall(simple):
        if attr:
            if attr not in x.attrs or "=" in simple and value and x.attrs[attr] != value:
                return False
        elif kind == "#" and x.attrs.get("id") != name or kind == "." and name not in x.attrs.get("class", "").split() or not kind and name and x.tag != name.lower():
            return False
    return bool(x.tag)


def select(root: Element, selector: str) -> list[Element]:
    """Elements by tag, #id, .class, [attr], [attr=value], descendants by blanks, children by > and unions by commas, in page order."""
    chains = [re.sub(r"\s*>\s*", " >", c).split() for c in selector.split(",") if c.strip()]

    def hit(x: Element, chain: list[str]) -> bool:
        """Whether x is the chain's last element and its ancestors hold the rest; a step that begins with > is a child."""
        if not _matches(x, chain[-1].lstrip(">")):
            return False
        if len(chain) == 1:
            return True
        up = x.parent
        if chain[-1].startswith(">"):
            return up is not None and hit(up, chain[:-1])
        while up is not None:
            if hit(up, chain[:-1]):
                return True
            up = up.parent
        return False

    return [x for x in root.walk() if any(hit(x, c) for c in chains)]


PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())]))),
        T.StructField("sections", T.ArrayType(T.StringType())),
        T.StructField("tables", T.ArrayType(T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))),
        T.StructField("forms", T.ArrayType(T.StructType([T.StructField("action", T.StringType()), T.StructField("method", T.StringType()), T.StructField("inputs", T.ArrayType(T.StringType()))]))),
    ]
)


def distil_page(url: str, page: str) -> dict:
    """Title (else first h1, else the URL), links once each by target and label, sections in order, tables and forms.

    Headings always are sections, paragraphs, items, quotes and preformatted text from 12 bytes on.
    """
    root = Tree(page).root
    found = {"title": "", "links": [], "sections": [], "tables": [], "forms": []}
    heading, seen = "", set()
    for x in root.walk():
        if x.tag == "title" and not found["title"]:
            found["title"] = x.text()
        elif x.tag == "a":
            href = x.attrs.get("href", "").strip()
            if href and not href.startswith("#") and not href.lower().startswith("javascript:"):
                try:
                    href = urljoin(url, href)
                except ValueError:
                    pass
                link = (href, x.text())
                if link not in seen:
                    seen.add(link)
                    found["links"].append({"href": link[0], "label": link[1]})
        elif x.tag == "table":
            rows = [r for r in x.walk() if r.tag == "tr" and next_table(r) is x]
            cells = [[(c.tag, c.text()) for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in rows]
            head = [t for _, t in cells[0]] if cells and cells[0] and all(k == "th" for k, _ in cells[0]) else []
            found["tables"].append({"headers": head, "rows": [[t for _, t in r] for r in cells[bool(head) :] if r]})
        elif x.tag == "form":
            names = [i.attrs.get("name") or i.attrs.get("id", "") for i in x.walk() if i.tag in ("input", "select", "textarea")]
            found["forms"].append({"action": x.attrs.get("action", ""), "method": x.attrs.get("method", "get").upper(), "inputs": names})
        if x.tag in ALWAYS or x.tag in IF_LONG:
            text = x.text()
            if x.tag == "h1" and not heading:
                heading = text
            if text and (x.tag in ALWAYS or len(text.encode()) >= MIN_BYTES):
                found["sections"].append(text)
    found["title"] = found["title"] or heading or url
    return found


def page_blocks(page: str) -> list[dict]:
    """(tag, text) of the sections that ``distil_page`` lists."""
    found = []
    for x in Tree(page).root.walk():
        if x.tag in ALWAYS or x.tag in IF_LONG:
            text = x.text()
            if text and (x.tag in ALWAYS or len(text.encode()) >= MIN_BYTES):
                found.append({"tag": x.tag, "text": text})
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])))
def blocks(page: pd.Series) -> pd.Series:
    return page.map(lambda p: page_blocks(p or ""))


def next_table(x: Element) -> Element | None:
    while x is not None and x.tag != "table":
        x = x.parent
    return x


@F.pandas_udf(PAGE)
def distil(url: pd.Series, page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([distil_page(u or "", p or "") for u, p in zip(url, page, strict=True)], columns=PAGE.names)


def selected_texts(selector: str):
    """A column function: the texts of the elements that a selector finds."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(page: pd.Series) -> pd.Series:
        return page.map(lambda p: [x.text() for x in select(Tree(p or "").root, selector)])

    return run


def markdown_page(sections, links) -> object:
    """A page's sections and links as Markdown, from the distilled columns."""
    listed = F.transform(links, lambda x: F.concat(F.lit("- ["), x["label"], F.lit("]("), x["href"], F.lit(")")))
    return F.array_join(F.concat(sections, listed), "\n")
