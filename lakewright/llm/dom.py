"""A forgiving HTML reader: block elements and runs of text as a tree in page order, in linear time on any markup."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
DELIMITER = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML: elements by kind.
RAW = frozenset("script style textarea title noscript template iframe noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var label math mi mn mo mrow ms msub msup mtext".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"},
}
#: An element that the closing above doesn't look beyond.
SCOPE = frozenset("ul ol dl table select body html article section div".split())
#: Elements this deep get no children of their own: what follows stands beside them, as in browsers.
MAX_DEPTH = 512


class Node:
    """A block element, or a run of text if ``tag`` is empty."""

    __slots__ = ("tag", "attrs", "parent", "depth", "text", "linked")

    def __init__(self, tag: str, attrs: str, parent: int, depth: int) -> None:
        self.tag, self.attrs, self.parent, self.depth, self.text, self.linked = tag, attrs, parent, depth, "", 0


class Tags:
    """The tags of a page. A tag ends at the first > outside quotes, or if there is none at the first >."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # quotes outside quotes, from which no tag has been found to end

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends before ``at``, or -1."""
        if at > self.last[">"]:
            return -1
        seen, start = [], at
        while found := DELIMITER.search(self.page, at):
            here, c = found.start(), found[0]
            if c == ">":
                return here
            seen.append(here)
            if here in self.dead or here == self.last[c]:
                break
            at = self.page.find(c, here + 1) + 1
        self.dead.update(seen)
        return self.page.find(">", start)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes) of each tag; an empty name for comments and the like."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, "", False, ""
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1 if at < self.last[">"] else 0
                if not end:
                    return
                yield at, end, "", False, ""
            else:
                closing = page[at + 1 : at + 2] == "/"
                name = NAME.match(page, at + 1 + closing)
                end = self.end(name.end()) + 1 if name else 0
                if not end:
                    at += 1
                    continue
                tag = name[0].lower()
                if tag in RAW and not closing and page[end - 2] != "/":  # its content is no markup
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
                    end = stop.end() if stop else len(page)
                yield at, end, tag, closing, page[name.end() : end - 1] if tag not in RAW else ""
            at = end


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in page order; a parent comes before its children, node 0 is the root."""
    nodes = [Node("#root", "", -1, 0)]
    stack, run, links, at, page = [0], [], [0, 0], 0, page or ""  # links: open anchors, characters in them
    open_: Counter[str] = Counter()  # tags on the stack

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                leaf = Node("", "", stack[-1], nodes[stack[-1]].depth + 1)
                leaf.text, leaf.linked = text, links[1]
                nodes.append(leaf)
            run.clear()
            links[1] = 0

    def add(text: str) -> None:
        if text:
            run.append(text)
            if links[0]:
                links[1] += len(text)

    def pop() -> str:
        tag = nodes[stack.pop()].tag
        open_[tag] -= 1
        return tag

    for start, end, tag, closing, attrs in Tags(page):
        add(page[at:start])
        at = end
        if not tag or tag in RAW:
            continue
        if tag in ("br", "wbr"):
            run.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
        elif closing:
            if tag not in ("html", "body") and open_[tag]:
                flush()
                while pop() != tag:
                    pass
                links[0] = 0
        else:
            flush()
            if tag in VOID:
                continue
            if nodes[stack[-1]].tag == "p":  # a block ends an open paragraph
                pop()
            shut = CLOSES.get(tag, ())
            while any(open_[t] for t in shut):
                top = nodes[stack[-1]].tag
                if top not in shut and top in SCOPE:
                    break
                pop()
            while len(stack) > MAX_DEPTH:
                pop()
            nodes.append(Node(tag, attrs, stack[-1], nodes[stack[-1]].depth + 1))
            stack.append(len(nodes) - 1)
            open_[tag] += 1
    add(page[at:])
    flush()
    return nodes
