"""Main text of web pages by a tree-structured graphical model.

Each node of a page's tree, a block element or a run of text, is a binary variable: content or not. A
log-linear unary potential reads the node's own features; a potential on every parent-child edge, one
table each for containers, text elements and runs, ties a node to the element around it. Sum-product messages pass
up and then down the tree and give each node's exact marginal; runs of text with a marginal of 0.5 or
more are the main text. All pages of a batch are one forest, so that a depth is one numpy step.

The weights maximise the likelihood of labelled pages, whose gradient is observed less expected
features, by the same messages. The ``pages`` table has no labels, so the training pages are drawn from
the layouts of ``labelled_pages``: articles in several wrappers, or in none, of paragraphs, bare text, divs, lists of terms,
sections and headers of their own, among menus, headers, footers, sidebars, notices, adverts, forms, hidden parts and
reader comments (named or only titled so), with labels known by construction. ``fit`` takes any others. The model of
these pages is fitted once in a process (``default_model``). A footer in an article is not of its text, its header is.

Pages are read whole. Edge cases: a null or empty page, or one without text, gives an empty string.
Broken markup is read as browsers mostly do (open paragraphs end, stray ends are ignored, an unclosed
script takes the rest, elements below the 512th stand beside it); any markup is read in linear time. A page without markup is
text like any other. What a hidden attribute or a style hides is never content. Formulas are read as text; what scripts, styles, drawings, frames and stand-ins for scripts hold is not. Repeated pages give equal rows; an
empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import table
from lakewright.llm.dom import ATTRIBUTE, Node, parse

#: Characters of markup that are handled at once in a worker.
CHUNK = 2 << 20
TRAINING_PAGES, ROUNDS = 900, 180
#: What a hidden node's log-odds are lowered by, beyond doubt.
HIDDEN = 60.0

# Element names that have a feature of their own, and name parts by what they speak for.
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl nav header footer aside form fieldset button select table td th blockquote pre figure figcaption address dialog details menu body".split()
NAMES = {
    "ad": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager tabs skip topbar",
    "side": "sidebar aside side widget widgets related recommended share sharing social trending popular tags rail more",
    "notice": "cookie cookies consent notice popup modal overlay newsletter subscribe subscription alert gdpr paywall signup message disclaimer",
    "comment": "comment comments reply replies discussion disqus respond responses commentlist reactions reader",
    "head": "header head masthead logo brand site hero",
    "foot": "footer foot copyright legal bottom credits colophon",
    "form": "form search login signin contact survey poll",
    "content": "content article post entry story main body text maincontent articlebody prose copy page",
    "byline": "byline author meta date timestamp published",
}
_NAME = {word: kind for kind, words in NAMES.items() for word in words.split()}
_ROLE = {"navigation": "menu", "banner": "head", "complementary": "side", "contentinfo": "foot", "main": "content", "article": "content", "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "alertdialog": "notice", "menu": "menu", "menubar": "menu"}
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# Words that title what isn't of the article, in four languages, and words that may stand beside them.
TITLES = frozenset("comment comments commented reply replies responses discussion reactions kommentar kommentare kommentieren commentaire commentaires réactions comentario comentarios respuestas related recommended popular trending newsletter subscribe advertisement sponsored anzeige werbung publicité publicidad relacionados ähnliche".split())
BESIDE = frozenset("a all an articles artikel artículos das de der des die join latest leave les los más mehr more most no on our plus post posts read reader readers se stories the to top view write your zu".split())
_WORDS = re.compile(r"[^\W\d_]+")

FEATURES = ["bias", "run", "other_tag", *(f"tag {t}" for t in TAGS), *(f"name {k}" for k in NAMES), "hidden", "titled", "under titled", "share 0.8", "share 0.4", "share 0.1", "page of text"]
FEATURES += ["short", "medium", "long", "very_long", "sentence", "linked_some", "linked_all", "copyright", *(f"in {t}" for t in TAGS), "in other"]
#: Elements that hold text rather than other blocks: their edges have potentials of their own.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption tr tbody thead ul ol dl table address".split())
KINDS = 3
_AT = {name: k for k, name in enumerate(FEATURES)}


def titled(text: str) -> bool:
    """Whether a short text titles something else than an article: "3 Comments", "Leave a reply", "Related articles"."""
    words = {w.lower() for w in _WORDS.findall(text)} if len(text) < 50 else set()
    return bool(words & TITLES) and words <= TITLES | BESIDE


def features(nodes: list[Node]) -> tuple[list[list[int]], list[bool]]:
    """The numbers of each node's features, and whether the node, or what it lies in, is hidden.

    Besides names and lengths: the share of the page's text outside links that lies at or below a node, and whether the first text
    below an element titles something else."""
    plain, first, hidden = [len(n.text) - min(n.linked, len(n.text)) for n in nodes], [-1] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].text:
            first[i] = i
        up = nodes[i].parent
        plain[up] += plain[i]
        first[up] = first[i] if first[i] >= 0 else first[up]
    page, out, under = max(plain[0], 1), [], [False] * len(nodes)
    for i, node in enumerate(nodes):
        f = [0]
        if i:
            under[i], hidden[i] = under[node.parent], hidden[node.parent]
        share = plain[i] / page
        if share > 0.1:
            f.append(_AT["share 0.8" if share > 0.8 else "share 0.4" if share > 0.4 else "share 0.1"])
        if node.tag:
            f.append(_AT.get(f"tag {node.tag}", _AT["other_tag"]))
            if node.tag not in ("article", "main", "body", "#root", "html") and first[i] >= 0 and titled(nodes[first[i]].text):
                f.append(_AT["titled"])
                under[i] = True
            if node.attrs:
                seen = {a[0].lower(): a[1].strip("\"'") for a in ATTRIBUTE.findall(node.attrs)}
                words = _SPLIT.sub(" ", " ".join(seen.get(k, "") for k in ("class", "id", "itemprop"))).lower().split()
                kinds = {_NAME[w] for w in words if w in _NAME}
                kinds |= {_ROLE[r] for r in seen.get("role", "").lower().split() if r in _ROLE}
                f += [_AT[f"name {k}"] for k in kinds]
                if "hidden" in seen or _HIDDEN.search(seen.get("style", "").lower()):
                    hidden[i] = True
                elif seen.get("aria-hidden") == "true":
                    f.append(_AT["hidden"])
        else:
            n = len(node.text)
            f += [_AT["run"], _AT["short" if n < 25 else "medium" if n < 90 else "long" if n < 300 else "very_long"]]
            if node.text[-1] in ".!?\"'”»:…":
                f.append(_AT["sentence"])
            if node.linked > 0.25 * n:
                f.append(_AT["linked_all" if node.linked > 0.8 * n else "linked_some"])
            if "©" in node.text or "copyright" in node.text[:200].lower():
                f.append(_AT["copyright"])
            if len(nodes) == 2:
                f.append(_AT["page of text"])
            f.append(_AT.get(f"in {nodes[node.parent].tag}", _AT["in other"]))
        if under[i]:
            f.append(_AT["under titled"])
        out.append(f)
    return out, hidden


class Forest:
    """All nodes of some pages: parents, depths and features as arrays."""

    def __init__(self, pages: list[list[Node]]) -> None:
        offsets = np.cumsum([0, *map(len, pages)])
        self.size, self.starts = int(offsets[-1]), offsets
        parent = np.fromiter((n.parent for p in pages for n in p), np.int64, self.size)
        self.parent = np.where(parent < 0, -1, parent + np.repeat(offsets[:-1], np.diff(offsets)))
        self.kind = np.fromiter((2 if not n.tag else n.tag in TEXT_TAGS for p in pages for n in p), np.int64, self.size)
        depth = np.fromiter((n.depth for p in pages for n in p), np.int64, self.size)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        self.levels = [order[cuts[d] : cuts[d + 1]] for d in range(1, len(cuts) - 1)]  # without the roots
        both = [features(p) for p in pages]
        found = [f for f, _ in both]
        self.hidden = np.fromiter((h for _, hidden in both for h in hidden), bool, self.size)
        self.at = np.fromiter((k for p in found for f in p for k in f), np.int64)
        self.node = np.repeat(np.arange(self.size), np.fromiter((len(f) for p in found for f in p), np.int64, self.size))

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes,) probability of content and (nodes, 2, 2) of (parent, child) by sum-product.

        ``edges``: log potentials (kind, parent, child).
        """
        unary = np.zeros((self.size, 2))
        unary[:, 1] = np.bincount(self.node, weights[self.at], self.size) - HIDDEN * self.hidden
        up, sent = unary.copy(), np.zeros((self.size, 2))  # up: unary and the messages of all children
        for level in reversed(self.levels):
            m = up[level, None, :] + edges[self.kind[level]]
            sent[level] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            if 8 * len(level) < self.size:  # few nodes: the sum by address would cost more
                np.add.at(up, self.parent[level], sent[level])
            else:
                up += np.stack([np.bincount(self.parent[level], sent[level, side], self.size) for side in (0, 1)], axis=1)
        belief, pair = up.copy(), np.zeros((self.size, 2, 2))
        for level in self.levels:
            rest = belief[self.parent[level]] - sent[level]  # what the parent holds without this child
            joint = rest[:, :, None] + edges[self.kind[level]] + up[level, None, :]
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


class Model:
    def __init__(self, weights: np.ndarray, edges: np.ndarray) -> None:
        self.weights, self.edges = weights, edges

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page."""
        trees = [parse(p) for p in pages]
        forest = Forest(trees)
        content = (forest.marginals(self.weights, self.edges)[0] >= 0.5) & ~forest.hidden
        starts = forest.starts
        return ["\n".join(n.text for n, c in zip(t, content[starts[k] :], strict=False) if c and n.text) for k, t in enumerate(trees)]


def fit(labelled: list[tuple[str, list[str]]], rounds: int = ROUNDS, decay: float = 0.0002) -> Model:
    """Maximum likelihood, by Adam, on pages with the list of their main text's blocks.

    A run is content if its text is one of the blocks, an element if it holds content.
    """
    trees = [parse(page) for page, _ in labelled]
    forest = Forest(trees)
    y = np.zeros(forest.size, np.int64)
    for k, (tree, (_, blocks)) in enumerate(zip(trees, labelled, strict=True)):
        start, wanted = forest.starts[k], set(blocks)
        inside = [int(bool(n.text) and n.text in wanted and not forest.hidden[start + i]) for i, n in enumerate(tree)]
        for i in range(len(tree) - 1, 0, -1):
            inside[tree[i].parent] += inside[i]
        y[start : start + len(tree)] = np.array(inside) > 0
    seen = np.bincount(forest.at, y[forest.node], len(FEATURES))
    child = np.flatnonzero(forest.parent >= 0)
    edge = np.zeros((KINDS, 2, 2))
    np.add.at(edge, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    params, m, v = np.zeros(len(FEATURES) + 4 * KINDS), 0.0, 0.0
    for step in range(1, rounds + 1):
        p, pair = forest.marginals(params[: -4 * KINDS], params[-4 * KINDS :].reshape(KINDS, 2, 2))
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[child], pair[child])
        g = np.concatenate([seen - np.bincount(forest.at, p[forest.node], len(FEATURES)), (edge - expected).ravel()]) / len(trees) - decay * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(params[: -4 * KINDS], params[-4 * KINDS :].reshape(KINDS, 2, 2))


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Made-up pages of many layouts, each with the blocks of its main text."""
    r = random.Random(seed)
    syllables = "ba ko ri ten sul mar ové da lin qué sto per an ge".split()
    pool = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(4000)]
    word = lambda: pool[int(r.random() * len(pool))]
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=22: line(a, b).capitalize() + r.choice("...?!")
    paragraph = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 9))))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    named = lambda *kinds: f' {r.choice(("class", "id"))}="{r.choice(["", "", "", "c-", "js-"])}{r.choice([w for k in kinds for w in NAMES[k].split()])}"'

    def items(a: int, b: int, linked: bool) -> str:
        return "<ul>" + "".join(f"<li>{link(line(1, 4)) if linked else line(1, 6)}</li>" for _ in range(r.randint(a, b))) + "</ul>"

    def prose(t: str) -> str:
        """Mark up a block's text without changing it."""
        words = t.split()
        if len(words) > 4 and r.random() < 0.4:
            k = r.randrange(len(words) - 2)
            words[k] = r.choice((f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", link(words[k]), f"<span>{words[k]}</span>"))
        return " ".join(words) + r.choice(("", "", "", "<br>"))

    def clutter(kind: str) -> str:
        body = r.choice((f"<p>{paragraph()}</p>", paragraph(), f"<p>{sentence()}</p><p>{paragraph()}</p>", f"<div>{sentence()}</div>", items(2, 6, True), f"<h3>{line(1, 4)}</h3>{items(2, 5, True)}"))
        if kind == "menu":
            return r.choice((f"<nav>{items(2, 9, True)}</nav>", f"<div{named('menu')}>{items(2, 9, True)}</div>", f"<ul{named('menu')}>" + "".join(f"<li>{link(line(1, 2))}" for _ in range(4)) + "</ul>", f'<div role="navigation">{link(word())} | {link(word())}</div>'))
        if kind == "head":
            inner = r.choice((f"<h1>{line(1, 4)}</h1>", f"<div{named('head')}>{line(1, 4)}</div><p>{sentence()}</p>", f"<p>{sentence()}</p>{clutter('menu')}", link(word())))
            return r.choice((f"<header>{inner}</header>", f"<div{named('head')}>{inner}</div>", f'<div role="banner">{inner}</div>'))
        if kind == "foot":
            inner = r.choice((f"&copy; {word()}.com &middot; {sentence()}", f"<p>Copyright {line(1, 5)}</p>{items(2, 5, True)}", f"<p>{paragraph()}</p>", body))
            return r.choice((f"<footer>{inner}</footer>", f"<div{named('foot')}>{inner}</div>", f'<div role="contentinfo">{inner}</div>'))
        if kind == "side":
            return r.choice((f"<aside>{body}</aside>", f"<div{named('side')}>{body}</div>", f"<section{named('side')}>{body}</section>", f"<aside{named('side')}><h2>{line(1, 3)}</h2>{body}</aside>"))
        if kind == "form":
            return f"<form{r.choice(('', named('form', 'notice')))}><label>{line(1, 3)}</label><input><p>{sentence()}</p><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>"
        if kind == "comment":
            each = "".join(r.choice((f"<div{named('comment')}><p>{paragraph()}</p></div>", f"<li><b>{word()}</b>: {paragraph()}</li>", f"<article{named('comment')}><h4>{word()}</h4><p>{paragraph()}</p></article>")) for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(('div', 'section', 'ol')))}{named('comment')}><h3>{line(1, 3)}</h3>{each}</{t}>"
        if kind == "remarks":  # known by its title alone
            title = r.choice(("Comments", "{} Comments", "Comments ({})", "Reader comments", "Leave a reply", "Kommentare", "{} Kommentare", "Commentaires", "Comentarios", "Responses", "Related articles", "Discussion")).format(r.randint(1, 99))
            each = "".join(r.choice((f"<div><p>{paragraph()}</p></div>", f"<p>{paragraph()}</p>", f"<div>{sentence()}</div>", f"<p><b>{word()}</b>: {sentence()}</p>", f"<article><h4>{word()}</h4><p>{paragraph()}</p></article>")) for _ in range(r.randint(1, 5)))
            lists = f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(r.randint(1, 4)))}</ul>"
            return f"<{(t := r.choice(('section', 'section', 'div')))}><{(h := r.choice(('h2', 'h3', 'h4')))}>{title}</{h}>{r.choice((each, each, lists))}</{t}>"
        return f"<{(t := r.choice(('div', 'div', 'div', 'section', 'p', 'aside')))}{named(kind)}>{sentence() if t == 'p' else body}</{t}>"

    kinds = ("menu", "head", "foot", "side", "form", "comment", "ad", "notice", "remarks")
    out = []
    for _ in range(n):
        blocks: list[str] = []

        def block(tag: str, text: str, blocks: list[str] = blocks) -> str:
            blocks.append(" ".join(text.split()))
            return f"<{tag}>{prose(text)}" + (f"</{tag}>" if tag != "p" or r.random() < 0.8 else "")

        if r.random() < 0.1:  # no markup, or hardly any
            blocks.append(" ".join(" ".join(paragraph() for _ in range(r.choice((1, 1, 3)))).split()))
            inner_tag = r.choice(("{}", "{}", "<p>{}", "<p>{}</p>", "<div>{}</div>", "<article>{}</article>", "<article><p>{}</p></article>", "<div><p>{}</p></div>", "<main><div>{}</div></main>", "<pre>{}</pre>"))
            out.append((r.choice(("{}", "{}", "<body>{}</body>", "<html><body>{}</body></html>")).format(inner_tag.format(blocks[0])), blocks))
            continue
        single = r.random() < 0.14  # a block or two of any kind, in any wrapper, among little else
        few = r.random() < 0.3  # a short heading and a few short paragraphs, which may repeat it
        plain = r.random() < 0.5  # the usual elements alone

        def bare(blocks: list[str] = blocks) -> str:
            """Text that stands in the article itself, its lines parted by <br>."""
            lines = [sentence() for _ in range(r.choice((1, 2, 3, 6)))]
            blocks.append(" ".join(" ".join(lines).split()))
            return r.choice(("<br>", "<br/>\n", "<br><br>", " ")).join(lines) + " "

        inner = [block(r.choice(("h1", "h1", "h1", "h2")), sentence(1, 3) if few and r.random() < 0.5 else line(1 if few else 2, 3 if few else 12))] if r.random() < 0.9 else []
        for _ in range(r.randint(0, 2) if few else 0):
            inner.append(block("p", r.choice((lambda: sentence(1, 4), lambda: line(1, 3) + ". " + line(1, 2) + ".", lambda: blocks[0] if blocks else sentence(1, 3)))()))
        for _ in range(0 if few and inner else r.choice((0, 1, 2, 4, 8, 14)) if inner else r.randint(1, 8)):
            style = r.random() * (1 if plain else 1.6)
            if style >= 1.5:
                inner.append(r.choice(("<p hidden>{}</p>", '<p style="display:none">{}</p>', "<div hidden><p>{}</p></div>", '<div style="visibility: hidden">{}</div>')).format(paragraph()))
            elif style >= 1.4:
                inner.append("<dl>" + "".join(block("dt", line(1, 4)) + block("dd", sentence()) for _ in range(r.randint(1, 4))) + "</dl>")
            elif style >= 1.3:
                inner.append(f"<section>{block(r.choice(('h2', 'h3')), line(1, 6))}{''.join(block('p', paragraph()) for _ in range(r.randint(1, 3)))}</section>")
            elif style >= 1.25:
                inner.append(block("pre", line(3, 40)))
            elif style >= 1.2:
                inner.append(f"<div>{''.join(block('p', paragraph()) for _ in range(r.randint(1, 3)))}</div>")
            elif style >= 1.1:
                inner.append(bare() if not inner or not inner[-1].endswith(" ") else block("p", paragraph()))
            elif style >= 1:
                inner += [block("div", r.choice((paragraph, sentence))()) for _ in range(r.randint(1, 3))]
            elif style < 0.72:
                inner.append(block("p", r.choice((paragraph, paragraph, sentence, lambda: line(1, 3) + "."))()))
            elif style < 0.8:
                inner.append(block(r.choice(("h2", "h3", "h4")), line(1, 7)))
            elif style < 0.86:
                inner.append("<ul>" + "".join(block("li", line(2, 12)) for _ in range(r.randint(1, 4))) + "</ul>")
            elif style < 0.9:
                inner.append(f"<blockquote>{block('p', paragraph())}</blockquote>")
            elif style < 0.93:
                inner.append(block("pre", line(3, 30)))
            elif style < 0.95:
                inner.append("<table>" + "".join(f"<tr>{block('td', line(1, 4))}{block('td', line(1, 4))}</tr>" for _ in range(2)) + "</table>")
            else:
                inner.append(f"<figure><img src=x>{block('figcaption', sentence())}</figure>")
        if single:
            inner, blocks[:] = [], []
            if r.random() < 0.4:
                inner.append(block("h1", line(1, 5)))
            long = lambda: " ".join(sentence(8, 24) for _ in range(r.choice((1, 2, 4))))
            inner.append(r.choice((bare, lambda: block("div", long()), lambda: block("p", long()), lambda: block("pre", long()), lambda: block("section", long())))())
            if r.random() < 0.3:
                inner.append(f"<{r.choice(('p', 'div'))} {r.choice(('hidden', 'style=display:none'))}>{long()}</div>")
        if not plain and r.random() < 0.3 and inner:  # a header of the article's own, a footer of its own
            lede = block("p", sentence()) if r.random() < 0.5 and len(inner) < 2 else ""
            inner[0] = f"<header>{inner[0]}{lede}</header>"
        if not plain and r.random() < 0.3:
            inner.append(f"<footer>{r.choice((sentence(), f'<p>{sentence()}</p>', items(2, 4, True)))}</footer>")
        if len(inner) == 1 and not plain and not single:
            inner.append(block(r.choice(("p", "div")), r.choice((sentence, paragraph))()))
        for kind in r.sample(("ad", "side", "form", "notice", "comment", "remarks"), r.choice((0, 0, 0, 1, 1, 2))):
            inner.insert(len(inner) if kind == "remarks" else r.randint(1, len(inner)), clutter(kind))
        start, end = r.choice((("<article>", "</article>"),) * 4 + (("", ""), ("<div>", "</div>"), ("<main>", "</main>"), (f"<div{named('content')}>", "</div>"), (f"<div{named('content')}>", "</div>"), ('<div role="main">', "</div>"), (f"<section{named('content')}>", "</section>"), (f"<main><article{named('content')}>", "</article></main>"), (f"<main><div>{clutter('menu')}</div><article>", f"</article>{clutter('side')}</main>"), (f"<table><tr><td>{r.choice((clutter('menu'), link(word()), link(word()) + '<br>' + link(line(1, 3))))}</td><td{named('content')}>", "</td></tr></table>")))
        before = [clutter(k) for k in r.choices(kinds, k=r.randint(0, 1 if single else 4))]
        after = [clutter(k) for k in r.choices(kinds, k=r.randint(0, 1 if single else 4))]
        whole = "".join([*before, start, *inner, end, *after])
        if r.random() < 0.3:
            whole = f"<div>{whole}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{line(2, 5)}</title><style>p{{}}</style></head><body>{whole}</body></html>", blocks))
    return out


@cache
def default_model() -> Model:
    """The model of ``labelled_pages``, fitted once in a process."""
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``pages`` and ``text``, the main text of column html; a column of that name is replaced."""
    model = model or default_model()
    weights, edges = model.weights, model.edges

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        found, out, part, size = Model(weights, edges), [], [], 0
        for page in column:
            part.append(page.as_py())
            size += len(part[-1] or "")
            if size >= CHUNK:
                out += found.texts(part)
                part, size = [], 0
        return pa.array(out + (found.texts(part) if part else []), pa.string())

    return pages.withColumn("text", main_text("html"))


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
