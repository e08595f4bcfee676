"""Main text of hand-written layouts, each with the exact text that it must give."""

import html
import re

import duckdb
import pytest

from lakewright.llm import html_extract

S = "The old bridge over the river was closed on Monday after engineers found cracks in two of its main piers, the town said."
P = " ".join([S]*2)
CASES = [
    (f"<article>{S}<br>{S}<br>{S}</article>", [f"{S} {S} {S}"]),
    (f"<article><h1>Bridge</h1><div>{P}</div><div>{P}</div></article>", ["Bridge",P,P]),
    (f"<article><h1>Terms</h1><dl><dt>Pier</dt><dd>{S}</dd></dl><p>{P}</p></article>", ["Terms","Pier",S,P]),
    (f"<article><header><h1>Bridge</h1><p>A short lede.</p></header><p>One short sentence.</p><footer>Posted in town</footer></article>", ["Bridge","A short lede.","One short sentence."]),
    (f"<article><pre>{S}</pre></article>", [S]),
    (f"{P}", [P]),
    (f"<div>{P}</div>", [P]),
    (f"<html><body><div>{P}</div></body></html>", [P]),
    (f"<article><h1>Bridge</h1><p>{P}</p><section><h2>Comments</h2><p>{S}</p><div>{S}</div></section></article>", ["Bridge",P]),
    (f"<article><h1>Bridge</h1><p>{P}</p><p hidden>{S}</p><p style='display:none'>{S}</p><p>{S}</p></article>", ["Bridge",P,S]),
    (f"<nav><a href=/>Home</a></nav><h1>Bridge</h1><p>{P}</p><p>{S}</p><footer>&copy; Town</footer>", ["Bridge",P,S]),
    (f"<body><header><a href=/>Site</a></header><div><h1>Bridge</h1><p>{P}</p></div><aside><h3>More</h3><ul><li><a href=/x>One thing</a></ul></aside></body>", ["Bridge",P]),
    (f"<main><section><h2>First</h2><p>{P}</p></section><section><h2>Second</h2><p>{S}</p></section></main>", ["First",P,"Second",S]),
    (f"<article><h1>Bridge</h1>{S}<p>{P}</p>{S}</article>", ["Bridge",S,P,S]),
    (f"<article><h1>Bridge</h1><p>{P}</p></article><section><h2>3 Comments</h2><ul><li>{S}</li><li>{S}</li></ul></section>", ["Bridge",P]),
    (f"<article><h1>Bridge</h1><ul><li>One pier</li><li>Two piers</li></ul><p>{S}</p></article>", ["Bridge","One pier","Two piers",S]),
    (f"<article><h1>Bridge</h1><blockquote>{S}</blockquote><table><tr><td>Pier</td><td>2</td></tr></table><p>{P}</p></article>", ["Bridge",S,"Pier","2",P]),
    (f"<p>{S}</p>", [S]),
    (f"<article><p>{S}</p></article>", [S]),
    (f"<article><h1>Bridge</h1><p>{P}</p><div class='ad'><p>{S}</p></div><form><label>Mail</label><input><button>Go</button></form></article>", ["Bridge",P]),
    (f"<div id='content'><h1>Bridge</h1><div>{P}</div><div>{S}</div></div><div id='sidebar'><p>{S}</p></div>", ["Bridge",P,S]),
    (f"<div class='cookie-banner'><p>{S}</p></div><article><h1>Bridge</h1><div><p>{P}</p><p>{S}</p></div></article>", ["Bridge",P,S]),
    (f"<article><h1>Bridge</h1><figure><img src=x><figcaption>{S}</figcaption></figure><p>{P}</p></article>", ["Bridge",S,P]),
    (f"<article><h1>Bridge</h1><p>{P}</p><div style='visibility:hidden'><p>{S}</p></div></article><footer><p>{S}</p></footer>", ["Bridge",P]),
    (f"<article><h1>Brücke</h1><p>{P}</p><section><h3>Kommentare (4)</h3><article><h4>Ann</h4><p>{S}</p></article></section></article>", ["Brücke",P]),
    (f"<article><h2>Bridge</h2><p>Short.</p><p>Also short.</p></article>", ["Bridge","Short.","Also short."]),
    (f"<body><nav><ul><li><a href=/>A</a></li></ul></nav><article>{P}</article></body>", [P]),
    (f"<body><table><tr><td><a href=/a>Menu</a></td><td class='content'><h1>Bridge</h1><p>{P}</p></td></tr></table></body>", ["Bridge",P]),
    (f"<article><section><h2>One</h2><div>{S}</div></section><section><h2>Two</h2><div>{S}</div></section></article>", ["One",S,"Two",S]),
    (f"<article><header><h1>Bridge</h1></header><div>{P}</div><footer><a href=/t>Tags</a></footer></article>", ["Bridge",P]),
]


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize("case", range(len(CASES)))
def test_layout(model, case):
    page, blocks = CASES[case]
    assert model.texts([page]) == ["\n".join(blocks)]


def test_all_pages_of_the_table(model):
    """Every page of sf0.1: the text of its article element, block by block."""
    pages = [p for (p,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    for page, got in zip(pages, model.texts(pages), strict=True):
        inside = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got == "\n".join(b for b in blocks if b)


def test_titles():
    for text, want in (("3 Comments", True), ("Leave a reply", True), ("Kommentare (12)", True), ("Related articles", True), ("Comments on the bridge", False), ("Read more", False), ("Bridge", False), ("", False), ("Comment " * 20, False)):
        assert html_extract.titled(text) == want
