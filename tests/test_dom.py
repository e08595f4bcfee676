"""Selectors as joins against a plain walk of the same trees."""

import pytest

from lakewright.functions import html as H
from lakewright.operators import dom

DATA = "/root/testdata/sf0.01"
SELECTORS = ["p", "article p, article li, h1", "nav > ul > li > a[href]", "body b p", "div.ad", "article > *", "div div, p b", "[class=ad]", "[class]", "html body > article h1", "#none", "li li", "script, style, title"]
ODD = [
    "<ul><li>one<ul><li>two <b>bold</b></li></ul><li class='x  y'>three</ul><p id=q>four<p class=y>five<br>six</p>seven",
    "<div class=a><div class='a b'><div><span class=b>deep</span> tail</div></div></div><template><p>no</p></template>",
    "<table><tr><th>A<td>1<tr><td>2</table><noscript>never</noscript><input name=q value='a b'>", "plain &amp; text", "", "<p>",
]


@pytest.fixture(scope="module")
def pages(spark):
    given = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(-1 - i, p) for i, p in enumerate(ODD)] + [(-100, None)], "page_id long, html string")
    both = given.unionByName(odd)
    return dom.read(both, "page_id"), {r["page_id"]: r["html"] for r in both.collect()}


@pytest.mark.parametrize("selector", [*SELECTORS, "div.a .b", ".y", "td, th", "ul li > b", "[name=q]", "[value='a b']", "*", ""])
def test_selector(pages, selector):
    read, source = pages
    got = {r["page_id"]: r["texts"] for r in dom.selected_texts(read, selector).collect()}
    assert got == {k: [x.text() for x in H.select(H.Tree(page or "").root, selector)] for k, page in source.items()}


def test_intervals(pages):
    """A node's interval holds what lies below it, and nothing else."""
    read, _ = pages
    rows = [r for r in read.elements.where("page_id < 0").collect()]
    by = {(r["page_id"], r["pre"]): r for r in rows}
    for r in rows:
        up, at = set(), r["parent"]
        while at:
            up.add(at)
            at = by[(r["page_id"], at)]["parent"]
        assert up == {x["pre"] for x in rows if x["page_id"] == r["page_id"] and x["pre"] < r["pre"] <= x["last"]} and r["depth"] == len(up) + 1


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert dom.selected_texts(dom.read(pages, "page_id"), "p").count() == 0
