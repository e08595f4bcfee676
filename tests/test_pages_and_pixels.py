"""Queries without SQL over whole tables, each against a plain version of its own."""

import html as H
import random
from collections import defaultdict
from urllib.parse import urljoin

import pytest

from lakewright import queries as base
from lakewright.operators import dom, images, joins, records

DATA = "/root/testdata/sf0.001"
HEADS, BLOCKS = ("h1", "h2", "h3", "h4"), ("p", "li", "blockquote", "pre")


def plain_page(url, page):
    """(title, sections, links, tables) from numbered elements and runs."""
    found = dom.page_rows(page)
    text = lambda e: " ".join(r["text"] for r in found["runs"][e["run_from"] : e["run_from"] + e["n_runs"]] if r["hush"] < e["pre"])
    elements = found["elements"]
    titles = [text(e) for e in elements if e["tag"] == "title"] + [text(e) for e in elements if e["tag"] == "h1"][:1] + [url]
    sections = [t for e in elements if e["tag"] in HEADS + BLOCKS and (t := text(e)) and (e["tag"] in HEADS or len(t.encode()) >= 12)]
    links = [(urljoin(url, href), text(e)) for e in elements if e["tag"] == "a" and (href := e["attrs"].get("href", "").strip()) and not href.startswith(("#", "javascript:"))]
    return next(t for t in titles if t), sections, list(dict.fromkeys(links)), sum(e["tag"] == "table" for e in elements)


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    return {r["page_id"]: plain_page(r["url"], r["html"]) for r in rows}


def test_distilled_titles(spark, pages):
    got = {r["page_id"]: (r["title"], r["n_sections"], r["n_tables"]) for r in base.queries()["distilled_titles"](spark, DATA).collect()}
    assert got == {k: (t, len(s), n) for k, (t, s, _, n) in pages.items()} and len(got) == 50


def test_response_markdown(spark, pages):
    got = {r["page_id"]: r["extracted"] for r in base.queries()["response_markdown"](spark, DATA).collect()}
    want = {k: "\n".join([*s, *(f"- [{label}]({href})" for href, label in links)]) for k, (_, s, links, _) in pages.items()}
    assert {k: H.unescape(v) for k, v in got.items()} == {k: H.unescape(v) for k, v in want.items()}


def test_dominant_colors(spark):
    """Greedy clusters in page order, one pixel at a time."""
    rows = spark.sql(base.PIXELS.format("{lineitem}"), lineitem=spark.read.parquet(f"{DATA}/lineitem.parquet")).collect()
    pictures = defaultdict(list)
    for r in rows:
        pictures[r["image_id"]].append(r)
    got = defaultdict(list)
    for r in base.queries()["dominant_colors"](spark, DATA).orderBy("image_id", "rank").collect():
        got[r["image_id"]].append(r)
    assert set(got) == set(pictures)
    for k, own in pictures.items():
        assert [r["rank"] for r in got[k]] == list(range(1, len(got[k]) + 1)) and len(got[k]) <= 5
        places = {(r["y"], r["x"]) for r in own}
        if len(places) < len(own):  # which of two pixels at one place comes first isn't said
            assert sum(r["n"] for r in got[k]) <= len(own)
            continue
        clusters = []
        for r in sorted(own, key=lambda r: (r["y"], r["x"])):
            p = (r["r"], r["g"], r["b"])
            near = next((c for c in clusters if all(abs(s / c[1] - v) <= 24 for s, v in zip(c[0], p, strict=True))), None)
            if near is None:
                clusters.append([list(p), 1])
            else:
                near[0], near[1] = [s + v for s, v in zip(near[0], p, strict=True)], near[1] + 1
        clusters.sort(key=lambda c: -c[1])
        assert [(r["r"], r["g"], r["b"], r["n"]) for r in got[k]] == [(*(int(s / n + 0.5) for s in sums), n) for sums, n in clusters[:5]]


def test_dominant_colors_of_made_up_images(spark):
    r = random.Random(6)
    rows = [(k, x, y, *(min(255, c + r.randrange(30)) for c in r.choice(((0, 0, 0), (200, 30, 30), (90, 200, 10))))) for k in range(6) for x in range(7) for y in range(9)]
    got = defaultdict(list)
    for c in images.dominant_colors(spark.createDataFrame(rows, "image_id int, x long, y long, r int, g int, b int"), 16).orderBy("image_id", "rank").collect():
        got[c["image_id"]].append((c["r"], c["g"], c["b"], c["n"]))
    for k in range(6):
        clusters = []
        for _, _, _, *p in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            near = next((c for c in clusters if all(abs(s / c[1] - v) <= 16 for s, v in zip(c[0], p, strict=True))), None)
            if near is None:
                clusters.append([list(p), 1])
            else:
                near[0], near[1] = [s + v for s, v in zip(near[0], p, strict=True)], near[1] + 1
        clusters.sort(key=lambda c: -c[1])
        assert got[k] == [(*(int(s / n + 0.5) for s in sums), n) for sums, n in clusters[:5]]


def test_small_tables(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_TABLE", 3)
    left = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError, match="more than 3"):
        joins.best_match(left, "k", spark.range(4).withColumnRenamed("id", "rule_id"), [])


def test_modes(spark):
    page = "<title>T</title><h1>Head</h1><p>long enough text</p><a href='/x'>go</a><table><tr><th>A</th></tr><tr><td>1</td></tr></table>"
    rows = spark.createDataFrame([("http://h/", "text/html", page), ("http://h/", "application/json", '{"a": 1}')], "url string, content_type string, body string")
    got = {m: [r["extracted"] for r in records.extract_response(rows, m, "h1, a").collect()] for m in ("raw", "json", "links", "tables", "selector", "markdown", "auto")}
    assert got["raw"] == [page, '{"a": 1}'] and got["json"] == [None, '{"a": 1}'] and got["auto"] == ["Head\nlong enough text\n- [go](http://h/x)", '{"a": 1}']
    assert got["links"][0] == '[{"href":"http://h/x","label":"go"}]' and got["tables"][0] == '[{"headers":["A"],"rows":[["1"]]}]' and got["selector"][0] == '["Head","go"]' and got["markdown"][0] == got["auto"][0]
