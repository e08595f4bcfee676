"""Connected components against a flood fill, selectors with children, and first rows."""

import random

from lakewright.functions import html
from lakewright.operators import images, joins


def flood(cells):
    left, out = set(cells), []
    for start in sorted(cells, key=lambda p: (p[1], p[0])):
        if start in left:
            left.discard(start)
            todo, part = [start], []
            while todo:
                x, y = todo.pop()
                part.append((x, y))
                for q in [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            out.append(part)
    out.sort(key=len, reverse=True)
    return [(k, len(p), min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)) for k, p in enumerate(out, 1)]


def test_components(spark):
    r = random.Random(3)
    grids = {k: {(r.randrange(14), r.randrange(14)) for _ in range(n)} for k, n in enumerate((0, 1, 40, 90, 150))}
    grids[7] = {(x, 0) for x in range(30)} | {(0, y) for y in range(20)}
    rows = [(k, x, y) for k, cells in grids.items() for x, y in cells]
    df = spark.createDataFrame(rows + rows[:5] + [(1, None, 2), (None, 1, 1)], "image_id long, x long, y long")
    got = sorted(map(tuple, images.components(df).collect()))
    assert got == sorted((k, *c) for k, cells in grids.items() for c in flood(cells))
    assert images.components(df.limit(0)).count() == 0


def test_components_over_tiles(spark, monkeypatch):
    """Snakes, combs and spirals over many tiles, places below zero, and images by name; rounds don't grow with a snake's length."""
    r = random.Random(4)
    snake = {(x, y) for y in range(-40, 40, 4) for x in range(-150, 150)} | {(149 if y // 4 % 2 else -150, y + k) for y in range(-40, 36, 4) for k in range(4)}
    comb = {(x, 0) for x in range(600)} | {(x, y) for x in range(0, 600, 2) for y in range(3)}
    noise = {(r.randrange(-300, 300), r.randrange(500, 620)) for _ in range(30000)}
    grids = {"snake": snake, "comb": comb, "noise": noise, "far": {(2**40, 2**41), (2**40 + 1, 2**41 - 1), (0, 0)}}
    rows = [(k, x, y) for k, cells in grids.items() for x, y in cells]
    rounds = []
    kept = images.checkpointed
    monkeypatch.setattr("lakewright.plans.graph.checkpointed", lambda df: rounds.append(1) or kept(df))
    got = sorted(map(tuple, images.components(spark.createDataFrame(rows, "image_id string, x long, y long")).collect()))
    assert got == sorted((k, *c) for k, cells in grids.items() for c in flood(cells))
    assert len(rounds) < 24


def test_selector_children():
    root = html.Tree('<ul><li id="a"><a class="x">1</a><b><a>2</a></b></li></ul><a>3</a>').root
    texts = lambda s: [x.children[0] for x in html.select(root, s)]
    assert texts("li > a") == ["1"] and texts("li a") == ["1", "2"] and texts("li>b > a") == ["2"] and texts("ul > a") == [] and texts("ul > li a.x, b>a") == ["1", "2"]


def test_first_of_each(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "c"), (2, None, "z"), (2, 1, "y"), (None, 3, "n")], "k long, n long, v string")
    assert sorted(map(str, joins.first_of_each(df, ["k"], ["n", "v"]).collect())) == sorted(["Row(k=1, n=5, v='a')", "Row(k=2, n=None, v='z')", "Row(k=None, n=3, v='n')"])
