"""Levels, cycles and faults of graphs in tables against the small version on lists."""

import random

from lakewright.plans import graph


def test_layers(spark):
    """Eight layers of ten nodes, every node linked to all of the next layer."""
    edges = [(10 * k + a, 10 * k + 10 + b) for k in range(7) for a in range(10) for b in range(10)]
    got = {r["node"]: (r["level"], r["state"]) for r in graph.levels(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: (n // 10, "ready") for n in range(80)}


def test_random(spark):
    r = random.Random(5)
    for n, m in ((30, 40), (40, 55), (12, 30)):
        edges = [(str(r.randrange(n)), str(r.randrange(n))) for _ in range(m)] + [("0", "1")] * 2
        nodes = [str(k) for k in range(n)]
        found = {x["node"]: (x["level"], x["state"]) for x in graph.levels(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in nodes], "node string")).collect()}
        order, left = graph.stages(nodes, edges)
        inner = [(b, a) for a, b in edges if a in left and b in left]
        core = graph.stages(sorted(left), inner)[1]
        want = {x: (k, "ready") for k, stage in enumerate(order) for x in stage} | {x: (None, "cycle" if x in core else "behind") for x in left}
        assert found == want


def test_what_is_kept(spark, monkeypatch):
    """A path of 40 nodes beside a wide layer: tables that were replaced are gone, and edges are written no more than a few times."""
    kept, made = [], []

    class Counted(graph.Written):
        def __init__(self, df):
            super().__init__(df)
            kept.append(self)
            made.append(df.columns)

        def drop(self):
            super().drop()
            kept.remove(self)

    monkeypatch.setattr(graph, "Written", Counted)
    edges = [(k, k + 1) for k in range(40)] + [(1000 + k, 5000) for k in range(200)]
    got = {r["node"]: r["level"] for r in graph.levels(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: k for k in range(41)} | {1000 + k: 0 for k in range(200)} | {5000: 1}
    assert len(kept) < 20 and sum(c == ["src", "dst"] for c in made) < 9


def test_million_edges(spark):
    """A layered graph of a million edges."""
    edges = spark.range(1_000_000).selectExpr("id % 5 * 20000 + id % 19997 as src", "(id % 5 + 1) * 20000 + (id * 31 + id div 7) % 19993 as dst")
    got = graph.levels(edges).groupBy("state").agg({"level": "max"}).collect()
    assert [tuple(x) for x in got] == [("ready", 5)]


def test_odd(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.levels(empty).count() == 0
    alone = graph.levels(empty, spark.createDataFrame([(1,), (1,), (None,)], "node long"))
    assert [tuple(x) for x in alone.collect()] == [(1, 0, "ready")]
    loop = graph.levels(spark.createDataFrame([(1, 1), (1, 2), (None, 3), (4, None), (5, 2)], "src long, dst long"))
    assert sorted(map(tuple, loop.collect())) == [(1, None, "cycle"), (2, None, "behind"), (5, 0, "ready")]


def test_faults(spark):
    nodes = spark.createDataFrame([("a", "count"), ("b", "nothing"), ("b", "count")], "node string, command string")
    edges = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "z"), ("y", "b")], "src string, dst string")
    got = sorted(map(tuple, graph.faults(nodes, edges, spark.createDataFrame([("count",)], "command string")).collect()), key=repr)
    assert got == [("loop", "a", "a"), ("no node at dst", "a", "z"), ("no node at src", "y", "b"), ("repeated node", "b", None), ("unknown command", "b", None)]
