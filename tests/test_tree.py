"""Depths, sums and preorder of trees in tables against a recursive walk."""

import random

import pytest

from lakewright.plans import tree

SCHEMA = "node long, parent long, place int, value long"


def plain(rows):
    known = {n for n, *_ in rows}
    below = {}
    for n, p, place, _ in rows:
        if p in known:
            below.setdefault(p, []).append((place if place is not None else -1, n))
    value = {n: v or 0 for n, _, _, v in rows}
    out = {}

    def walk(n, root, depth, pre):
        at, total = pre + 1, value[n]
        for _, c in sorted(below.get(n, [])):
            size, t = walk(c, root, depth + 1, at)
            at, total = at + size, total + t
        out[n] = (root, depth, pre, at - pre, total)
        return at - pre, total

    for n, p, *_ in rows:
        if p not in known:
            walk(n, n, 0, 0)
    return sorted((n, *out.get(n, (None,) * 5)) for n in known)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_shape(spark, seed):
    r = random.Random(seed)
    rows = [(n, r.choice([None, n + 5000, *range(max(0, n - 4), n)][: 2 + seed * 4] or [None]) if n else None, r.randrange(3), r.choice([None, r.randrange(9)])) for n in range(150)]
    rows += [(1000 + k, 7, k % 2, 1) for k in range(60)]  # many children of one
    rows += [(2000, 2001, 0, 1), (2001, 2002, 0, 1), (2002, 2000, 0, 1), (2003, 2001, 0, 5), (2004, 2004, 0, 1)]  # cycles and what hangs on them
    assert result(tree.shape(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_deep(spark):
    """A path of 400 nodes."""
    rows = [(n, n - 1 if n else None, 0, 1) for n in range(400)]
    assert result(tree.shape(spark.createDataFrame(rows, SCHEMA))) == [(n, 0, n, n, 400 - n, 400 - n) for n in range(400)]


def test_empty(spark):
    assert tree.shape(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tallies(spark):
    rows = [(0, None, 0, 0), (1, 0, 0, 0), (2, 1, 0, 0), (3, 2, 0, 0), (4, 1, 1, 0), (5, 0, 1, 0)]
    shaped = tree.shape(spark.createDataFrame(rows, SCHEMA))
    facts = spark.createDataFrame([(1, True, None, None), (2, True, None, None), (3, False, 3, True), (4, False, 2, None), (5, False, 9, True)], "node long, is_group boolean, span long, hidden boolean")
    assert result(tree.group_tally(shaped, facts)) == [(0, 2, 2, 5, 3, 2)]
    kinds = spark.createDataFrame([(1, "grp"), (2, "grp"), (3, "pic"), (4, None), (5, "sp")], "node long, kind string")
    assert result(tree.totals(shaped, kinds, "grp")) == [(0, 5, 2, 3, 2, 2, ["grp", "pic", "sp"])]


def test_ranks(spark):
    """Sums of what stands before, one group over many partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [("hot", k, k % 5) for k in range(500)] + [(f"g{k % 9}", k, 1) for k in range(60)] + [(None, 1, 4), (None, 2, 5)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = {(r["g"], r["k"]): r["before"] for r in tree.ranks(df, "g", ["k"], "n").collect()}
    assert got == {(g, k): sum(n for h, j, n in rows if h == g and j < k) for g, k, _ in rows}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
