"""Ball trees and clustering against a plain loop over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lakewright.llm import balltree

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain(rows, k, rounds, dimensions, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [near(v) for _, v in kept]
    of = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, of[c], sum(of), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=repr)


def got(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "dimensions", "k", "tree", "leaf"), [(1, 2, 5, 64, 4), (2, 8, 16, 200, 8), (3, 3, 7, 4096, 32)])
def test_brute_force(spark, monkeypatch, seed, dimensions, k, tree, leaf):
    """Clumps, ties on a coarse grid, repeated vectors and ids, far outliers."""
    monkeypatch.setattr(balltree, "TREE", tree)
    monkeypatch.setattr(balltree, "LEAF", leaf)
    r = random.Random(seed)
    centers = [[r.uniform(-9, 9) for _ in range(dimensions)] for _ in range(6)]
    rows = []
    for i in range(900):
        c = r.choice(centers)
        v = [round(x + r.gauss(0, 0.2), r.choice((0, 1, 3))) for x in c]
        rows.append((i, v))
    rows += [(i, rows[0][1]) for i in range(900, 1100)] + [(3, rows[3][1]), (1100, [400000.5] * dimensions)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert got(balltree.report(df, k, 3, dimensions, 4)) == plain(rows, k, 3, dimensions, 4)


def test_whole_balls_are_assigned():
    """Far clumps go whole, at any depth, and counts and sums stay exact."""
    r = np.random.default_rng(0)
    points = np.concatenate([r.integers(-9, 9, (400, 4)) + at for at in (0, 1000, -5000)])
    tree, order = balltree.build(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(len(points)))
    centroids = np.array([[0] * 4, [1000] * 4, [-5000] * 4, [1] * 4])
    kinds = [(kind, len(balls)) for kind, balls, _ in balltree.walk(tree, centroids)]
    assert sum(n for kind, n in kinds if kind == "ball") >= 2
    count, sums = balltree.totals(tree, centroids)
    best = ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
    assert count.tolist() == np.bincount(best, minlength=4).tolist()
    assert all((sums[j] == points[best == j].sum(0)).all() for j in range(4))
    for i in range(len(tree.first)):
        own = tree.points[tree.first[i] : tree.last[i]]
        assert (tree.sums[i] == own.sum(0)).all() and np.sqrt(((own - tree.centers[i]) ** 2).sum(1)).max() <= tree.radius[i]


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [-1.5, 2.0]), (None, [3.0, -4.0]), (8, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    assert got(balltree.report(df, 16, 3, 2, 64)) == plain(rows, 16, 3, 2, 64)
    assert got(balltree.report(df, 2, 3, 2, 64)) == plain(rows, 2, 3, 2, 64)
    empty = balltree.report(df.limit(0), 16, 3, 2, 64)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert balltree.report(df.where("vec_id < 7"), 16, 3, 2, 64).count() == 0
    with pytest.raises(Exception, match="beyond"):
        balltree.report(spark.createDataFrame([(1, [1e12, 1.0], None, None)], SCHEMA), 2, 1, 2, 64).collect()
