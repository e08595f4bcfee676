"""Centroid clustering (Lloyd's rounds) of integer vectors, filtered by ball trees.

The vectors of a partition are put into metric trees of at most TREE vectors. A node of a tree, a ball,
stores its center, its radius (the largest distance of a vector to the center), the number of its vectors
and their integer sum; the leaves are ranges of the tree's matrix. The trees are written once and every
round reads them. A round walks all balls of a depth at once: a centroid that is farther from a ball's
center than the nearest one by more than two radii can own none of its vectors, by the triangle
inequality, and isn't looked at below. A ball that is left with one centroid goes to it whole, by its count and
sum; otherwise the walk goes down, and in the leaves exact integer distances to the centroids that are left
decide (ties: the smaller number). What leaves a task is a row for each centroid: count and sums.

Sums, floors and distances are exact: whole numbers under 2^53 in double precision where the components are
under 2^20, 64-bit integers up to 2^27. Components beyond that (values over 2 million) are an error, as squared distances
would not fit 64 bits. Radii and pruning bounds are doubles with a margin, so that rounding can only
send a ball further down.

Edge cases: null vectors, those of another length, and those with a null or non-finite component don't take
part and give no row. Repeated rows each take part. Rows without an id take part; they start clusters only if
there are too few others. With fewer vectors than clusters every vector starts one. An empty table, or one
without a usable vector, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import stored, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a tree, and of a leaf.
TREE, LEAF = 4096, 32
#: Components below SMALL are multiplied in doubles, which is exact; those of LARGE or more are refused.
SMALL, LARGE = 1 << 20, 1 << 27

TREES = "ids binary, id_null binary, points binary, first binary, last binary, left binary, centers binary, radius binary, sums binary"


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(points, centroids) exact squared distances of integer vectors."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


class Tree:
    """A ball tree: ``points`` in the order of the leaves, and for each ball its range, left child (right is the next; 0: a
    leaf), center, radius and sum. A child has a larger number than its parent."""

    def __init__(self, points, first, last, left, centers, radius, sums) -> None:
        self.points, self.first, self.last, self.left, self.centers, self.radius, self.sums = points, first, last, left, centers, radius, sums


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of some vectors, and their order in it. A ball is split at the median of the projection on the line
    through two far vectors."""
    order, ranges, left = np.arange(len(points)), [(0, len(points))], []
    centers, radius, sums = [], [], []
    at = 0
    while at < len(ranges):
        a, b = ranges[at]
        own = points[order[a:b]]
        total = own.sum(0)
        center = total // (b - a)
        far = squared(own, center[None])[:, 0]
        centers.append(center)
        sums.append(total)
        radius.append(np.sqrt(float(far.max())) * (1 + 1e-9))
        if b - a > LEAF and far.max() > 0:
            one = own[far.argmax()]
            two = own[squared(own, one[None])[:, 0].argmax()]
            place = own.astype(np.float64) @ (two - one).astype(np.float64)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(place, half)]
            left.append(len(ranges))
            ranges += [(a, a + half), (a + half, b)]
        else:
            left.append(0)
        at += 1
    first, last = np.array(ranges).T
    return Tree(points[order], first, last, np.array(left), np.array(centers), np.array(radius), np.array(sums)), order


def walk(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("ball", balls, their centroids) for balls that go whole, ("leaf", leaves, (leaves, centroids) those that are left)."""
    balls, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(balls):
        away = np.where(open_, np.sqrt(squared(tree.centers[balls], centroids).astype(np.float64)), np.inf)
        open_ &= away * (1 - 1e-9) <= (away.min(1) * (1 + 1e-9) + 2 * tree.radius[balls])[:, None]
        alone = open_.sum(1) == 1
        if alone.any():
            yield "ball", balls[alone], open_[alone].argmax(1)
        balls, open_ = balls[~alone], open_[~alone]
        leaf = tree.left[balls] == 0
        if leaf.any():
            yield "leaf", balls[leaf], open_[leaf]
        down = tree.left[balls[~leaf]]
        balls, open_ = np.concatenate([down, down + 1]), np.concatenate([open_[~leaf]] * 2)


def _rows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, and the range of each."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of vectors and the sum of each centroid."""
    count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for kind, balls, found in walk(tree, centroids):
        if kind == "ball":
            np.add.at(count, found, tree.last[balls] - tree.first[balls])
            np.add.at(sums, found, tree.sums[balls])
        else:
            at, of = _rows(tree.first[balls], tree.last[balls])
            best = nearest_of(tree.points[at], centroids, found[of])[0]
            np.add.at(count, best, 1)
            np.add.at(sums, best, tree.points[at])
    return count, sums


def nearest_of(points: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the open centroids of each vector, the first of equal ones, and its squared distance."""
    d = np.where(open_, squared(points, centroids), np.iinfo(np.int64).max)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid and squared distance of each vector of the tree, in its order."""
    cluster, distance = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64)
    for kind, balls, found in walk(tree, centroids):
        at, of = _rows(tree.first[balls], tree.last[balls])
        open_ = np.eye(len(centroids), dtype=bool)[found[of]] if kind == "ball" else found[of]
        cluster[at], distance[at] = nearest_of(tree.points[at], centroids, open_)
    return cluster, distance


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the usable rows of (vec_id, embedding): each component x as the whole number floor(scale * x)."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.where((F.size(x) == dimensions) & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    far = F.exists(x, lambda e: F.abs(e.cast("double") * scale) >= float(LARGE - 1))
    error = F.raise_error(F.lit(f"a component is beyond {LARGE // scale}")).cast("array<bigint>")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(far, error).otherwise(whole).alias("v"))


def seeds(vectors: DataFrame, k: int = CLUSTERS) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``1:<vec_id>``; rows without an id come last, ties go by the vector."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()]


def trees(vectors: DataFrame) -> DataFrame:
    """A row for each tree (TREES), built of the vectors of one partition and written to the shared folder."""
    names = [f.split()[0] for f in TREES.split(", ")]

    def pack(ids: np.ndarray, nulls: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        tree, order = build(points)
        parts = [ids[order], nulls[order], tree.points.astype(np.int32), tree.first, tree.last, tree.left, tree.centers.astype(np.int32), tree.radius, tree.sums]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            ids = batch.column(0)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            points = flat.reshape(batch.num_rows, -1)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), points))
            n += batch.num_rows
            while n >= TREE:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield pack(*(c[:TREE] for c in whole))
                held, n = [tuple(c[TREE:] for c in whole)], n - TREE
        if n:
            yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return stored(vectors.mapInArrow(grow, TREES), "trees")


def _read(batch: pa.RecordBatch, row: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)
    wide = lambda name, kind: get(name, kind).astype(np.int64).reshape(-1, dimensions)
    tree = Tree(wide("points", np.int32), get("first", np.int64), get("last", np.int64), get("left", np.int64), wide("centers", np.int32), get("radius", np.float64), wide("sums", np.int64))
    return get("ids", np.int64), get("id_null", bool), tree


def moved(grown: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floor of the mean of their vectors; those without any stay.

    A row for each centroid comes to the driver; sums are added as decimals, which can't overflow."""
    at = np.array(centroids, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                count, sums = totals(_read(batch, row, at.shape[1])[2], at)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    part = grown.mapInArrow(partial, "cluster int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(at.shape[1])]
    out = [list(c) for c in centroids]
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(at.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable row of (vec_id, embedding), stored, and the final centroids."""
    vectors = quantised(vectors, dimensions, scale)
    centroids = seeds(vectors, k)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    grown = trees(vectors)
    for _ in range(rounds):
        centroids = moved(grown, centroids)
    at = np.array(centroids, np.int64)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, nulls, tree = _read(batch, row, at.shape[1])
                found, distance = assigned(tree, at)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls), pa.array(found, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return stored(grown.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned"), centroids


def report(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row a usable vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    found, centroids = cluster(vectors.select("vec_id", "embedding"), k, rounds, dimensions, scale)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()} if centroids else {}
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values] or [F.lit(None)]), F.col("cluster") + 1).cast(kind)
    return found.select("vec_id", "cluster", "distance", of([sums.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """The rounds as common table expressions: distances by component, the nearest, floors of means."""
    near = lambda r: f"""d{r} AS MATERIALIZED (SELECT n, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM w JOIN c{r} USING (i) GROUP BY n, c),
        a{r} AS MATERIALIZED (SELECT n, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM d{r} GROUP BY n)"""  # noqa: E731
    move = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN (SELECT a.c, w.i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM w JOIN a{r} a USING (n) GROUP BY a.c, w.i) m USING (c, i))"""
    return ",\n".join(x for r in range(ROUNDS + 1) for x in ([near(r), move(r)] if r < ROUNDS else [near(r)]))


ORACLE_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}),
  w AS MATERIALIZED (SELECT n, unnest(range({DIMENSIONS})) AS i, unnest(v) AS x FROM v),
  s AS (SELECT n, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c FROM v),
  c0 AS MATERIALIZED (SELECT c, i, x AS y FROM s JOIN w USING (n) WHERE c < {CLUSTERS}),
  {_rounds()},
  h AS (SELECT c, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY c)
  SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
  FROM a{ROUNDS} a JOIN v USING (n) JOIN h ON h.c = a.c"""
