"""Pixels and grids as rows (image_id, x, y, r, g, b). One image is one group: what depends on its pixels' order runs in pandas."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.plans.graph import linked
from lakewright.plans.scan import ranks, sorted_groups, whole
from lakewright.session import checkpointed

#: Pixels of a tile's side.
TILE = 256
NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def dominant_colors(pixels: DataFrame, tolerance: int, top: int = 5) -> DataFrame:
    """(image_id, rank, r, g, b, n, percent): greedy clusters in page order; a pixel joins the first whose running mean is near in every channel."""

    def cluster(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values(["y", "x"], kind="stable")
        sums, counts = np.zeros((0, 3)), np.zeros(0)
        for p in image[["r", "g", "b"]].to_numpy(float):
            near = np.flatnonzero((np.abs(sums / counts[:, None] - p) <= tolerance).all(1)) if len(counts) else []
            if len(near):
                sums[near[0]] += p
                counts[near[0]] += 1
            else:
                sums, counts = np.vstack([sums, p]), np.append(counts, 1)
        best = np.argsort(-counts, kind="stable")[:top]
        mean = np.floor(sums[best] / counts[best, None] + 0.5).astype(int)
        return pd.DataFrame({"image_id": image["image_id"].iloc[0], "rank": np.arange(1, len(best) + 1), "r": mean[:, 0], "g": mean[:, 1], "b": mean[:, 2], "n": counts[best].astype(int), "percent": np.round(100 * counts[best] / len(image), 2)})

    kind = dict(pixels.dtypes)["image_id"]
    return pixels.groupBy("image_id").applyInPandas(cluster, f"image_id {kind}, rank int, r int, g int, b int, n long, percent double")


def pick_color(pixels: DataFrame, palette: DataFrame, tolerance: int) -> DataFrame:
    """(image_id, name, how): the palette colour that is there exactly, else that with most pixels within the tolerance, else none.

    Pixels are counted by colour first; colours and palette meet by cells of the colour cube, each palette colour in the 27 cells
    that hold all that is within the tolerance, so that neither side is compared as a whole.
    """
    colors = pixels.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    p = palette.select("name", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))
    cell = lambda c: F.floor(F.col(c) / (tolerance + 1))
    colors = colors.withColumns({f"c{c}": cell(c) for c in "rgb"})
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip("xyz", step, strict=True)]) for step in product((-1, 0, 1), repeat=3)]))
    p = p.select("*", around.alias("d")).select("name", "pr", "pg", "pb", *[(cell(f"p{c}") + F.col(f"d.{k}")).alias(f"c{c}") for c, k in zip("rgb", "xyz", strict=True)])
    apart = F.greatest(F.abs(F.col("r") - F.col("pr")), F.abs(F.col("g") - F.col("pg")), F.abs(F.col("b") - F.col("pb")))
    met = colors.join(p, ["cr", "cg", "cb"]).where(apart <= tolerance).groupBy("image_id", "name").agg(F.sum(F.when(apart == 0, F.col("n")).otherwise(0)).alias("exact"), F.sum("n").alias("near"))
    rank = F.struct((F.col("exact") > 0).alias("is_exact"), F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("near")).alias("n"), F.col("name"))
    best = met.groupBy("image_id").agg(F.max(rank).alias("best"))
    images = pixels.select("image_id").distinct()
    how = F.when(F.col("best").isNull(), "none").when(F.col("best.is_exact"), "exact").otherwise("near")
    return images.join(best, "image_id", "left").select("image_id", F.col("best.name").alias("name"), how.alias("how"))


def _labels(code: np.ndarray) -> np.ndarray:
    """The place of the first pixel that each hangs together with, of the sorted codes (tile, y, x) of pixels of some tiles."""
    x, y = code % TILE, code // TILE % TILE
    ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        own = np.flatnonzero((x + dx >= 0) & (x + dx < TILE) & (y + dy < TILE))
        other = np.searchsorted(code, code[own] + dy * TILE + dx)
        there = np.flatnonzero(code[np.minimum(other, len(code) - 1)] == code[own] + dy * TILE + dx)
        ends.append((own[there], other[there]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    label = np.arange(len(code))
    while True:
        p, q = label[a], label[b]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label = label[label]


def _tile_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The connected parts within each tile, and those of their pixels that lie at its edge."""
    for rows, first in whole(batches, ["image_id", "ty", "tx"]):
        tile = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
        x, y = (rows.column(c).to_numpy() for c in "xy")
        code = np.unique((tile * TILE + y % TILE) * TILE + x % TILE)
        label = _labels(code)
        heads, part = np.unique(label, return_inverse=True)
        at = first[code // TILE**2]
        px, py = x[at] // TILE * TILE + code % TILE, y[at] // TILE * TILE + code // TILE % TILE
        out = {"image_id": rows.column("image_id").take(pa.array(at[heads])), "y": py[heads], "x": px[heads], "n": np.bincount(part)}
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(len(heads)))
        for name, f, v in (("min_x", np.minimum, px), ("min_y", np.minimum, py), ("max_x", np.maximum, px), ("max_y", np.maximum, py)):
            out[name] = f.reduceat(v[order], cut)
        edge = order[((px % TILE + 1) % TILE < 2)[order] | ((py % TILE + 1) % TILE < 2)[order]]
        offsets = pa.array(np.searchsorted(part[edge], np.arange(len(heads) + 1)), pa.int32())
        out["edge_y"], out["edge_x"] = (pa.ListArray.from_arrays(offsets, pa.array(v[edge], pa.int64())) for v in (py, px))
        yield from pa.table(out).to_batches()


def components(mask: DataFrame) -> DataFrame:
    """(image_id, component, n, min_x, min_y, max_x, max_y) of 8-connected pixels (x, y), largest first, then by the first pixel.

    Tiles of TILE by TILE pixels are labelled each in one task. What meets across edges of tiles are links between their parts, and
    the connected parts of these, which are as many as the edges are long at most, are found in a number of rounds that grows with the
    logarithm of a component's tiles; only whether any label changed comes to the driver. An image may be of any size; repeated
    pixels are one, pixels without a place or an image are left out.
    """
    long = [F.col(c).cast("long").alias(c) for c in "xy"]
    pixels = mask.select("image_id", *long).dropna().withColumns({f"t{c}": F.floor(F.col(c) / TILE) for c in "xy"})
    kind, schema = dict(pixels.dtypes)["image_id"], "y long, x long, n long, min_x long, min_y long, max_x long, max_y long, edge_y array<long>, edge_x array<long>"
    parts = sorted_groups(pixels, ["image_id", "ty", "tx"], []).mapInArrow(_tile_parts, f"image_id {kind}, {schema}")
    parts = checkpointed(parts.withColumn("node", F.monotonically_increasing_id()))
    edges = parts.select("image_id", "node", F.explode(F.arrays_zip("edge_y", "edge_x")).alias("e")).select("image_id", "node", F.col("e.edge_y").alias("y"), F.col("e.edge_x").alias("x"))
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    told = edges.select("image_id", F.col("node").alias("a"), "y", "x", step.alias("d")).select("image_id", "a", *[(F.col(c) + F.col(f"d.{c}")).alias(c) for c in "yx"])
    links = told.join(edges.withColumnRenamed("node", "b"), ["image_id", "y", "x"]).where("a <> b").select("a", "b")
    labelled = parts.drop("edge_y", "edge_x").join(linked(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = {c: F.min(c) for c in ("min_x", "min_y")} | {c: F.max(c) for c in ("max_x", "max_y")}
    met = labelled.groupBy("image_id", "label").agg(F.sum("n").alias("n"), *[f.alias(c) for c, f in lowest.items()], F.min(F.struct("y", "x")).alias("at"))
    ordered = met.select("*", F.col("at.y").alias("y"), F.col("at.x").alias("x"), (-F.col("n")).alias("__large"), F.lit(1).alias("__one"))
    placed = ranks(ordered, "image_id", ["__large", "y", "x"], "__one")
    own = lambda c: F.col(c).cast(mask.schema[c[-1]].dataType).alias(c)
    return placed.select("image_id", (F.col("before") + 1).cast("int").alias("component"), "n", *[own(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def life_step(live: DataFrame, width: int, height: int) -> DataFrame:
    """The live cells (x, y) after one step of B3/S23 on a bounded grid: every cell tells its neighbours, who count."""
    told = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(int((dx, dy) == (0, 0))).alias("own")) for dx, dy in [*NEIGHBOURS, (0, 0)]]))
    each = live.select("x", "y", told.alias("t")).select((F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y"), "t.own")
    each = each.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    counted = each.groupBy("x", "y").agg(F.sum("own").alias("own"), F.count_if(F.col("own") == 0).alias("n"))
    return counted.where((F.col("n") == 3) | ((F.col("n") == 2) & (F.col("own") > 0))).select("x", "y")


def top_cells(cells: DataFrame, score: str, k: int, *ties: Column | str) -> DataFrame:
    return cells.orderBy(F.desc(score), *ties).limit(k)
