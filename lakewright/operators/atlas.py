"""Sprites on shelves, and layers of pixels one over another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.plans.scan import chunked, sorted_groups, whole
from lakewright.session import checkpointed

#: The smallest and the largest side of an atlas.
MIN_SIDE, MAX_SIDE = 64, 16384


KEYS = ["__atlas", "__chunk"]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sprites with their places, and whether all of their atlas, or chunk, fits."""
    for rows, first in whole(batches, KEYS):
        w, h, side = ([v or 0 for v in rows.column(c).to_pylist()] for c in ("w", "h", "side"))
        from_x, from_y, from_row = (rows.column(c).take(pa.array(first)).to_pylist() for c in ("__x", "__y", "__row"))
        ends = [*first[1:].tolist(), rows.num_rows]
        xs, ys, fits = [], [], []
        for k, (i, end) in enumerate(zip(first.tolist(), ends, strict=True)):
            x, y, row, fine = from_x[k] or 0, from_y[k] or 0, from_row[k] or 0, True
            for at in range(i, end):
                if x + w[at] > side[at]:
                    x, y, row = 0, y + row, h[at]
                elif h[at] > row:
                    row = h[at]
                xs.append(x)
                ys.append(y)
                fine = fine and w[at] <= side[at] and y + h[at] <= side[at]
                x += w[at]
            fits.append(fine)
        out = rows.drop_columns(["__x", "__y", "__row"]).append_column("x", pa.array(xs, pa.int64())).append_column("y", pa.array(ys, pa.int64()))
        yield from out.append_column("fits", pa.array(np.repeat(np.array(fits, bool), np.diff([*first, rows.num_rows])))).to_batches()


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: for every x that it may begin at, the x that it ends at, whether a row has ended by then, how high
    the rows that began in it and ended are, the height of the one that goes on, and what the row that it begins in holds of it."""
    for rows, first in whole(batches, KEYS):
        w, h, side = ([v or 0 for v in rows.column(c).to_pylist()] for c in ("w", "h", "side"))
        out = {c: [] for c in ("x", "new", "y", "row", "old")}
        for i, end in zip(first.tolist(), [*first[1:].tolist(), rows.num_rows], strict=True):
            # A sprite wider than the side ends its row further out than any other, and the next begins anew, as behind a full row.
            x = np.arange(max(side[i:end]) + 2)
            y, row, old, new, over = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x), np.zeros(len(x), bool), len(x) - 1
            for at in range(i, end):
                turn = x + w[at] > side[at]
                y += np.where(turn & new, row, 0)
                old = np.where(turn & ~new, row, old)
                row = np.where(turn, h[at], np.maximum(row, h[at]))
                new |= turn
                x = np.minimum(np.where(turn, w[at], x + w[at]), over)
            for c, v in zip(out, (x, new.astype(np.int64), y, row, old), strict=True):
                out[c].append(v.tolist())
        found = rows.select(KEYS).take(pa.array(first))
        for c, v in out.items():
            found = found.append_column(c, pa.array(v, pa.list_(pa.int64())))
        yield from found.to_batches()


def _entries(cut: DataFrame, order: list[str], kind: str) -> DataFrame:
    """(__b, __c, __x, __y, __row): where each chunk of a large atlas begins, from what its chunks before lead to, one row each."""
    longs = ", ".join(f"{c} array<long>" for c in ("x", "new", "y", "row", "old"))
    each = checkpointed(sorted_groups(cut, KEYS, order).mapInArrow(_ways, f"__atlas {kind}, __chunk int, {longs}"))
    zero = F.expr("named_struct('x', 0L, 'y', 0L, 'row', 0L, 'out', CAST(array() AS array<struct<c:int,x:bigint,y:bigint,row:bigint>>))")

    def fold(acc: Column, s: Column) -> Column:
        at = lambda c: F.get(s[c], F.least(acc["x"], F.size(s["x"]).cast("long") - 1).cast("int"))
        seen = F.struct(s["__chunk"].alias("c"), acc["x"].alias("x"), acc["y"].alias("y"), acc["row"].alias("row"))
        y = acc["y"] + F.when(at("new") == 1, F.greatest(acc["row"], at("old")) + at("y")).otherwise(F.lit(0))
        return F.struct(at("x").alias("x"), y.alias("y"), F.when(at("new") == 1, at("row")).otherwise(F.greatest(acc["row"], at("row"))).alias("row"), F.concat(acc["out"], F.array(seen)).alias("out"))

    steps = F.array_sort(F.collect_list(F.struct("__chunk", "x", "new", "y", "row", "old")))
    folded = each.groupBy("__atlas").agg(steps.alias("s")).select(F.col("__atlas").alias("__b"), F.explode(F.aggregate("s", zero, fold, lambda acc: acc["out"])).alias("e"))
    return checkpointed(folded.select("__b", F.col("e.c").alias("__c"), F.col("e.x").alias("__x"), F.col("e.y").alias("__y"), F.col("e.row").alias("__row")))


def shelves(sprites: DataFrame, atlas: str, side: Column) -> DataFrame:
    """(atlas, sprite, w, h, side, x, y, fits) of sprites (atlas, sprite, w, h) in rows that are filled one after another.

    Sprites come by height, the tallest first, then by number; one that doesn't fit beside those of its row begins the next, and a
    row is as high as its first. An atlas is read once in that order, in one task; one too large for that is cut into chunks
    (``plans.scan``), of which each is first read for every x that it may begin at, and the chunks of an atlas, one row each, are then
    followed from the first. ``side`` is one for all of an atlas. ``fits``: no sprite of the atlas is wider than the side, and all
    rows end within it; else places mean nothing."""
    order = ["__tall", "sprite"]
    sized = sprites.select(F.col(atlas).alias("__atlas"), "sprite", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), side.cast("long").alias("side"), (-F.col("h").cast("long")).alias("__tall"))
    dealt, large = chunked(sized, ["__atlas"], order)
    types = dict(dealt.dtypes)
    if large:
        size = dealt.groupBy("__atlas").agg(F.max("__chunk").alias("__most")).where("__most > 0").select(F.col("__atlas").alias("__b"))
        known = _entries(dealt.join(F.broadcast(size), F.col("__atlas").eqNullSafe(F.col("__b"))).drop("__b"), order, types["__atlas"])
        dealt = dealt.join(F.broadcast(known), F.col("__atlas").eqNullSafe(F.col("__b")) & (F.col("__chunk") == F.col("__c")), "left").drop("__b", "__c")
    else:
        dealt = dealt.select("*", *[F.lit(None).cast("long").alias(c) for c in ("__x", "__y", "__row")])
    schema = f"sprite {types['sprite']}, w long, h long, side long, __atlas {types['__atlas']}, __chunk int, x long, y long, fits boolean"
    ready = sorted_groups(dealt, KEYS, order).select("sprite", "w", "h", "side", *KEYS, "__x", "__y", "__row")
    placed = ready.mapInArrow(_places, schema)
    if large:
        bad = placed.where("not fits").select(F.col("__atlas").alias("__b")).distinct().withColumn("__bad", F.lit(True))
        placed = placed.join(bad, F.col("__atlas").eqNullSafe(F.col("__b")), "left").withColumn("fits", F.col("__bad").isNull())
    return placed.select(F.col("__atlas").alias(atlas), "sprite", "w", "h", "side", "x", "y", "fits")


def grown(sprites: DataFrame, atlas: str, side: int = MIN_SIDE) -> DataFrame:
    """``shelves`` at the first side, doubled from ``side`` on, at which all of an atlas fits; at most MAX_SIDE, where ``fits`` tells."""
    out, side = None, max(side, MIN_SIDE)
    left = checkpointed(sprites)
    while True:
        done = checkpointed(shelves(left, atlas, F.lit(side)))
        last = side >= MAX_SIDE
        out = done.where("fits" if not last else "true") if out is None else out.unionByName(done.where("fits" if not last else "true"))
        todo = done.where("not fits").select(F.col(atlas).alias("__atlas")).distinct()
        if last or not todo.limit(1).count():
            return out
        left = checkpointed(left.join(todo, left[atlas] == F.col("__atlas"), "left_semi"))
        side *= 2


def composited(layers: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, r, g, b, a): the layers (by, order, r, g, b, a) of each pixel one over another, the lowest ``order`` first.

    Whole numbers, not premultiplied, cut off at each step, so that the steps of a pixel can't be regrouped: they are folded in
    order over the pixel's list, which holds its layers alone, 48 bytes each. Layers without any alpha are left out before."""
    c = ["r", "g", "b", "a"]
    shown = layers.where("a > 0").select(*by, F.struct(F.col(order).alias("at"), *[F.col(x).cast("long").alias(x) for x in c]).alias("s"))
    clear = F.struct(*[F.lit(0).cast("long").alias(x) for x in c])
    cut = lambda p, q: F.call_function("div", p, q)

    def over(d: Column, s: Column) -> Column:
        under = lambda v: cut(v * (255 - s["a"]), F.lit(255))
        alpha = s["a"] + under(d["a"])
        mixed = [F.least(cut(s[x] * s["a"] + under(d[x] * d["a"]), alpha), F.lit(255)).cast("long").alias(x) for x in c[:3]]
        return F.struct(*mixed, F.least(alpha, F.lit(255)).cast("long").alias("a"))

    folded = shown.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list("s")), clear, over).alias("d"))
    pixels = layers.select(*by).distinct().join(folded, by, "left")
    return pixels.select(*by, *[F.coalesce(F.col(f"d.{x}"), F.lit(0)).alias(x) for x in c])
