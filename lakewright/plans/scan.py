"""Ordered scans of groups: small groups whole in a task, large ones in chunks of bounded size.

A group of up to CHUNK rows is sorted and read once, in one task. A larger one is cut into chunks at bounds of its order, so that
each is read like a group of its own, and what a chunk needs of those before it is the caller's to find from one row a chunk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.session import checkpointed

#: Rows of a group that one task may sort, and of a chunk, about; rows of a large group by which the bounds of a chunk are found.
CHUNK, SAMPLE = 200_000, 500


def chunked(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, bool]:
    """``df`` with ``__chunk``, which grows with the order within a group and is 0 in small ones, and whether any group is large.

    Groups are counted when this is called; bounds come from rows picked by a hash of their order, as many as CHUNK asks for."""
    n = F.count(F.lit(1)).alias("__n")
    large = checkpointed(df.groupBy(*by).agg(n).where(F.col("__n") > CHUNK).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], "__n"))
    if not large.limit(1).count():
        return df.withColumn("__chunk", F.lit(0)), False
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    names, at = [f"__b{i}" for i in range(len(by))], F.struct(*order)
    picked = df.join(F.broadcast(large), same).where(F.pmod(F.xxhash64(*order), F.lit(max(CHUNK // SAMPLE, 1))) == 0)
    parts = picked.groupBy(*names).agg(F.array_sort(F.collect_list(at)).alias("__s"), F.first("__n").alias("__n"))
    pieces = F.ceil(F.col("__n") / CHUNK).cast("int")
    bounds = F.transform(F.sequence(F.lit(1), pieces - 1), lambda k: F.get(F.col("__s"), (F.size("__s") * k / pieces).cast("int")))
    bounds = checkpointed(parts.where("size(__s) > 0").select(*names, F.array_compact(bounds).alias("__s")))
    chunk = F.coalesce(F.size(F.filter("__s", lambda b: b <= at)), F.lit(0))
    return df.join(F.broadcast(bounds), same, "left").withColumn("__chunk", F.when(F.col("__s").isNull(), 0).otherwise(chunk)).drop("__s", *names), True


def sorted_groups(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with those of a group behind one another in one partition, in order."""
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def begins(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Where groups begin in rows of sorted groups."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in by:
        column = rows.column(c).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        code = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterable[pa.RecordBatch], by: list[str], least: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of ``least`` rows or more, from a partition of sorted groups, each with where its groups begin."""
    held, n, need = [], 0, least
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < need:
            continue
        rows = pa.Table.from_batches(held)
        first = begins(rows, by)
        if len(first) < 2:
            need = 2 * n
            continue
        yield rows.slice(0, first[-1]), first[:-1]
        rest = rows.slice(first[-1])
        held, n, need = rest.to_batches(), rest.num_rows, least
    if n:
        rows = pa.Table.from_batches(held)
        yield rows, begins(rows, by)


def ranks(df: DataFrame, by: str, order: list[str], size: str) -> DataFrame:
    """``before``: the sum of ``size`` over the rows of a group that come earlier in the order, for groups of any size.

    Sums run within a group, or a chunk of a large one, and the totals of a large group's chunks, one row each, give what stands
    before. Rows that tie in all of ``order`` are a fault of the caller's: their places are arbitrary."""
    dealt, large = chunked(df, [by], order)
    inner = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    if not large:
        return own.select(*df.columns, F.col("__own").cast("long").alias("before"))
    outer = Window.partitionBy("__by").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(F.col(by).alias("__by"), F.col("__chunk").alias("__c")).agg(F.sum(size).alias("__total"))
    offsets = checkpointed(parts.withColumn("__offset", F.sum("__total").over(outer)).where("__c > 0").drop("__total"))
    joined = own.join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__chunk") == F.col("__c")), "left")
    return joined.select(*df.columns, (F.col("__own") + F.coalesce("__offset", F.lit(0))).cast("long").alias("before"))
