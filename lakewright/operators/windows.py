"""Ordered operators as window functions. Every operator takes a partition key, so that no order spans the whole table unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_gaps(df: DataFrame, by: list[str], start: str, length: str) -> DataFrame:
    """(by, kind, start, length): claimed spans clipped to what is before them, and the gaps between."""
    end = F.col(start) + F.col(length)
    before = Window.partitionBy(*by).orderBy(F.col(start), end).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.select(*by, F.col(start).alias("start"), end.alias("end"), F.max(end).over(before).alias("reach"))
    gap = F.when(F.col("start") > F.col("reach"), F.struct(F.lit("gap").alias("kind"), F.col("reach").alias("start"), (F.col("start") - F.col("reach")).alias("length")))
    clipped = F.greatest(F.col("start"), F.coalesce("reach", "start"))
    claim = F.when(F.col("end") > clipped, F.struct(F.lit("claimed").alias("kind"), clipped.alias("start"), (F.col("end") - clipped).alias("length")))
    return seen.select(*by, F.explode(F.array_compact(F.array(gap, claim))).alias("s")).select(*by, "s.*")


def region_totals(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, claimed, unreferenced): lengths by kind; with both, the parts tile the range."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).cast("long")
    return spans.groupBy(*by).agg(part("claimed").alias("claimed"), part("gap").alias("unreferenced"))


def adjacent_runs(df: DataFrame, by: list[str], order: list[str], same: list[str], text: str | None = None) -> DataFrame:
    """Consecutive rows with equal ``same`` columns as one: (by, run, same, first, n, text), texts in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    flag = F.when(change | (F.row_number().over(w) == 1), 1).otherwise(0)
    numbered = df.withColumn("__new", flag).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda s: s["__t"]), "").alias("text")] if text else []
    return numbered.groupBy(*by, "run", *same).agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("n"), *more)


def latest_of_each(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by a grouped maximum and no sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("last")
    return df.groupBy(*key).agg(last).select(*key, "last.*")


def marker_blocks(df: DataFrame, by: list[str], order: str, line: str, marker: str) -> DataFrame:
    """``k=v`` lines up to each ``marker=`` line as one map: (by, block, fields); an unfinished block is left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col(line).startswith(f"{marker}="), 1).otherwise(0)
    each = df.withColumn("__end", ends).withColumn("block", F.coalesce(F.sum("__end").over(w), F.lit(0)))
    key, value = F.trim(F.substring_index(line, "=", 1)), F.trim(F.expr(f"substring({line}, instr({line}, '=') + 1)"))
    pairs = each.where(F.col(line).contains("=")).select(*by, "block", "__end", key.alias("k"), value.alias("v"), F.col(order).alias("__at"))
    last = pairs.groupBy(*by, "block", "k").agg(F.max_by("v", "__at").alias("v"), F.max("__end").alias("__end"))
    whole = last.groupBy(*by, "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"), F.max("__end").alias("__end"))
    return whole.where("__end = 1").drop("__end")


def newest_percent(df: DataFrame, by: list[str], seq: str, done: str, total: Column) -> DataFrame:
    """(by, percent) of the newest sample, within 0 and 100; null if the total isn't above 0."""
    last = df.groupBy(*by).agg(F.max_by(F.struct(F.col(done).alias("d"), total.alias("t")), seq).alias("s"))
    share = F.least(F.greatest(F.col("s.d") * 100.0 / F.col("s.t"), F.lit(0.0)), F.lit(100.0))
    return last.select(*by, F.when(F.col("s.t") > 0, share).alias("percent"))


def keep_if_same_next(df: DataFrame, by: list[str], order: list[str], is_row: Column, is_boundary: Column, who: str) -> DataFrame:
    """``keep``: for a row, whether the first row or boundary after it is a row of the same ``who``; null elsewhere."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    event = F.when(is_row, F.concat(F.lit("r"), F.coalesce(F.col(who).cast("string"), F.lit("")))).when(is_boundary, F.lit("b"))
    following = F.first(event, ignorenulls=True).over(w)
    mine = F.concat(F.lit("r"), F.coalesce(F.col(who).cast("string"), F.lit("")))
    return df.withColumn("keep", F.when(is_row, F.coalesce(following == mine, F.lit(False))))


def inherit(df: DataFrame, by: list[str], order: str, value: str, chain: Column) -> DataFrame:
    """``effective``: an empty value in the chain is that of the last one before; a row outside breaks the chain."""
    w = Window.partitionBy(*by).orderBy(order)
    broken = F.sum(F.when(chain, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inner = Window.partitionBy(*by, "__chain").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__chain", broken)
    return out.withColumn("effective", F.when(chain, F.last(F.when(chain, F.col(value)), ignorenulls=True).over(inner)).otherwise(F.col(value))).drop("__chain")


def playhead(frames: DataFrame, seq: str, index: str, ticks: str, loop_to: Column, at: Column) -> DataFrame:
    """(seq, at, frame): the frame shown ``at`` ticks after the start of a sequence that loops back to ``loop_to``.

    A sequence plays once from the start; then the part from ``loop_to`` (0 if out of range) repeats.
    """
    upto = Window.partitionBy(seq).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(seq)
    placed = frames.select(seq, F.col(index).alias("frame"), F.col(ticks).alias("t"), loop_to.alias("to"), at.alias("at"), F.sum(ticks).over(upto).alias("end"), F.sum(ticks).over(whole).alias("all"), F.count(F.lit(1)).over(whole).alias("n"))
    start = F.when((F.col("to") < 0) | (F.col("to") >= F.col("n")), 0).otherwise(F.col("to"))
    intro = F.coalesce(F.sum(F.when(F.col("frame") < start, F.col("t"))).over(whole), F.lit(0))
    cycle = F.col("all") - intro
    local = F.when(F.col("at") < F.col("all"), F.col("at")).when(cycle > 0, intro + F.pmod(F.col("at") - F.col("all"), cycle))
    shown = placed.withColumn("__local", local).where((F.col("__local") >= F.col("end") - F.col("t")) & (F.col("__local") < F.col("end")))
    return shown.select(seq, "at", "frame")


def failure_streaks(df: DataFrame, by: list[str], order: str, failed: Column) -> DataFrame:
    """``streak``: failures in a row up to each row; a success sets it to 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("__ok", F.sum(F.when(failed, 0).otherwise(1)).over(w)).withColumn("__f", F.when(failed, 1).otherwise(0))
    inner = Window.partitionBy(*by, "__ok").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum("__f").over(inner)).drop("__ok", "__f")


def high_water(df: DataFrame, by: list[str], order: list[str], ts: str, text: str) -> DataFrame:
    """Rows with text whose time is above all times of such rows before: a strict running maximum, not a watermark."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    real = df.where(F.length(text) > 0).withColumn("__mark", F.max(ts).over(w))
    return real.where(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark")


def filled(df: DataFrame, by: list[str], order: str, value: str, marks: Column, name: str) -> DataFrame:
    """``name``: the value of the last row up to each that is marked; null in front of the first."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(marks, F.col(value)), ignorenulls=True).over(upto))
