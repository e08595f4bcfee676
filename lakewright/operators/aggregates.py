"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators import joins


def stats_by_group(df: DataFrame, group: Column, size: Column) -> DataFrame:
    """Count, total and percent of the grand total (one decimal, half up; 0 if the total is 0) by group.

    Columns: grp, n, total, percent. The grand total is a scalar subquery over the groups.
    """
    totals = df.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("total"))
    whole = totals.agg(F.sum("total")).scalar()
    share = F.floor(F.col("total") * 1000.0 / whole + 0.5).cast("double") / 10
    return totals.select("grp", "n", "total", F.when(whole == 0, F.lit(0.0)).otherwise(share).alias("percent"))


def duplicate_groups(df: DataFrame, content: Column, size: Column, name: Column, least: int = 1) -> DataFrame:
    """Groups of equal content of ``least`` bytes or more: size, digest, n, first and the bytes wasted.

    Sizes that occur once can't be duplicates: a semi join drops their rows before anything is hashed.
    """
    sized = df.select(content.alias("content"), size.alias("size"), name.alias("name")).where(F.col("size") >= least)
    several = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    hashed = sized.join(several, "size", "left_semi").select("size", "name", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    groups = hashed.groupBy("size", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first")).where("n > 1")
    return groups.select("size", "digest", "n", "first", (F.col("size") * (F.col("n") - 1)).alias("wasted"))


def text_tally(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Characters, those that aren't white space, white-space separated words and non-empty lines of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    dense = F.regexp_replace(t, r"\s", "")
    return df.select(
        key,
        F.length(t).cast("long").alias("chars"),
        F.length(dense).cast("long").alias("dense_chars"),
        F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("long").alias("words"),
        F.size(F.filter(F.split(t, "\n"), lambda p: p.rlike(r"\S"))).cast("long").alias("paragraphs"),
    )


def scoped_tally(tally: DataFrame, scopes: dict[str, Column], columns: list[str]) -> DataFrame:
    """One row a scope with the sums of its rows; scopes may overlap. All in one pass."""
    sums = [F.sum(F.when(c, F.col(col)).otherwise(0)).cast("long").alias(f"{name}__{col}") for name, c in scopes.items() for col in columns]
    row = tally.agg(*sums)
    entry = lambda s: F.struct(F.lit(s).alias("scope"), *[F.col(f"{s}__{c}").alias(c) for c in columns])
    return row.select(F.explode(F.array(*[entry(s) for s in scopes])).alias("r")).select("r.*")


def declared_equals(declared: Column, actual: Column) -> Column:
    """Null if nothing was declared, else whether it is right."""
    return F.when(declared.isNotNull(), declared == actual)


def census(df: DataFrame, value: str, seq: str) -> DataFrame:
    """(value, n, first_seen) of every value but null."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seen"))


def written_states(df: DataFrame, column: str) -> DataFrame:
    """(n_null, n_empty, n_other): not written, written and empty, written."""
    c = F.col(column)
    n = lambda x: F.count_if(x).cast("long")
    return df.agg(n(c.isNull()).alias("n_null"), n(c == "").alias("n_empty"), n(c != "").alias("n_other"))


def grid_diff(pixels: DataFrame, cell_w: int, cell_h: int) -> DataFrame:
    """(gx, gy, n, score): mean absolute difference of columns a and b (0 to 255), as a share of 255, by grid cell."""
    at = lambda c, s: F.floor(F.col(c) / s).cast("long")
    return pixels.groupBy(at("x", cell_w).alias("gx"), at("y", cell_h).alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("a") - F.col("b")) / 255.0).alias("score"))


def grid_overall(grid: DataFrame) -> DataFrame:
    """(overall) of a grid's cells: the mean of their scores, weighted by their pixels; null for an empty grid."""
    return grid.agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("overall"))


def nested_total(df: DataFrame, arrays: list[str]) -> DataFrame:
    """The number of elements in all arrays of each column; a null array has none."""
    return df.agg(*[F.coalesce(F.sum(F.greatest(F.size(a), F.lit(0))), F.lit(0)).cast("long").alias(a) for a in arrays])


def band_usage(ports: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, low, high, used, free, ports) of each range: the used numbers in it, and how many are free.

    ``bands`` is a reference table of joins.SMALL_TABLE rows at most; a band's list holds its used numbers alone."""
    few = joins.small(bands, "bands")
    inside = (F.col("port") >= F.col("low")) & (F.col("port") <= F.col("high"))
    held = ports.select("port").distinct().join(few, inside).groupBy("band", "low", "high").agg(F.array_sort(F.collect_list("port")).alias("ports"))
    none = F.array().cast(held.schema["ports"].dataType)
    out = bands.select("band", "low", "high").distinct().join(held, ["band", "low", "high"], "left").withColumn("ports", F.coalesce("ports", none))
    used = F.size("ports").cast("long")
    return out.select("band", "low", "high", used.alias("used"), (F.col("high") - F.col("low") + 1 - used).alias("free"), "ports")


def success_counter(old: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, success_count, last_used): old counts plus one for each new event, with the newest time."""
    new = seen.select(key, F.lit(1).cast("long").alias("success_count"), F.col("at").alias("last_used"))
    both = old.select(key, "success_count", "last_used").unionByName(new)
    return both.groupBy(key).agg(F.sum("success_count").alias("success_count"), F.max("last_used").alias("last_used"))


def ext_totals(df: DataFrame, ext: Column, size: Column) -> DataFrame:
    """(n, total, by_ext): the whole and a map from extension to count with sorted keys."""
    per = df.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("total"))
    return per.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("by_ext"))


def sampled_duplicates(df: DataFrame, key: str, content: str, min_size: int, sample: int) -> DataFrame:
    """(hash, size, n, wasted, first) of the groups of equal contents of ``min_size`` bytes or more.

    Three steps, each on what the one before leaves: equal sizes; equal hashes of the first and last ``sample`` bytes; equal SHA-256 of all.
    What is shuffled is keys, sizes and hashes; contents are read again for the few that are left. Nulls are no contents."""
    raw = F.col(content).cast("binary")
    sized = df.select(key, content, F.length(raw).cast("long").alias("size")).where(F.col("size") >= min_size)

    def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
        several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
        return rows.join(several, keys, "left_semi")

    ends = F.xxhash64(F.substring(raw, 1, sample), F.substring(raw, -sample, sample))
    sampled = shared(shared(sized, ["size"]).withColumn("__ends", ends), ["size", "__ends"])
    groups = sampled.groupBy(F.sha2(raw, 256).alias("hash"), "size").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")
    return groups.select("hash", "size", "n", (F.col("size") * (F.col("n") - 1)).alias("wasted"), "first")
