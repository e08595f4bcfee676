"""Top-k, tails and bounded reports. Ties are always broken by a key, so that results repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest(df: DataFrame, size: str, key: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(size), F.asc(key)).limit(k)


def newest(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(key)).limit(k)


def tail(df: DataFrame, key: str, n: int, most: int = 500) -> DataFrame:
    """The last n rows (1 to ``most``) in their order."""
    return df.orderBy(F.desc(key)).limit(min(max(n, 1), most)).orderBy(key)


def take_report(df: DataFrame, order: str, limit: int, default: int = 100) -> DataFrame:
    """(count, listed, cut) of a listing of at most ``limit`` rows; 0 is the default."""
    k = limit or default
    whole = df.agg(F.count(F.lit(1)).alias("count"))
    return whole.select("count", F.least("count", F.lit(k).cast("long")).alias("listed"), (F.col("count") > k).alias("cut"))


def matching_any_like(df: DataFrame, column: str, patterns: list[str], key: str, k: int = 50, ignore_case: bool = False) -> DataFrame:
    """Rows that are LIKE any pattern, the newest k by key."""
    c = F.col(column)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (c.ilike(p) if ignore_case else c.like(p))
    return newest(df.where(hit), key, k)
