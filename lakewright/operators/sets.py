"""Unions, distinct rows and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.joins import first_of_each


def union_of_providers(parts: dict[str, DataFrame], name: str, cap: int = 1000) -> DataFrame:
    """All providers' rows by name, prefixed ``provider__``, sorted, at most ``cap``."""
    each = [df.select(F.concat(F.lit(f"{p}__"), F.col(name)).alias(name), F.lit(p).alias("provider")) for p, df in parts.items()]
    return reduce(DataFrame.unionByName, each).orderBy(name, "provider").limit(cap)


def distinct_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return first_of_each(df, key, order)


def sorted_distinct(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def categories(df: DataFrame, name: str, mark: str = "__") -> DataFrame:
    return df.select(F.substring_index(name, mark, 1).alias("category")).distinct()


def upsert_keep_first(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones whose key is not there yet (the first of each by its other columns)."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return first_of_each(both, [key], ["__age", *rest]).drop("__age")


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't among the new, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_value_of(df: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, seq).alias(value))
