"""Nesting, referential checks and other joins. Strategies are left to Spark, which picks them by size at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nest(parents: DataFrame, children: DataFrame, key: str, foreign: str, child: list[str], name: str) -> DataFrame:
    """Every parent with its children as an array of structs in the order of their first column; none gives an empty array.

    The children are grouped before the join, so that the join has one row a parent.
    """
    grouped = children.groupBy(F.col(foreign).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*child))).alias(name))
    empty = F.array().cast(grouped.schema[name].dataType)
    return parents.join(grouped, parents[key] == F.col("__key"), "left").withColumn(name, F.coalesce(name, empty)).drop("__key")


def existing(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def missing(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, foreign: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children that stay when the parents in ``gone`` (a column ``key``) go."""
    dead = gone.select(key).distinct()
    return parents.join(dead, key, "left_anti"), children.join(dead, children[foreign] == dead[key], "left_anti")


def beyond_newest(df: DataFrame, key: str, keep: int) -> DataFrame:
    """The rows that a retention of the newest ``keep`` by key would drop; null-aware, as NOT IN is."""
    return df.sparkSession.sql(f"SELECT * FROM {{df}} WHERE {key} NOT IN (SELECT {key} FROM {{df}} ORDER BY {key} DESC NULLS LAST LIMIT {int(keep)})", df=df)


def two_way_orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(left_only, right_only, matched): distinct keys on one side alone, and on both."""
    a, b = left.select(on).where(F.col(on).isNotNull()).distinct().withColumn("l", F.lit(1)), right.select(on).where(F.col(on).isNotNull()).distinct().withColumn("r", F.lit(1))
    both = a.join(b, on, "full_outer")
    n = lambda c: F.count_if(c).cast("long")
    return both.agg(n(F.col("r").isNull()).alias("left_only"), n(F.col("l").isNull()).alias("right_only"), n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"))


def three_state(df: DataFrame, book: DataFrame | None, ref: str, key: str) -> DataFrame:
    """``resolved``: true or false if there is a book of targets, null if there is none."""
    if book is None:
        return df.withColumn("resolved", F.lit(None).cast("boolean"))
    known = book.select(F.col(key).alias("__key")).distinct().withColumn("__found", F.lit(True))
    return df.join(known, df[ref] == F.col("__key"), "left").withColumn("resolved", F.coalesce("__found", F.lit(False))).drop("__key", "__found")


def override_or_default(df: DataFrame, overrides: DataFrame, defaults: DataFrame, key: str, ext: Column, value: str) -> DataFrame:
    """A value by key, else by extension; null if neither has one."""
    o = overrides.select(F.col(key).alias("__k"), F.col(value).alias("__o"))
    d = defaults.select(F.col("ext").alias("__e"), F.col(value).alias("__d"))
    out = df.withColumn("__ext", ext).join(o, df[key] == F.col("__k"), "left").join(d, F.col("__ext") == F.col("__e"), "left")
    return out.withColumn(value, F.coalesce("__o", "__d")).drop("__k", "__o", "__e", "__d", "__ext")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row at or before it, by one sort of the union and no join."""
    l = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    r = right.select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", F.col("__last").alias(value))


def collisions(df: DataFrame, target: str, taken: DataFrame | None = None) -> DataFrame:
    """(target, n, exists): targets of several rows, or taken already."""
    n = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    if taken is None:
        return n.where("n > 1").withColumn("exists", F.lit(False))
    have = taken.select(target).distinct().withColumn("exists", F.lit(True))
    return n.join(have, target, "left").withColumn("exists", F.coalesce("exists", F.lit(False))).where("n > 1 or exists")


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, nulls first; a key's rows are folded before the shuffle, not sorted in one task."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, F.struct(*df.columns).alias("__row"))).alias("__first"))
    return first.select("__first.__row.*")


def unambiguous(df: DataFrame, name: str, target: str) -> DataFrame:
    """(name, target) of names with one distinct target."""
    return df.groupBy(name).agg(F.min(target).alias(target), F.count_distinct(target).alias("n")).where("n = 1").drop("n")


def ambiguous(df: DataFrame, name: str, target: str) -> DataFrame:
    """The number of names with several distinct targets."""
    return df.groupBy(name).agg(F.count_distinct(target).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("conflicts"))


def rect_overlaps(df: DataFrame, group: list[str], cell: int = 16) -> DataFrame:
    """Pairs (earlier, later) of overlapping rectangles (id, x0, y0, x1, y1, ends included) of a group.

    Rectangles meet in grid cells of side ``cell``, so that the join has a key besides the group; a pair
    is kept in the one cell that holds the upper left corner of what it shares. Reversed rectangles overlap nothing.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    proper = df.where("x0 <= x1 and y0 <= y1").select(*group, "id", "x0", "y0", "x1", "y1")
    cells = proper.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    a, b = cells.alias("a"), cells.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*group, "cx", "cy"]]
    hit = (F.col("a.id") < F.col("b.id")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    home = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a.cy"))
    on = same[0]
    for c in [*same[1:], hit, home]:
        on = on & c
    return a.join(b, on).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.id").alias("earlier"), F.col("b.id").alias("later"))


def domain_suffix(hosts: DataFrame, host: str, cookies: DataFrame, domain: str) -> DataFrame:
    """Hosts with the cookies of their own or a parent domain: an equi-join on the host's exploded parents."""
    labels = F.split(F.lower(F.col(host)), r"\.")
    parents = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    each = hosts.withColumn("__parent", F.explode(F.array_distinct(parents)))
    return each.join(cookies, F.col("__parent") == F.lower(F.col(domain))).drop("__parent")


#: Rows of a reference table that may be sent to every task and compared with every row.
SMALL_TABLE = 2000


def small(df: DataFrame, what: str) -> DataFrame:
    """A reference table to be broadcast; more than SMALL_TABLE rows are an error."""
    if df.limit(SMALL_TABLE + 1).count() > SMALL_TABLE:
        raise ValueError(f"{what}: more than {SMALL_TABLE} rows, which would be compared with every row")
    return F.broadcast(df)


def best_match(left: DataFrame, key: str, rules: DataFrame, conditions: list[Column]) -> DataFrame:
    """Each left row with its best rule: the first condition that holds decides, ties go to the smallest rule id.

    ``rules`` is a reference table with ``rule_id``, of SMALL_TABLE rows at most; conditions may look at both sides. For many keys
    that texts contain see ``contains.first_rule``.
    """
    rules = small(rules, "rules")
    rank = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])
    met = left.join(rules, rank.isNotNull(), "left").withColumn("priority", rank)
    return first_of_each(met, [key], ["priority", "rule_id"])
