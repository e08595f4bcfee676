"""Trees in tables, each node with a pointer to its parent: depth, subtree sums and preorder by pointer jumping.

After k rounds a node knows its ancestor 2^k above, and the sums over what lies less than 2^k away from it, so the rounds grow
with the logarithm of the height. Every round is a join on the pointer, whose other side is unique, and a sum by the pointer,
which is added up before the shuffle: a node with a third of all others as its children is like any other. Siblings are put in
order by range partitions, and only totals of these meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.session import checkpointed


def _parents(nodes: DataFrame) -> DataFrame:
    """(node, up): the parents that are there; a node whose parent isn't is a root."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("__there"))
    up = F.when(F.col("__there"), F.col("parent"))
    return nodes.select("node", "parent").join(known, "parent", "left").select("node", up.alias("up"))


def _jumped(state: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A round: the pointers of the pointers, and ``columns`` of what a node holds and of what its ancestor there does (``a_...``)."""
    above = state.select(*[F.col(c).alias("up" if c == "node" else f"a_{c}") for c in state.columns])
    both = state.join(above, "up", "left")
    return both.select("node", F.col("a_up").alias("up"), *[v.alias(c) for c, v in columns.items()])


def ranks(df: DataFrame, by: str, order: list[str], size: str) -> DataFrame:
    """``before``: the sum of ``size`` over the rows of a group that come earlier in the order, for groups of any size.

    Rows are dealt by ranges of group and order, so that a large group lies in several partitions; sums run within a partition, and
    the totals of a group's partitions, one row each, give what stands before. Rows that tie in all of ``order`` are a fault of
    the caller's: their places are arbitrary."""
    dealt = checkpointed(df.repartitionByRange(by, *order)).withColumn("__part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    inner = Window.partitionBy("__part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(by, "__part").agg(F.sum(size).alias("__total"))
    outer = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), F.coalesce(F.sum("__total").over(outer), F.lit(0)).alias("__offset"))
    own = dealt.withColumn("__own", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    joined = own.join(offsets, (own["__part"] == offsets["__p"]) & own[by].eqNullSafe(offsets["__by"]))
    return joined.select(*[own[c] for c in df.columns], (F.col("__own") + F.col("__offset")).cast("long").alias("before"))


def shape(nodes: DataFrame) -> DataFrame:
    """(node, root, depth, pre, size, total) of nodes (node, parent, place, value), one row a node.

    ``depth`` is 0 for roots; ``pre`` numbers a tree's nodes from 0, parents before children and siblings by (place, node);
    ``size`` counts the nodes at and below, ``total`` sums their values (null counts as 0). A node with a null parent, or one
    that isn't there, is a root; roots have trees of their own. Nodes that a cycle of parents holds have nulls. ``node`` must be
    unique and not null."""
    nodes = checkpointed(nodes.select("node", "parent", "place", F.coalesce("value", F.lit(0)).cast("long").alias("value")))
    parents = checkpointed(_parents(nodes))
    start = parents.join(nodes.select("node", "value"), "node")
    state = checkpointed(start.select("node", "up", F.lit(0).cast("long").alias("depth"), F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.lit(1).cast("long").alias("size"), F.col("value").alias("total")))
    most, reach = nodes.count(), 1
    while reach <= most and state.where("up is not null").limit(1).count():
        below = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"), F.sum("total").alias("more_total"))
        new = _jumped(state, {"depth": F.when(F.col("a_depth").isNotNull(), F.col("a_depth") + reach).otherwise(F.col("depth")), "root": F.when(F.col("a_depth").isNotNull(), F.col("a_root")).otherwise(F.col("root")), "size": F.col("size"), "total": F.col("total")}).join(below, "node", "left")
        state = checkpointed(new.select("node", "up", "depth", "root", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("total") + F.coalesce("more_total", F.lit(0))).alias("total")))
        reach *= 2
    # A node's place is its parent's, one more, and the sizes of the siblings before it; these add up along the path.
    sized = state.where("root is not null").select("node", "root", "depth", "size", "total")
    inner = parents.where("up is not null").join(sized.select("node", "size"), "node").join(nodes.select("node", "place"), "node")
    steps = ranks(inner, "up", ["place", "node"], "size").select("node", (F.col("before") + 1).alias("pre"))
    path = checkpointed(parents.join(sized.select("node"), "node", "left_semi").join(steps, "node", "left").select("node", "up", F.coalesce("pre", F.lit(0)).alias("pre")))
    while path.where("up is not null").limit(1).count():
        path = checkpointed(_jumped(path, {"pre": F.col("pre") + F.coalesce("a_pre", F.lit(0))}))
    found = sized.join(path.select("node", "pre"), "node").select("node", "root", "depth", "pre", "size", "total")
    return nodes.select("node").join(found, "node", "left")


def totals(shaped: DataFrame, kinds: DataFrame, group: str) -> DataFrame:
    """One row a tree: root, shapes_total, top_level, nested, groups, max_depth and kinds_seen, in order of first appearance.

    The root stands for the page: depths count from its children on. ``kinds`` is (node, kind); ``group`` the kind that holds others."""
    rows = shaped.where("depth > 0").join(kinds, "node")
    n = F.count(F.lit(1))
    per_kind = rows.groupBy("root", "kind").agg(n.alias("n"), F.min("pre").alias("first"), F.max("depth").alias("deep"), F.count_if(F.col("depth") == 1).alias("top"))
    seen = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("first", "kind"))))
    out = per_kind.groupBy("root").agg(F.sum("n").alias("shapes_total"), F.sum("top").alias("top_level"), (F.sum("n") - F.sum("top")).alias("nested"), F.coalesce(F.sum(F.when(F.col("kind") == group, F.col("n"))), F.lit(0)).alias("groups"), (F.max("deep") - 1).alias("max_depth"), seen.alias("s"))
    return out.select("root", "shapes_total", "top_level", "nested", "groups", "max_depth", F.transform("s", lambda s: s["kind"]).alias("kinds_seen"))


def group_tally(shaped: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a tree: root, group_elements, members, covered, hidden and max_level of groups that hold members.

    ``facts``: (node, is_group, span, hidden). The root stands for the table. Only what hangs on groups alone counts, so rows below a
    member must not be among the nodes; members right below the table belong to no group."""
    rows = shaped.where("depth > 0").join(facts, "node")
    member = ~F.col("is_group") & (F.col("depth") > 1)
    sums = {"group_elements": F.count_if("is_group"), "members": F.count_if(member), "covered": F.coalesce(F.sum(F.when(member, F.col("span"))), F.lit(0)), "hidden": F.coalesce(F.sum(F.when(member & F.col("hidden"), F.col("span"))), F.lit(0)), "max_level": F.coalesce(F.max(F.when(member, F.col("depth") - 1)), F.lit(0))}
    return rows.groupBy("root").agg(*[v.cast("long").alias(c) for c, v in sums.items()])
