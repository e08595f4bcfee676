"""Dataflow graphs: faults and levels of a small specification, and of graphs that are kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.session import Written, checkpointed


def check(nodes: list[str], edges: list[tuple[str, str]], known: set[str] | None = None) -> list[str]:
    """Every fault of a small graph, given as lists: repeated or unknown nodes, edges to nowhere or to themselves, cycles.

    For specifications that a person writes; ``faults`` and ``levels`` take tables."""
    faults = [f"node {n} is repeated" for n in sorted({n for n in nodes if nodes.count(n) > 1})]
    if known is not None:
        faults += [f"node {n} has no command" for n in nodes if n not in known]
    for a, b in edges:
        faults += [f"edge {a}->{b}: no node {x}" for x in (a, b) if x not in nodes]
        if a == b:
            faults.append(f"edge {a}->{b} is a loop")
    left = stages(nodes, edges)[1]
    return faults + ([f"cycle among {', '.join(sorted(left))}"] if left else [])


def stages(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[list[list[str]], set[str]]:
    """Nodes by level (longest path from a root), and the nodes that a cycle leaves over."""
    left, out = set(nodes), []
    inner = [(a, b) for a, b in edges if a in left and b in left]
    while left:
        ready = sorted(n for n in left if not any(b == n and a in left for a, b in inner))
        if not ready:
            break
        out.append(ready)
        left -= set(ready)
    return out, left


def faults(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(fault, src, dst) of a graph in tables: nodes (node, command) that are repeated or whose command ``known`` (command)
    lacks, edges (src, dst) that are loops or name a node that isn't there. Cycles: see ``levels``."""
    row = lambda fault, a: [F.lit(fault).alias("fault"), F.col(a).alias("src")]
    none = F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")
    out = nodes.groupBy("node").count().where("count > 1").select(*row("repeated node", "node"), none)
    if known is not None:
        out = out.unionByName(nodes.join(known, "command", "left_anti").select(*row("unknown command", "node"), none))
    out = out.unionByName(edges.where("src = dst").select(*row("loop", "src"), "dst"))
    names = nodes.select("node").distinct()
    for side in ("src", "dst"):
        lost = edges.join(names.withColumnRenamed("node", side), side, "left_anti")
        out = out.unionByName(lost.select(*row(f"no node at {side}", "src"), "dst"))
    return out


def _peel(edges: Written, nodes: DataFrame | None) -> tuple[DataFrame, Written]:
    """(node, level) by Kahn's rounds, and a table of edges that has all those left over. A round takes the nodes without open edges
    into them and lowers the counts of the nodes that these lead to. Null levels: what no round took.

    Edges are read in every round and written anew when less than half of them are left, so that all writing is of twice as many at
    most; what a table replaces is taken away."""
    into = edges.df.select(F.col("dst").alias("node"), F.lit(1).alias("open"))
    ends = into.unionByName(edges.df.select(F.col("src").alias("node"), F.lit(0).alias("open")))
    ends = ends if nodes is None else ends.unionByName(nodes.where("node is not null").select("node", F.lit(0).alias("open")))
    todo = Written(ends.groupBy("node").agg(F.sum("open").alias("open")))
    held, done, level = None, [], 0
    while True:
        free, left = todo.df.agg(F.count_if(F.col("open") == 0), F.coalesce(F.sum("open"), F.lit(0))).first()
        held = left if held is None else held
        if not free:
            break
        if 2 * left < held:
            fewer = Written(edges.df.join(todo.df.select(F.col("node").alias("src")), "src", "left_semi"))
            edges.drop()
            edges, held = fewer, left
        ready = Written(todo.df.where("open = 0").select("node", F.lit(level).cast("long").alias("level")))
        done.append(ready)
        level += 1
        # Ready nodes are unique, so that a hash table of a partition's is of bounded size, and edges need no sort.
        src = ready.df.select(F.col("node").alias("src")).hint("shuffle_hash")
        freed = edges.df.join(src, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("freed"))
        rest = Written(todo.df.where("open > 0").join(freed, "node", "left").select("node", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")))
        todo.drop()
        todo = rest
        if len(done) == 16:
            done = [_merged(done)]
    out = todo.df.select("node", F.lit(None).cast("long").alias("level"))
    for part in done:
        out = out.unionByName(part.df)
    return out, edges


def _merged(parts: list[Written]) -> Written:
    both = parts[0].df
    for part in parts[1:]:
        both = both.unionByName(part.df)
    out = Written(both)
    for part in parts:
        part.drop()
    return out


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level, state) of an edge table (src, dst), one row a node, by peeling the frontier.

    The level is the length of the longest path from a root; nodes of a level can run side by side. A cycle's nodes have no
    level, nor have those behind it: ``state`` is "ready", "cycle" (on a cycle, or on a path from one to another) or
    "behind". Loops are cycles of one; repeated edges count as often as they stand there. ``nodes`` (node) adds nodes without edges;
    edges with a null end are left out. A few jobs for each level; each reads what is left of the nodes, and the edges."""
    given = Written(edges.select("src", "dst").where("src is not null and dst is not null"))
    found, rest = _peel(given, nodes)
    left = found.where("level is null").select("node")
    if not left.limit(1).count():
        return found.withColumn("state", F.lit("ready"))
    # What can be peeled from the other end lies behind the cycles.
    inner = rest.df.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
    back = _peel(Written(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), left)[0].withColumnRenamed("level", "back")
    state: Column = F.when(F.col("level").isNotNull(), "ready").when(F.col("back").isNull(), "cycle").otherwise("behind")
    return found.join(back, "node", "left").select("node", "level", state.alias("state"))


def linked(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); the label is the smallest node that it hangs together with.

    Every round a node, and the node of its label, take the smallest label of a label among its neighbours', and every label jumps to
    its own, so that the rounds grow with the logarithm of a component's size; only whether one changed comes to the driver."""
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        state = checkpointed(labels.join(above, "label").select("node", "label", "top"))
        near = both.join(state.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("near"))
        told = state.join(near, "node")
        rows = told.select("node", F.least("top", "near").alias("next")).unionByName(told.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("next")))
        new = rows.groupBy("node").agg(F.min("next").alias("next"))
        new = checkpointed(new.join(state.select("node", "label"), "node").select("node", F.least("next", "label").alias("next"), "label"))
        labels = new.select("node", F.col("next").alias("label"))
        if not new.where("next <> label").limit(1).count():
            return labels
