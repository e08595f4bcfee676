"""Connected components of a graph of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b); label is the component's smallest node.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so
    that the rounds grow with the logarithm of the longest path; a component that is a star around its
    smallest node needs two. Every round is written out, which keeps the plans short. Nothing but the
    number of changed labels comes to the driver. An empty table of links gives no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        jumped = stored(hooked.join(up, "next").select("node", F.least("next", "up").alias("next"), "label"), "labels")
        changed = jumped.where("next <> label").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
