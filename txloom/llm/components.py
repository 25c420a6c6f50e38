"""Connected components of a table of links, by smallest labels and pointer jumping over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for each node of links (a, b; longs). An empty table gives no rows.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so the rounds grow
    with the logarithm of the longest chain. Hubs meet only in partial minima and in joins that can be split.
    """
    pairs = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(pairs.where("a <> b").distinct())
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("above"))
        jumped = stage(lower.join(up, lower["label"] == up["up"], "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        changed = jumped.where("label <> old").limit(1).count()
        unstage(lower)
        unstage(labels)
        labels = jumped.select("node", "label")
        if not changed:
            unstage(edges)
            return labels
