"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node). edges: a, b.

    Each round takes the least label around every node, then the label of that label, so
    that long paths shorten by doubling, until none changes. Lineage is cut by checkpoint()
    each round."""
    lineage.ready(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).withColumnRenamed("a", "node").checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = labels.select(F.col("node").alias("l"), F.col("l").alias("j"))
        now = least.join(jump, "l").select("node", F.least("l", "j").alias("l"), "old").checkpoint()
        labels = now.select("node", "l")
        if now.where("l <> old").isEmpty():
            return labels.select("node", F.col("l").alias("component"))


def component_stats(nodes: DataFrame, area: str, x: str, y: str) -> DataFrame:
    """component, n, area, area-weighted centroid, box and the largest member. nodes: node, component, area, x, y."""
    a = F.col(area)
    return nodes.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("area"), (F.sum(a * F.col(x)) / F.sum(a)).alias("cx"), (F.sum(a * F.col(y)) / F.sum(a)).alias("cy"),
        F.min(x).alias("west"), F.max(x).alias("east"), F.min(y).alias("south"), F.max(y).alias("north"),
        F.min(F.struct((-a).alias("v"), F.col("node").alias("node")))["node"].alias("largest"),
    )


def merge_classes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Classes linked by edges merge into the one with most rows, ties to the lowest id. sizes: node, n."""
    c = connected_components(edges).join(sizes, "node")
    into = c.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("v"), "node"))["node"].alias("into"))
    return c.join(into, "component").select("node", "into")


def mixed_components(components: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Components whose nodes carry several labels. labels: node, label."""
    return components.join(labels, "node").groupBy("component").agg(F.countDistinct(label).alias("n")).where(F.col("n") > 1).select("component")


