"""Connected components by randomised contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long). Gives node, root for every node of an edge.

    Each round joins every node to that neighbour (or itself) which comes first in
    a fresh pseudo-random order, then contracts the edges. A constant share of the
    nodes goes in each round whatever the shape of the graph, hubs cost a partial
    aggregate and a join that can be split, and each round is a written table.

    The tables grow with the graph, so that no join may broadcast them; the rounds' maps
    are put together from the last, which is the smallest."""
    spark = edges.sparkSession
    left, path = scratch.write(edges.select("a", "b").where("a <> b").distinct())
    maps = []
    while not left.isEmpty():
        seed = len(maps)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def rank(c: str, seed: int = seed) -> F.Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("r"), F.col(c).alias("v"))

        to = both.groupBy("a").agg(F.min(rank("b")).alias("n")).select(F.col("a").alias("node"), F.least(F.col("n"), rank("a"))["v"].alias("to"))
        maps.append(to := scratch.keep(to))
        x, y = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        old = path
        left, path = scratch.write(left.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(old)
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[-1].select("node", F.col("to").alias("root"))
    for m in reversed(maps[:-1]):
        out = m.join(out.select(F.col("node").alias("to"), "root").hint("merge"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out
