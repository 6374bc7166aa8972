"""Indicator species and count grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
#: Communities with fewer sites get a tally; fewest sites of a ranked species; longest list.
TALLY_BELOW, MIN_SITES, MAX_LIST = 30, 3, 40


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of the Wilson interval of k in n, not below 0."""
    p = k / n
    return F.greatest(F.lit(0.0), (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def indval(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """code, species, sites, rel, score of distinct (code, species, cell) pairs. sites: code, n (cells of a code)."""
    counts = pairs.select("code", "species", "cell").distinct().groupBy("code", "species").agg(F.count(F.lit(1)).alias("sites"))
    rel = counts.join(sites, "code").withColumn("rel", wilson(F.col("sites").cast("double"), F.col("n").cast("double")))
    share = F.col("rel") / F.greatest(F.sum("rel").over(Window.partitionBy("species")), F.lit(1e-12))
    return rel.withColumn("score", share * F.col("rel"))


def ranked_lists(scores: DataFrame, tally_below: int = TALLY_BELOW, least: int = MIN_SITES, k: int = MAX_LIST) -> DataFrame:
    """Lists by code: ranked by score, or for codes with few sites by number of sites with a null score."""
    tally = F.col("n") < tally_below
    rows = scores.where(tally | (F.col("sites") >= least))
    order = F.row_number().over(Window.partitionBy("code").orderBy(F.desc(F.when(tally, F.col("sites").cast("double")).otherwise(F.col("score"))), "species"))
    return rows.withColumn("rk", order).where(F.col("rk") <= k).select("code", "rk", "species", "sites", F.when(~tally, F.col("score")).alias("score"))


def member_counts(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Uncapped counts of the species that belong to groups, in order. members: species."""
    return scores.join(members.select("species").distinct(), "species", "left_semi").withColumn("rk", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("sites"), "species"))).select("code", "rk", "species", "sites")


def count_grid(points: DataFrame, cell: Column, most: int = 65535) -> DataFrame:
    """cell, species, n (capped), and pos within the cell: n down, then species."""
    n = points.select(cell.alias("cell"), "species").groupBy("cell", "species").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    return n.withColumn("pos", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("n"), "species")))


def merged_counts(tables: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """Weighted sum of count tables (keys, n), rounded, at least 1."""
    out = None
    for t, w in tables:
        part = t.select(*keys, (F.col("n") * w).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(F.greatest(F.rint(F.sum("n")), F.lit(1.0)).cast("bigint").alias("n"))
