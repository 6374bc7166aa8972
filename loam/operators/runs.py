"""Runs, deltas, streaks and circular islands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, group: str | list[str], index: str, level: str) -> DataFrame:
    """Run-length form: start, length and level of runs of equal level at consecutive indices."""
    keys = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*keys).orderBy(index)
    broken = (F.lag(index).over(w).isNull()) | (F.col(index) != F.lag(index).over(w) + 1) | ~F.col(level).eqNullSafe(F.lag(level).over(w))
    islands = df.withColumn("_run", F.sum(broken.cast("int")).over(w))
    return islands.groupBy(*keys, "_run", level).agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def unrun(df: DataFrame) -> DataFrame:
    """Cells of runs: the inverse."""
    return df.withColumn("index", F.explode(F.expr("sequence(start, start + length - 1)"))).drop("start", "length")


def deltas(df: DataFrame, group: str, order: Iterable[Column], value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(df: DataFrame, group: str, order: Iterable[Column], value: str = "value") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.sum("delta").over(w))


def streaks(df: DataFrame, group: str, order: Iterable[Column], hit: Column, limit: int) -> DataFrame:
    """Runs of consecutive rows that hit, of `limit` rows or more: group, streak (its number), n, first, last."""
    order = list(order)
    w = Window.partitionBy(group).orderBy(*order)
    numbered = df.withColumns({"_hit": hit, "_pos": F.row_number().over(w)}).withColumn("streak", F.sum((~F.col("_hit")).cast("int")).over(w))
    return numbered.where("_hit").groupBy(group, "streak").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first"), F.max("_pos").alias("last")).where(F.col("n") >= limit)


def month_runs(months: Column) -> Column:
    """Runs of months (1 to 12) as structs of from and to; a run at the end of the year joins one at its start."""
    m = F.array_sort(F.array_distinct(months))
    starts = F.filter(m, lambda x: ~F.array_contains(m, x - 1))
    plain = F.transform(starts, lambda s: F.struct(s.alias("from"), F.array_max(F.filter(m, lambda x: (x >= s) & (F.size(F.filter(m, lambda y: (y >= s) & (y <= x))) == x - s + 1))).alias("to")))
    wraps = (F.size(plain) > 1) & (F.element_at(plain, 1)["from"] == 1) & (F.element_at(plain, -1)["to"] == 12)
    joined = F.concat(F.slice(plain, 2, F.greatest(F.size(plain) - 2, F.lit(0))), F.array(F.struct(F.element_at(plain, -1)["from"].alias("from"), F.element_at(plain, 1)["to"].alias("to"))))
    return F.when(F.size(m) == 0, F.filter(plain, lambda x: F.lit(False))).when(wraps, joined).otherwise(plain)


def top_with_ties(df: DataFrame, group: str, keys: list[Column], k: int) -> DataFrame:
    """The first k by the keys, and all that tie with the last of them."""
    return df.withColumn("rk", F.rank().over(Window.partitionBy(group).orderBy(*keys))).where(F.col("rk") <= k)


def admitted_zoom(counts: DataFrame, group: str, zoom: str, n: str, cap: int) -> DataFrame:
    """The deepest zoom up to which the running count stays within the cap."""
    w = Window.partitionBy(group).orderBy(zoom).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum(n).over(w)).groupBy(group).agg(F.max(F.when(F.col("total") <= cap, F.col(zoom))).alias("deepest"))
