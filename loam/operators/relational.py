"""Relational patterns: incremental scans, overrides, votes, drops, checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage


def incremental(done: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """done and those rows of seen whose key is new."""
    return done.unionByName(seen.join(done.select(key).distinct(), key, "left_anti"))


def drop_reasons(df: DataFrame, rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first rule a row breaks, or null. A rule that is null counts as kept."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(list(rules)):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason)


def override(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join; the override's value wins where it has one."""
    o = over.select(key, F.col(value).alias("_over"))
    return base.select(key, F.col(value).alias("_base")).join(o, key, "full").select(key, F.coalesce("_over", "_base").alias(value))


def most_specific(df: DataFrame, key: str, value: str, level: str) -> DataFrame:
    """The value of the highest level by key; ties to the greatest value."""
    return df.groupBy(key).agg(F.max(F.struct(level, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def contains_path(df: DataFrame, path: str, ids: DataFrame, key: str, sep: str = "/") -> DataFrame:
    """Rows whose path holds one of the ids: the path exploded, then an equi-join."""
    exploded = df.withColumn("_step", F.explode(F.split(path, sep)))
    return exploded.join(ids.select(F.col(key).cast("string").alias("_step")).distinct(), "_step", "left_semi").drop("_step").distinct()


def subtree_counts(nodes: DataFrame, path: str, n: str, sep: str = "/") -> DataFrame:
    """Sum of n over each node of a path and all below it."""
    return nodes.select(F.explode(F.split(path, sep)).alias("node"), n).groupBy("node").agg(F.sum(n).alias("total"))


def majority(df: DataFrame, key: str, vote: str) -> DataFrame:
    """The most frequent vote by key, ties to the smallest; null votes do not count."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("v"), vote)).alias("m")).select(key, F.col(f"m.{vote}").alias(vote), (-F.col("m.v")).alias("votes"))


def boxes(df: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    return df.groupBy(key).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def drop_generic(df: DataFrame, name: str, place: str, least: int) -> DataFrame:
    """Leaves out names that stand in `least` places or more."""
    generic = df.groupBy(name).agg(F.countDistinct(place).alias("n")).where(F.col("n") >= least).select(name)
    return df.join(generic, name, "left_anti")


def top_and_other(df: DataFrame, key: str, n: str, k: int, other: str = "other") -> DataFrame:
    """The k largest keys and one row for the rest. df: one row a key."""
    rank = F.row_number().over(Window.orderBy(F.desc(n), key))
    return df.withColumn("rk", rank).groupBy(F.when(F.col("rk") <= k, F.col(key)).otherwise(other).alias(key)).agg(F.sum(n).alias(n))


def keep_first(df: DataFrame, key: str | list[str], order: Iterable[Column]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def multi_label(df: DataFrame, item: str, label: str, provider: str, share: float) -> DataFrame:
    """Drops items under several labels everywhere, and providers of whose items more than a share are such."""
    several = df.groupBy(item).agg((F.countDistinct(label) > 1).alias("several"))
    marked = df.join(several, item)
    bad = marked.select(provider, item, "several").distinct().groupBy(provider).agg(F.avg(F.col("several").cast("int")).alias("s")).where(F.col("s") > share).select(provider)
    return marked.where(~F.col("several")).join(bad, provider, "left_anti").drop("several")


def unique_synonyms(pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """synonym to target where there is exactly one, the synonym itself is not accepted, and the target is.
    pairs: synonym, target; accepted: name."""
    one = pairs.groupBy("synonym").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    return one.join(accepted.select(F.col("name").alias("synonym")), "synonym", "left_anti").join(accepted.select(F.col("name").alias("target")), "target", "left_semi").select("synonym", "target")


def claims(df: DataFrame, label: str, target: str, same: Column) -> DataFrame:
    """Labels that keep their target: the only one that claims it, or the only one of them that matches by name."""
    w = Window.partitionBy(target)
    counted = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_same": same.cast("int")}).withColumn("_m", F.sum("_same").over(w))
    return counted.where((F.col("_n") == 1) | ((F.col("_same") == 1) & (F.col("_m") == 1))).drop("_n", "_same", "_m")


def fallback(df: DataFrame, lookups: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Adds value and source from the first lookup that has one. lookups: name, table, key."""
    out = df
    for name, table_, key in lookups:
        out = out.join(table_.select(F.col(key), F.col(value).alias(f"_{name}")), key, "left")
    tag = F.lit(None).cast("string")
    for name, _, _ in reversed(lookups):
        tag = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(tag)
    drop = [f"_{name}" for name, _, _ in lookups]
    return out.withColumn(value, F.coalesce(*drop)).withColumn("source", tag).drop(*drop)


def conflict_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """Of several names for one key, the equal one, else the first by alphabet."""
    return keep_first(df, key, [F.col(name) != F.col(key), F.col(name)])


def relabelled_counts(counts: DataFrame, moves: DataFrame, label: str) -> DataFrame:
    """n less what moved out plus what moved in. counts: label, n; moves: old, new."""
    out = moves.groupBy(F.col("old").alias(label)).agg(F.count(F.lit(1)).alias("_out"))
    in_ = moves.groupBy(F.col("new").alias(label)).agg(F.count(F.lit(1)).alias("_in"))
    zero = F.lit(0)
    return counts.join(out, label, "left").join(in_, label, "left").select(label, (F.col("n") - F.coalesce("_out", zero) + F.coalesce("_in", zero)).alias("n"))


def first_seen_units(df: DataFrame, key: str, order: str, link: str) -> DataFrame:
    """Attributes of the first row of a key; a link that it lacks comes from the first row that has one."""
    has = F.when(F.coalesce(F.col(link), F.lit("")) != "", F.struct(order, link))
    others = [c for c in df.columns if c not in (key, link)]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("f"), F.min(has)[link].alias(link)).select(key, *[F.col(f"f.{c}").alias(c) for c in others], link)


def follow_swaps(swaps: DataFrame) -> DataFrame:
    """old to the last name that its chain of swaps leads to, by pointer jumping. The chains
    double with each jump, so that after log2 of the rows only names that lead into a cycle
    still move; these get the smallest name of what they reach by then."""
    lineage.ready(swaps.sparkSession)
    now = swaps.select("old", "new").distinct().checkpoint()
    for _ in range(max(1, now.count()).bit_length() + 1):
        step = now.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        moved = now.join(step, "new", "left").select("old", F.coalesce("_next", "new").alias("new")).checkpoint()
        if moved.exceptAll(now).isEmpty():
            return moved
        now = moved
    return now


def minimum_widths(df: DataFrame, width: Column, least: float) -> DataFrame:
    """Widths raised to a floor; the widest pays. One row a segment of one bar."""
    w = Window.partitionBy()
    floor = df.withColumn("_w", width).withColumn("_debt", F.greatest(F.lit(0.0), least - F.col("_w")))
    widest = F.row_number().over(Window.orderBy(F.desc("_w")))
    return floor.withColumns({"_total": F.sum("_debt").over(w), "_rk": widest}).withColumn("width", F.when(F.col("_rk") == 1, F.col("_w") - F.col("_total")).otherwise(F.greatest(F.col("_w"), F.lit(least)))).drop("_w", "_debt", "_total", "_rk")


def imputed_total(df: DataFrame, size: str) -> DataFrame:
    """Total size with unknown sizes at the rounded mean of the known ones."""
    a = df.agg(F.sum(size).alias("known"), F.avg(size).alias("mean"), F.count_if(F.col(size).isNull()).alias("unknown"))
    return a.select((F.coalesce("known", F.lit(0)) + F.col("unknown") * F.round(F.coalesce("mean", F.lit(0)))).cast("bigint").alias("total"))


def work_partition(todo: DataFrame, present: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """present, gone or left, for each row of a work list."""
    p, g = present.select(key, F.lit(True).alias("_p")).distinct(), gone.select(key, F.lit(True).alias("_g")).distinct()
    return todo.join(p, key, "left").join(g, key, "left").withColumn("state", F.when(F.col("_p"), "present").when(F.col("_g"), "gone").otherwise("left")).drop("_p", "_g")


def strikes(runs: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys that failed in `limit` runs or more. runs: key, failed."""
    return runs.groupBy(key).agg(F.count_if("failed").alias("strikes")).where(F.col("strikes") >= limit)
