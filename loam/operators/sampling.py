"""Splits, capped and diverse samples, admission by budget."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.hashing import bucket, md5_int


def split_roles(df: DataFrame, key: str, seed: str, shares: dict[str, int], n: int = 20, rest: str = "pool") -> DataFrame:
    """Adds role: by bucket of the hashed key, so that no key is in two roles."""
    b, role, at = bucket(key, n=n, seed=seed), None, 0
    for name, share in shares.items():
        cond = (b >= at) & (b < at + share)
        role = F.when(cond, name) if role is None else role.when(cond, name)
        at += share
    return df.withColumn("role", role.otherwise(rest))


def capped_diverse(df: DataFrame, cls: str, person: str, per_person: int, per_class: int, order: Iterable[Column], first: Iterable[Column] = ()) -> DataFrame:
    """At most per_class rows a class: first those within the cap of their person, then by `first`, then by `order`.

    Two windows; the second can drop rows early (rank limit), the first is bounded by a
    person's rows in a class."""
    own = Window.partitionBy(cls, person).orderBy(*order)
    all_ = Window.partitionBy(cls).orderBy((F.col("rk_person") > per_person), *first, *order)
    return df.withColumn("rk_person", F.row_number().over(own)).withColumn("rk", F.row_number().over(all_)).where(F.col("rk") <= per_class)


def with_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the number of rows of the same keys: summed and joined, since a window would hold a
    large group in one task. Null keys are a group."""
    n = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(n, same).drop(*[f"_k_{k}" for k in keys])


def capped_with_counts(df: DataFrame, cls: str, extra: str, order: Iterable[Column], k: int) -> DataFrame:
    """The first k rows of each (class, extra) beside how many there are."""
    w = Window.partitionBy(cls, extra)
    return with_count(df, [cls, extra], "n_all").withColumn("rk", F.row_number().over(w.orderBy(*order))).where(F.col("rk") <= k)


def admit_by_budget(df: DataFrame, group: str, size: Column, order: Iterable[Column], budget: float) -> DataFrame:
    """Keeps a row while its size and the sizes before it stay below the budget."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(size + F.col("before") < budget)


def capacity_fill(df: DataFrame, label: str, order: Iterable[Column], existing: DataFrame, cap: int) -> DataFrame:
    """Rows of each label up to the room that its existing count leaves. existing: label, n."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1
    return df.withColumn("rank", rank).join(existing.withColumnRenamed("n", "n_have"), label, "left").where(F.col("rank") < F.greatest(F.lit(0), cap - F.coalesce("n_have", F.lit(0))))


def stratified_fraction(df: DataFrame, cls: str, fraction: float, order: Iterable[Column]) -> DataFrame:
    """The first share of each class in the given order, at least one row."""
    w = Window.partitionBy(cls)
    return with_count(df, [cls], "n").withColumn("rk", F.row_number().over(w.orderBy(*order))).where(F.col("rk") <= F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)))


def class_targets(counts: DataFrame, kind: str, k: int = 0, power: float = 0.5) -> DataFrame:
    """Rows to draw by class (column n): uniform, cap, balanced, sqrt or pow."""
    n = F.col("n")
    total, powered = F.sum("n").over(Window.partitionBy()), F.pow(n, F.lit(power if kind == "pow" else 0.5))
    target = {"uniform": n, "cap": F.least(n, F.lit(k)), "balanced": F.lit(k)}.get(kind)
    if target is None:
        target = F.rint(total * powered / F.sum(powered).over(Window.partitionBy()))
    return counts.withColumn("target", target.cast("bigint"))


def draw(df: DataFrame, cls: str, targets: DataFrame, order: Iterable[Column]) -> DataFrame:
    """target rows of each class in the given order, going round again where a class has fewer."""
    w = Window.partitionBy(cls)
    ranked = with_count(df, [cls], "n").withColumn("rk", F.row_number().over(w.orderBy(*order)))
    rows = ranked.join(targets.select(cls, "target"), cls).where(F.col("rk") <= F.col("target"))
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("target") - F.col("rk")) / F.col("n")).cast("int")))).drop("n")


def round_robin(df: DataFrame, cls: str, person: str, order: str, per_person: int, per_class: int) -> DataFrame:
    """A turn for each class in rotation; each takes its next row whose person has rows left.

    Sequential by nature: the cap of a person spans classes. Of each person and class only the
    first per_person rows can ever be taken, so these alone go to one task; that task grows
    with the number of (class, person) pairs, so the operator is for samples of bounded size."""
    ranked = df.withColumn("_own", F.row_number().over(Window.partitionBy(cls, person).orderBy(order))).where(F.col("_own") <= per_person).drop("_own")
    schema = ranked.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {c: list(g.sort_values(order).index) for c, g in pdf.groupby(cls, sort=True)}
        used: dict = {}
        taken: dict = {c: 0 for c in queues}
        out = []
        while queues:
            for c in sorted(queues):
                q = queues[c]
                while q:
                    i = q.pop(0)
                    p = pdf.at[i, person]
                    if used.get(p, 0) < per_person:
                        used[p] = used.get(p, 0) + 1
                        taken[c] += 1
                        out.append(i)
                        break
                if not q or taken[c] >= per_class:
                    del queues[c]
        return pdf.loc[out]

    return ranked.groupBy(F.lit(0).alias("_g")).applyInPandas(run, schema)


def inverse_weights(sample: DataFrame, cls: str, natural: DataFrame) -> DataFrame:
    """Adds weight = rows of the class there are / rows sampled. natural: cls, n."""
    return with_count(sample, [cls], "n_sampled").join(natural, cls).withColumn("weight", F.col("n") / F.col("n_sampled"))


def quota_scale(histogram: list[tuple[int, int]], budget: int, floor: int = 1) -> float:
    """The factor f at which sum(clip(f * sqrt(n), floor, n)) over classes meets the budget.

    histogram: (class size n, number of classes of that size), bounded by distinct sizes."""
    low, high = 0.0, 1e9
    for _ in range(100):
        f = (low + high) / 2
        spent = sum(k * min(n, max(floor, int(f * n**0.5))) for n, k in histogram)
        low, high = (f, high) if spent <= budget else (low, f)
    return low


def global_rank(keys: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """Adds rank (from 0) and n over all rows of a table of distinct numeric keys, without bringing
    them into one task: approximate quantiles cut buckets, whose exact counts give each one's offset."""
    cuts = keys.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    cuts = F.array_distinct(F.lit(cuts or []).cast(f"array<{dict(keys.dtypes)[order]}>"))
    placed = keys.withColumn("_bucket", F.size(F.filter(cuts, lambda c: c <= F.col(order))))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # one row a bucket
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy())})
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return placed.withColumn("_rn", within).join(F.broadcast(counts), "_bucket").withColumn("rank", F.col("_before") + F.col("_rn") - 1).drop("_bucket", "_n", "_before", "_rn")


def even_spread(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows of n keys spread evenly over the order of a numeric key, and of the last key."""
    keys = global_rank(df.select(order).distinct(), order).withColumnsRenamed({"rank": "_rk", "n": "_n"})
    picked = keys.where((F.ceil(F.col("_rk") * n / F.col("_n")) * F.col("_n") < (F.col("_rk") + 1) * n) | (F.col("_rk") == F.col("_n") - 1))
    return df.join(picked.select(order), order, "left_semi")


def shuffled(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows by seeded hash."""
    return df.orderBy(md5_int(key, seed=seed), key).limit(n)
