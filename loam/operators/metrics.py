"""Accuracy, calibration and parameter choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.hashing import md5_int


def accuracy(rows: DataFrame, hit: Column, cls: str, weight: Column | None = None) -> DataFrame:
    """natural: weighted share of hits; species: mean over classes of each class's share."""
    w = F.lit(1.0) if weight is None else weight
    by = rows.select(F.col(cls).alias("c"), hit.cast("double").alias("h"), w.alias("w")).groupBy("c").agg(F.avg("h").alias("a"), F.sum(F.col("h") * F.col("w")).alias("hw"), F.sum("w").alias("sw"))
    return by.agg((F.sum("hw") / F.sum("sw")).alias("natural"), F.avg("a").alias("species"))


def calibration_error(rows: DataFrame, confidence: Column, hit: Column, weight: Column | None = None, bins: int = 15) -> DataFrame:
    """ece: weighted mean over bins of the gap between confidence and share of hits."""
    w = F.lit(1.0) if weight is None else weight
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1))
    by = rows.groupBy(b.alias("bin")).agg(F.sum(w).alias("w"), F.sum(w * confidence).alias("c"), F.sum(w * hit.cast("double")).alias("h"))
    return by.agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("w")).alias("ece"))


def best_temperature(logits: DataFrame, grid: list[float], mixed: bool = False) -> DataFrame:
    """t, nll of the grid's best temperature. logits: id, cls, z, truth (boolean), and y with mixed:
    half of the loss then weighs all classes alike."""
    t = logits.withColumn("t", F.explode(F.lit([float(g) for g in grid]))).withColumn("z", F.col("z") / F.col("t"))
    w = Window.partitionBy("t", "id")
    t = t.withColumn("_m", F.max("z").over(w)).withColumn("lp", F.col("z") - F.col("_m") - F.ln(F.sum(F.exp(F.col("z") - F.col("_m"))).over(w))).where("truth")
    plain = F.avg(-F.col("lp"))
    if mixed:
        by = t.groupBy("t", "y").agg(F.avg(-F.col("lp")).alias("a"), F.sum(-F.col("lp")).alias("s"), F.count(F.lit(1)).alias("n"))
        loss = by.groupBy("t").agg((0.5 * F.avg("a") + 0.5 * F.sum("s") / F.sum("n")).alias("nll"))
    else:
        loss = t.groupBy("t").agg(plain.alias("nll"))
    return loss.groupBy().agg(F.min(F.struct("nll", "t")).alias("m")).select("m.t", "m.nll")


def hub_offsets(similar: DataFrame, k: int) -> DataFrame:
    """id, offset: mean of the k highest similarities to other classes. similar: id, s, other (boolean)."""
    top = similar.where("other").withColumn("_rk", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s")))).where(F.col("_rk") <= k)
    return top.groupBy("id").agg(F.avg("s").alias("offset"))


def paired_bootstrap(rows: DataFrame, key: str, a: Column, b: Column, n: int = 200, seed: str = "boot") -> DataFrame:
    """diff, low, high of mean(a) - mean(b) over n resamples: each row weighs as often as a
    Poisson(1) draw from its hashed key says, so that resamples need no shuffle of rows."""
    u = (md5_int(key, F.col("rep"), seed=seed) + 0.5) / float(1 << 32)
    weight = F.lit(0)
    edge, term = 0.0, 0.36787944117144233
    for k in range(8):
        edge += term
        weight = weight + (u >= edge).cast("int")
        term /= k + 1
    reps = rows.select(key, a.cast("double").alias("a"), b.cast("double").alias("b")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", weight)
    d = reps.groupBy("rep").agg((F.sum(F.col("w") * (F.col("a") - F.col("b"))) / F.sum("w")).alias("d"))
    return d.agg(F.avg("d").alias("diff"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def utility(rows: DataFrame, part: str, kind: str, right: Column) -> DataFrame:
    """Mean of +1 for a right species, +0.5 for a right genus, -1 for a wrong answer, 0 for none; and rates."""
    u = F.when(F.col(kind) == "unsure", 0.0).when(~right, -1.0).when(F.col(kind) == "species", 1.0).otherwise(0.5)
    rate = lambda c: F.avg(c.cast("int"))
    return rows.groupBy(part).agg(F.avg(u).alias("utility"), rate(F.col(kind) == "unsure").alias("unsure"), rate((F.col(kind) != "unsure") & ~right).alias("wrong"))


def target_mix(seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """bucket, weight: the share wanted over the share seen. Both: bucket, n."""
    share = lambda d, name: d.select("bucket", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    return share(seen, "s").join(share(wanted, "w"), "bucket").select("bucket", (F.col("w") / F.col("s")).alias("weight"))


def risk_capped(features: DataFrame, buckets: list[str], grid: list[float], cap: float, floors: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """Thresholds by bucket, raised step by step where the fewest right answers go for each wrong
    one removed, until at most `cap` of the stated answers are wrong. features: bucket, p, hit.

    The driver sees one count for each bucket and grid step."""
    step = F.lit(-1)
    for i, g in enumerate(grid):
        step = F.when(F.col("p") >= g, i).otherwise(step)
    counts = features.groupBy("bucket", step.alias("step")).agg(F.sum(F.col("hit").cast("int")).alias("right"), F.sum((~F.col("hit")).cast("int")).alias("wrong")).collect()
    table = {(r.bucket, r.step): (r.right, r.wrong) for r in counts}
    at = {b: next((i for i, g in enumerate(grid) if g >= (floors or {}).get(b, 0.0)), 0) for b in buckets}

    def stated() -> tuple[int, int]:
        cells = [table.get((b, i), (0, 0)) for b in buckets for i in range(at[b], len(grid))]
        return sum(c[0] for c in cells), sum(c[1] for c in cells)

    while True:
        right, wrong = stated()
        if not right + wrong or wrong / (right + wrong) <= cap:
            break
        moves = []
        for b in buckets:
            lost = [0, 0]
            for i in range(at[b], len(grid) - 1):
                r, w = table.get((b, i), (0, 0))
                lost = [lost[0] + r, lost[1] + w]
                if lost[1]:
                    moves.append((lost[1] / (lost[0] + 0.5), b, i + 1))
        if not moves:
            break
        _, b, i = max(moves, key=lambda m: (m[0], m[1], -m[2]))
        at[b] = i
    right, wrong = stated()
    return {b: grid[at[b]] for b in buckets}, wrong / max(1, right + wrong)


def coordinate_descent(score, start: dict[str, float], grid: dict[str, list[float]], rounds: int = 3) -> tuple[dict[str, float], float]:
    """Improves one parameter at a time until none changes. score: parameters to a number; each
    evaluation is one aggregate over the data."""
    best, top_ = dict(start), score(start)
    for _ in range(rounds):
        changed = False
        for name, values in grid.items():
            for v in values:
                if v != best[name] and (s := score(best | {name: v})) > top_:
                    best, top_, changed = best | {name: v}, s, True
        if not changed:
            break
    return best, top_


def species_key(y: Column, id_: Column) -> Column:
    """The class, or a class of its own for a row that cannot be answered."""
    return F.when(y >= 0, y).otherwise(-1 - id_)
