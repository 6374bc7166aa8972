"""Mixing sources to target weights along a time-varying curriculum (operator 8).

DataFrame operations only. Time runs from 0 to 1. Source s has the rate
w_s * (1 + slope_s * (2t - 1)), whose integral over all of time is its weight w_s;
its cumulative demand by time t is target_s * (t + slope_s * (t * t - t)). A document
that starts c words into its source's shuffled order (which goes round again where
the target exceeds the source) is due when demand reaches c: the inverse of that
quadratic. A range sort by that position gives the training order.

Running sums do not need a source's rows together: (source, slot) cells are summed
first, slots being equal ranges of a hash, as many as the rows need, and the offsets of
cells join back. All this is done on narrow rows; the texts are joined to their positions
and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Weights by the rank of the source, repeating; share of all words to take; most passes over a source.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2
#: How the rates change over time, by the rank of the source: early, level, late.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows of all sources in one slot, about: what one task sums up at most.
SLOT_ROWS = 2_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds weight, slope and target.

    Sources in code point order, null last. The target is min(passes * size, level *
    weight) with one level for all, so that the targets sum to share * all sizes (if
    share <= passes): what is left when each excess is reshared by weight until none is
    above its bound. One row a source: the windows over all rows hold no documents."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("rank") % len(xs) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": pick(weights), "slope": pick(SLOPES), "cap": F.col("source_size").cast("double") * passes})
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size")).over(every).cast("double") * share
    # with sources in the order in which they fill up: the level if all before this one are full;
    # it rises up to the first source that does not fill up and falls from there on
    rest = F.col("all_weight") - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / rest
    at = ranked.withColumn("all_weight", F.sum("weight").over(every)).withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    at = at.withColumn("open_level", F.max(F.when(~full, F.col("level"))).over(every))
    return at.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("open_level") * F.col("weight"))).select("source", "source_size", "weight", "slope", "target")


def due(words: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's demand reaches so many words, from 0 to 1."""
    x = F.least(F.lit(1.0), F.when(target > 0, words / target).otherwise(F.lit(0.0)))
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * x))
    return F.when(slope == 0, x).otherwise(2 * x / ((1 - slope) + root))


#: What tells rows of the plan apart; none is null.
_KEY = ("_id", "_no_id", "_th", "_source", "_no_source")


def _keyed(docs: DataFrame) -> DataFrame:
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    doc = F.col("doc_id").cast("long")
    key = {"_id": F.coalesce(doc, F.lit(0)), "_no_id": doc.isNull(), "_th": F.xxhash64(text), "_source": F.coalesce(source, F.lit("")), "_no_source": source.isNull()}
    return docs.withColumns(key)


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """One row for all rows of docs that share _KEY (so alike), in no order: their _size, _start
    (words of the source before the first of them), and _total, _target and _slope of the
    source. Running sums are taken in slots of about SLOT_ROWS rows."""
    scratch = Scratch(docs.sparkSession, "mix")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    narrow = _keyed(docs.select("doc_id", "text", "source")).select(*_KEY, word_count(F.col("text").cast("string")).alias("_size"), order.alias("_h"))
    narrow = scratch.keep(narrow.groupBy(*_KEY).agg(F.first("_size").alias("_size"), F.first("_h").alias("_h"), F.count(F.lit(1)).alias("_n")))
    slots = max(1, -(-narrow.count() // SLOT_ROWS))
    rows = narrow.withColumn("_slot", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") * slots / (1 << 32)))  # rises with the hash
    words = F.col("_size") * F.col("_n")
    cells = rows.groupBy("_source", "_no_source", "_slot").agg(F.sum(words).alias("_cell"))
    sizes = cells.groupBy("_source", "_no_source").agg(F.sum("_cell").alias("source_size"))
    goal = targets(sizes.select(F.when(~F.col("_no_source"), F.col("_source")).alias("source"), "source_size"), weights, share, passes)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_no_source"), F.col("source_size").alias("_total"), F.col("target").alias("_target"), F.col("slope").alias("_slope"))
    before = Window.partitionBy("_source", "_no_source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0))).drop("_cell")  # one row a slot
    rows = rows.join(cells.join(goal, ["_source", "_no_source"]), ["_source", "_no_source", "_slot"])
    within = Window.partitionBy("_source", "_no_source", "_slot").orderBy("_h", F.when(~F.col("_no_id"), F.col("_id")).asc_nulls_first(), "_th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.col("_before") + F.coalesce(F.sum(words).over(within), F.lit(0)))
    return rows.select(*_KEY, "_size", "_start", "_total", "_target", "_slope")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """All rows of docs with size (words), source_size, target, taken (words the mix
    takes, repeats counted), repeats (passes that take words), position (0 to 1, when
    the first is due; null: never) and positions (when each of these passes is due), in
    the order of the first passes; rows never taken come last.

    docs needs doc_id, text and source; columns of docs that are called like the added ones
    are replaced. Null texts have 0 words; a null source is a source of its own. The order
    within a source is that of md5(doc_id, seed), doc_id and the text's hash: reruns agree, and
    rows that repeat count as often as they occur. The last document a source's target
    reaches is taken in part. Very long texts are moved once for the join and once for the
    order; an empty table gives an empty one."""
    added = ("size", "source_size", "target", "taken", "repeats", "position", "positions")
    rows = _keyed(docs.drop(*added)).join(plan(docs, weights, share, passes, seed).hint("merge"), list(_KEY))
    # rows that repeat follow each other in their source
    nth = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(0))) - 1
    rows = rows.withColumn("_start", F.col("_start") + F.col("_size") * nth)
    taken = [F.greatest(F.lit(0.0), F.least(F.col("_size").cast("double"), F.floor("_target") - (F.col("_start") + F.col("_total") * p))) for p in range(passes)]
    each = [F.when(t > 0, due((F.col("_start") + F.col("_total") * p).cast("double"), F.col("_target"), F.col("_slope"))) for p, t in enumerate(taken)]
    rows = rows.withColumns({"size": F.col("_size"), "source_size": F.col("_total"), "target": F.col("_target"), "taken": F.floor(sum(taken[1:], taken[0])).cast("long"), "positions": F.array_compact(F.array(*each))})
    rows = rows.withColumns({"repeats": F.size("positions"), "position": F.get("positions", F.lit(0))})
    return rows.select(*[c for c in docs.columns if c not in added], *added).orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: For DuckDB; the same arithmetic in the same order.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || '|mix') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size::DOUBLE * 2 AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
o AS (SELECT *, max(CASE WHEN NOT cap <= level * weight THEN level END) OVER () AS open_level FROM l),
t AS (SELECT source, source_size, CASE rnk % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, CASE WHEN cap <= level * weight THEN cap ELSE open_level * weight END AS target FROM o),
c AS (SELECT d.*, t.source_size, t.target, t.slope, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(greatest(0.0::DOUBLE, least(size::DOUBLE, floor(target) - start))
           + greatest(0.0::DOUBLE, least(size::DOUBLE, floor(target) - (start + source_size))))::BIGINT AS taken,
        least(1.0::DOUBLE, CASE WHEN target > 0 THEN start::DOUBLE / target ELSE 0.0::DOUBLE END) AS x FROM c)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN x
            ELSE 2 * x / ((1 - slope) + sqrt(greatest(0.0::DOUBLE, (1 - slope) * (1 - slope) + 4 * slope * x))) END END AS position
FROM k
"""
