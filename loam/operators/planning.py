"""Planning of tile pulls: sizes, remaining work, footprints, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped_children(areas: DataFrame, tiles: DataFrame, depth: int) -> DataFrame:
    """id and n: how many children, `depth` levels down, of stored tiles (x, y) lie in each area (id, x0, y0, x1, y1 of that level).

    Areas are keyed by the parent tiles that they touch, so that this is an equi-join."""
    d = 1 << depth
    up = lambda c: F.expr(f"{c} div {d}")
    a = areas.withColumn("x", F.explode(F.sequence(up("x0"), up("x1")))).withColumn("y", F.explode(F.sequence(up("y0"), up("y1"))))
    j = a.join(tiles.select("x", "y").distinct(), ["x", "y"])
    w = F.least(F.col("x1"), F.col("x") * d + d - 1) - F.greatest(F.col("x0"), F.col("x") * d) + 1
    h = F.least(F.col("y1"), F.col("y") * d + d - 1) - F.greatest(F.col("y0"), F.col("y") * d) + 1
    return j.groupBy("id").agg(F.sum(w * h).alias("n"))


def size_estimates(counts: DataFrame, bytes_by_zoom: DataFrame) -> DataFrame:
    """id, tiles, bytes and the running bytes by zoom. counts: id, z, n; bytes_by_zoom: z, mean."""
    w = Window.partitionBy("id").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    est = counts.join(bytes_by_zoom, "z", "left").withColumn("bytes", F.col("n") * F.coalesce("mean", F.lit(0.0)))
    return est.withColumn("running", F.sum("bytes").over(w))


def calibration(samples: DataFrame) -> DataFrame:
    """z, mean, low and high: mean bytes a tile and its range over samples. samples: z, tiles, bytes."""
    per = F.col("bytes") / F.col("tiles")
    return samples.where("tiles > 0").groupBy("z").agg((F.sum("bytes") / F.sum("tiles")).alias("mean"), F.min(per).alias("low"), F.max(per).alias("high"))


def remaining(planned: DataFrame, stored: DataFrame, absent: DataFrame) -> DataFrame:
    """z, planned, left: tiles of a plan (z, x, y) that are neither stored nor known to be absent."""
    keys = ["z", "x", "y"]
    done = stored.select(*keys).unionByName(absent.select(*keys)).distinct().withColumn("_d", F.lit(1))
    return planned.join(done, keys, "left").groupBy("z").agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("_d").isNull()).alias("left"))


def footprint_check(projects: DataFrame, stored: DataFrame, blank: DataFrame) -> DataFrame:
    """Three-way count of projects by the tile of their vertices' mean: stored, blank or missing. projects: project, x, y (tile units)."""
    centre = projects.groupBy("project").agg(F.floor(F.avg("x")).cast("bigint").alias("x"), F.floor(F.avg("y")).cast("bigint").alias("y"))
    j = centre.join(stored.select("x", "y", F.lit(True).alias("_s")).distinct(), ["x", "y"], "left").join(blank.select("x", "y", F.lit(True).alias("_b")).distinct(), ["x", "y"], "left")
    return j.groupBy(F.when(F.col("_s"), "stored").when(F.col("_b"), "blank").otherwise("missing").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def chain(records: DataFrame, limit: int = 40) -> DataFrame:
    """start, at, step of blob chains: each record (at, next) names the place of the next one; starts
    are records that none names. By doubling: after k rounds a row knows the record 2**k on."""
    starts = records.select("at").join(records.select(F.col("next").alias("at")), "at", "left_anti").withColumnRenamed("at", "start")
    out = starts.select("start", F.col("start").alias("at"), F.lit(0).cast("long").alias("step"))
    jump = records.where("next is not null").select("at", F.col("next").alias("to"))
    for k in range(limit):
        far = out.join(jump, "at").select("start", F.col("to").alias("at"), (F.col("step") + (1 << k)).alias("step"))
        out = out.unionByName(far).checkpoint()
        jump = jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("_to")), "to").select("at", F.col("_to").alias("to")).checkpoint()
        if jump.isEmpty():
            break
    return out.join(records.select("at"), "at", "left_semi")


def smoothed(grid: DataFrame, sigma: float) -> DataFrame:
    """row, col, v: Gaussian-weighted sum of a grid (row, col, n), cut at 3 sigma (in cells)."""
    import math

    reach = math.ceil(3 * sigma)
    weights = [(r, c, math.exp(-(r * r + c * c) / (2 * sigma * sigma))) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if r * r + c * c <= 9 * sigma * sigma]
    total = sum(w for *_, w in weights)
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w / total).alias("w")) for r, c, w in weights]))
    g = grid.withColumn("k", near)
    return g.groupBy((F.col("row") + F.col("k.r")).alias("row"), (F.col("col") + F.col("k.c")).alias("col")).agg(F.sum(F.col("n") * F.col("k.w")).alias("v"))


def balloon_code(v: Column, base: float, codes: int) -> Column:
    """Code of a cell's kernel width: each halving of the smoothed count widens by one, 0 for the densest."""
    return F.greatest(F.lit(0), F.least(F.lit(codes - 1), F.rint(F.log2(F.lit(base) / F.greatest(v, F.lit(1e-9)))).cast("int")))


def grid_counts(points: DataFrame, lat0: float, lon0: float, step: float, accuracy: float) -> DataFrame:
    """row, col, cls, n of points (lat, lon, cls, accuracy); an unknown accuracy counts as good."""
    ok = F.col("accuracy").isNull() | (F.col("accuracy") <= accuracy)
    return points.where(ok).groupBy(F.floor((F.col("lat") - lat0) / step).alias("row"), F.floor((F.col("lon") - lon0) / step).alias("col"), "cls").agg(F.count(F.lit(1)).alias("n"))


def csr_cells(grid: DataFrame) -> DataFrame:
    """Sparse rows as arrays: row, cols, values, in order of col; and back with csr_decoded."""
    return grid.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "cls", "n"))).alias("a")).select("row", F.transform("a", lambda x: x.col).alias("cols"), F.transform("a", lambda x: x.cls).alias("classes"), F.transform("a", lambda x: x.n).alias("values"))


def csr_decoded(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("cols", "classes", "values")).alias("e")).select("row", F.col("e.cols").alias("col"), F.col("e.classes").alias("cls"), F.col("e.values").alias("n"))


def usage_costs(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """kind, requests, units, cost. requests: kind, units; prices: kind, price a unit."""
    return requests.groupBy("kind").agg(F.count(F.lit(1)).alias("requests"), F.sum("units").alias("units")).join(prices, "kind", "left").select("kind", "requests", "units", (F.col("units") * F.coalesce("price", F.lit(0.0))).alias("cost"))
