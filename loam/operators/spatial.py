"""Spatial joins over grid cells: an equi-join on cells first, the exact test after.

A radius or polygon join written as a condition plans as a nested loop; here each side is
keyed by cells (one for a point, those it covers for a shape), so that both sides shuffle
on the key, or the small one is broadcast by the planner if its size allows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import geo


def neighbours(df: DataFrame, row: str, col: str, reach: int) -> DataFrame:
    """Each row once for each cell of the window around it (dr, dc, n_row, n_col)."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).withColumns({"n_row": F.col(row) + F.col("dr"), "n_col": F.col(col) + F.col("dc")})


def sums_around(points: DataFrame, grid: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """For each point (id, row, col) and key of the grid (row, col, key, value): the sum over the window."""
    near = neighbours(points, "row", "col", reach).select("id", F.col("n_row").alias("row"), F.col("n_col").alias("col"))
    return near.join(grid, ["row", "col"]).groupBy("id", "key").agg(F.sum(value).alias(value))


def kernel_sums(points: DataFrame, grid: DataFrame, sigma: float, step: float) -> DataFrame:
    """Gaussian-weighted counts by point and key: cells whose centre lies within 3 sigma.

    points: id, x, y (row and col are found here); grid: row, col, key, n; cells of `step`."""
    reach = math.ceil(3 * sigma / step)
    placed = points.withColumns({"row": geo.cell(F.col("y"), 0.0, step), "col": geo.cell(F.col("x"), 0.0, step)})
    near = neighbours(placed, "row", "col", reach)
    dx, dy = (F.col("n_col") + 0.5) * step - F.col("x"), (F.col("n_row") + 0.5) * step - F.col("y")
    d2 = dx * dx + dy * dy
    near = near.withColumn("w", F.exp(-d2 / (2 * sigma * sigma))).where(d2 <= 9 * sigma * sigma)
    return near.select("id", F.col("n_row").alias("row"), F.col("n_col").alias("col"), "w").join(grid, ["row", "col"]).groupBy("id", "key").agg(F.sum(F.col("w") * F.col("n")).alias("k"))


def near_places(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """lat, lon, rlat, rlon, km of the distinct positions of left and right within a distance.

    Cells are km / 100 degrees high; across, the window widens with the latitude, up to 80 degrees."""
    step = km / 100.0
    a = left.select("lat", "lon").distinct().withColumns({"_r": geo.cell(F.col("lat"), 0.0, step), "_c": geo.cell(F.col("lon"), 0.0, step)})
    reach = F.ceil(F.lit(1.0) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + step, F.lit(80.0)))), F.lit(0.17))).cast("int") + 1
    a = a.withColumn("_r", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.col("_r") + d))).withColumn("_c", F.explode(F.transform(F.sequence(-reach, reach), lambda d: F.col("_c") + d)))
    b = right.select("rlat", "rlon").distinct().withColumns({"_r": geo.cell(F.col("rlat"), 0.0, step), "_c": geo.cell(F.col("rlon"), 0.0, step)})
    d = geo.km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    return a.join(b, ["_r", "_c"]).withColumn("km", d).where(F.col("km") <= km).drop("_r", "_c")


def at_places(left: DataFrame, right: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of the rows at positions that near has, with its km."""
    return left.join(near, ["lat", "lon"]).join(right, ["rlat", "rlon"]).select(*left.columns, *right.columns, "km")


def radius_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of left (id, lat, lon) and right (rid, rlat, rlon) within a distance: distances are
    those of distinct positions, and the rows that share one are joined to them after."""
    return at_places(left, right, near_places(left, right, km))


def none_within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    return left.join(radius_join(left.select("id", "lat", "lon"), right, km).select("id").distinct(), "id", "left_anti")


def edges_of(polygons: DataFrame) -> DataFrame:
    """poly, x1, y1, x2, y2 of polygons (poly, rings: array of arrays of struct x, y; rings closed)."""
    ring = polygons.select("poly", F.explode("rings").alias("ring"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b")))
    return ring.where(F.size("ring") > 1).select("poly", F.explode(pairs).alias("e")).select("poly", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, step: float) -> DataFrame:
    """id and the lowest poly whose interior (even-odd) or edge holds the point. points: id, x, y.

    Polygons cover cells of their boxes; candidates are tested by ray casting inside each row,
    over the rings, so that edges do not multiply in the join. Of polygons with the same rings the
    lowest is taken, and points with the same place are tested once."""
    polygons = polygons.groupBy("rings").agg(F.min("poly").alias("poly"))
    places = points.select("x", "y").distinct()
    xs, ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p.x))), F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p.y)))
    boxed = polygons.withColumns({"_w": F.array_min(xs), "_e": F.array_max(xs), "_s": F.array_min(ys), "_n": F.array_max(ys)})
    cells = boxed.withColumn("_c", F.explode(F.sequence(geo.cell(F.col("_w"), 0.0, step), geo.cell(F.col("_e"), 0.0, step)))).withColumn("_r", F.explode(F.sequence(geo.cell(F.col("_s"), 0.0, step), geo.cell(F.col("_n"), 0.0, step))))
    placed = places.withColumns({"_c": geo.cell(F.col("x"), 0.0, step), "_r": geo.cell(F.col("y"), 0.0, step)})
    pairs = placed.join(cells, ["_c", "_r"]).where((F.col("x") >= F.col("_w")) & (F.col("x") <= F.col("_e")) & (F.col("y") >= F.col("_s")) & (F.col("y") <= F.col("_n")))
    x, y = F.col("x"), F.col("y")

    def segments(ring: Column) -> Column:
        return F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))

    edges = F.flatten(F.transform("rings", segments))

    def crosses(e: Column) -> Column:
        up = (e.a.y > y) != (e.b.y > y)
        return F.when(up, (x < (e.b.x - e.a.x) * (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) + e.a.x).cast("int")).otherwise(0)

    def touches(e: Column) -> Column:
        turn = (e.b.x - e.a.x) * (y - e.a.y) - (e.b.y - e.a.y) * (x - e.a.x)
        return (turn == 0) & x.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & y.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))

    tested = pairs.withColumn("_edges", edges)
    hit = (F.aggregate("_edges", F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1) | F.exists("_edges", touches)
    found = tested.where(hit).groupBy("x", "y").agg(F.min("poly").alias("poly"))
    return points.select("id", "x", "y").join(found, ["x", "y"]).groupBy("id").agg(F.min("poly").alias("poly"))


def boxes_touching(boxes: DataFrame, step: float, pad: float = 0.0) -> DataFrame:
    """Pairs a < b of boxes (id, west, south, east, north) of one class (cls) that touch, padded."""
    p = boxes.withColumns({"_c": F.sequence(geo.cell(F.col("west") - pad, 0.0, step), geo.cell(F.col("east") + pad, 0.0, step)), "_r": F.sequence(geo.cell(F.col("south") - pad, 0.0, step), geo.cell(F.col("north") + pad, 0.0, step))})
    p = p.withColumn("_c", F.explode("_c")).withColumn("_r", F.explode("_r"))
    l, r = p.alias("l"), p.alias("r")
    touch = (F.col("l.west") - pad <= F.col("r.east") + pad) & (F.col("r.west") - pad <= F.col("l.east") + pad) & (F.col("l.south") - pad <= F.col("r.north") + pad) & (F.col("r.south") - pad <= F.col("l.north") + pad)
    # a pair shares several cells; it counts in the one where their overlap begins
    first = (F.col("l._c") == F.greatest(geo.cell(F.col("l.west") - pad, 0.0, step), geo.cell(F.col("r.west") - pad, 0.0, step))) & (F.col("l._r") == F.greatest(geo.cell(F.col("l.south") - pad, 0.0, step), geo.cell(F.col("r.south") - pad, 0.0, step)))
    same = (F.col("l._c") == F.col("r._c")) & (F.col("l._r") == F.col("r._r")) & (F.col("l.cls") == F.col("r.cls"))
    return l.join(r, same & (F.col("l.id") < F.col("r.id"))).where(touch & first).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def name_variants(names: DataFrame, pad: float, least: float, step: float) -> DataFrame:
    """For each row (id, name, x, y) the most similar other name nearby, at least so similar."""
    from loam.functions.text import similarity

    a = names.withColumns({"_c": geo.cell(F.col("x"), 0.0, step), "_r": geo.cell(F.col("y"), 0.0, step)})
    near = neighbours(a, "_r", "_c", max(1, math.ceil(pad / step))).select("id", "name", "x", "y", F.col("n_row").alias("_r"), F.col("n_col").alias("_c"))
    b = a.select(F.col("id").alias("oid"), F.col("name").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "_r", "_c")
    pairs = near.join(b, ["_r", "_c"]).where((F.col("id") != F.col("oid")) & (F.col("name") != F.col("other")) & (F.abs(F.col("x") - F.col("ox")) <= pad) & (F.abs(F.col("y") - F.col("oy")) <= pad))
    pairs = pairs.where(F.levenshtein("name", "other") <= F.greatest(F.length("name"), F.length("other")) * 2 * (1 - least))
    return pairs.withColumn("s", similarity("name", "other")).where(F.col("s") >= least).groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("v"), "other")).alias("m")).select("id", F.col("m.other").alias("other"), (-F.col("m.v")).alias("similarity"))


def core_box(cells: DataFrame, share: float = 0.9) -> DataFrame:
    """By code: the smallest box of grid cells (row, col, weight) that holds a share of the weight.

    One code's grid goes to one task; its size is bounded by the grid, not by the data."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        h, w = int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1
        sums = np.zeros((h + 1, w + 1))
        np.add.at(sums, (pdf["row"].to_numpy() - r0 + 1, pdf["col"].to_numpy() - c0 + 1), pdf["weight"].to_numpy())
        sums = sums.cumsum(0).cumsum(1)
        need, best = share * sums[-1, -1] - 1e-9, None
        for top in range(h):
            for bottom in range(top + 1, h + 1):
                line = sums[bottom] - sums[top]
                if line[-1] < need:
                    continue
                right = np.searchsorted(line, line + need - 1e-12)  # least right edge for each left one
                ok = right <= w
                if ok.any():
                    left = np.flatnonzero(ok)
                    area = (bottom - top) * (right[ok] - left)
                    k = int(area.argmin())
                    found = (int(area[k]), top, int(left[k]), bottom - 1, int(right[ok][k]) - 1)
                    best = found if best is None else min(best, found)
        _, a, b, c, d = best
        return pd.DataFrame({"code": [pdf["code"].iloc[0]], "row0": [a + r0], "col0": [b + c0], "row1": [c + r0], "col1": [d + c0]})

    return cells.groupBy("code").applyInPandas(run, "code string, row0 long, col0 long, row1 long, col1 long")


def outline_edges(cells: DataFrame) -> DataFrame:
    """Unit edges between a cell (code, row, col) and no cell of its code, directed with the inside on the left."""
    side = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1"), F.lit(x2).alias("x2"), F.lit(y2).alias("y2")) for dr, dc, x1, y1, x2, y2 in ((-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0))]))
    e = cells.select("code", "row", "col", side.alias("s")).withColumns({"nr": F.col("row") + F.col("s.dr"), "nc": F.col("col") + F.col("s.dc")})
    other = cells.select("code", F.col("row").alias("nr"), F.col("col").alias("nc"))
    at = lambda a, b: F.col(a) + F.col(f"s.{b}")
    return e.join(other, ["code", "nr", "nc"], "left_anti").select("code", at("col", "x1").alias("x1"), at("row", "y1").alias("y1"), at("col", "x2").alias("x2"), at("row", "y2").alias("y2"))


def dissolve(cells: DataFrame) -> DataFrame:
    """Closed rings around each code's cells: code, ring, points (array of struct x, y, corners only)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for x1, y1, x2, y2 in pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False):
            after.setdefault((x1, y1), []).append((x2, y2))
        rings = []
        while after:
            start = min(after)
            ring, at, came = [start], start, None
            while True:
                nexts = after[at]
                # where two outlines meet in a point, turn towards the inside
                k = 0
                if len(nexts) > 1 and came is not None:
                    dx, dy = at[0] - came[0], at[1] - came[1]
                    k = min(range(len(nexts)), key=lambda i: -(dx * (nexts[i][1] - at[1]) - dy * (nexts[i][0] - at[0])))
                to = nexts.pop(k)
                if not nexts:
                    del after[at]
                came, at = at, to
                if at == start:
                    break
                ring.append(at)
            corners = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
            rings.append([*corners, corners[0]])
        return pd.DataFrame({"code": pdf["code"].iloc[0], "ring": range(len(rings)), "points": [[{"x": int(x), "y": int(y)} for x, y in r] for r in rings]})

    return outline_edges(cells).groupBy("code").applyInPandas(run, "code string, ring int, points array<struct<x: long, y: long>>")


def season(df: DataFrame, key: str, order: str, has_tile: Column) -> DataFrame:
    """By key, the newest row that has a tile."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.where(has_tile).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
