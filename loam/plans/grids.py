"""Grid, indicator, raster and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import geo
from loam.operators import indicator as ind
from loam.operators import raster as ras
from loam.operators import runs as run
from loam.operators import spatial as sp

from .registry import Tables, query

_PAIRS = "pairs AS (SELECT DISTINCT n_name AS code, p_name AS species, o_custkey AS cell FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_INDVAL = f"""WITH {_PAIRS}, c AS (SELECT code, species, count(*) AS sites FROM pairs GROUP BY ALL), s AS (SELECT code, count(DISTINCT cell) AS n FROM pairs GROUP BY 1),
r AS (SELECT c.*, s.n, greatest(0.0::DOUBLE, (p + 3.8416 / (2 * nn) - 1.96::DOUBLE * sqrt(p * (1 - p) / nn + 3.8416::DOUBLE / (4 * nn * nn))) / (1 + 3.8416::DOUBLE / nn)) AS rel
  FROM (SELECT c.*, s.n::DOUBLE AS nn, sites / s.n::DOUBLE AS p FROM c JOIN s ON c.code = s.code) c JOIN s ON c.code = s.code),
v AS (SELECT *, rel / greatest(sum(rel) OVER (PARTITION BY species), 1e-12) * rel AS score FROM r)"""


def _pairs(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("n_name").alias("code"), F.col("p_name").alias("species"), F.col("o_custkey").alias("cell")).distinct()


def _scores(t: Tables):
    p = _pairs(t)
    return ind.indval(p, p.groupBy("code").agg(F.countDistinct("cell").alias("n")))


@query(_INDVAL + " SELECT code, species, sites, round(rel, 6) AS rel, round(score, 6) AS score FROM v")
def indval(t: Tables):
    return _scores(t).select("code", "species", "sites", F.round("rel", 6).alias("rel"), F.round("score", 6).alias("score"))


@query(_INDVAL + """, l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN n < 30 THEN sites ELSE round(score, 9) END DESC, species) AS rk FROM v WHERE n < 30 OR sites >= 3)
SELECT code, rk::INTEGER AS rk, species, sites, CASE WHEN n >= 30 THEN round(score, 6) END AS score FROM l WHERE rk <= 40""")
def indicator_lists(t: Tables):
    scored = _scores(t).withColumn("score", F.round("score", 9))
    return ind.ranked_lists(scored).withColumn("score", F.round("score", 6))


_GRID = "g AS (SELECT floor((embedding[1] + 1) / 0.05)::BIGINT AS col, floor((embedding[2] + 1) / 0.05)::BIGINT AS row, label AS key, count(*) AS n FROM embeddings GROUP BY ALL)"


def _grid(t: Tables):
    e = F.col("embedding")
    return t.embeddings.groupBy(F.floor((e[0] + 1) / 0.05).alias("col"), F.floor((e[1] + 1) / 0.05).alias("row"), F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GRID}, p AS (SELECT DISTINCT row, col FROM g) SELECT p.row * 1000 + p.col AS id, key, sum(n)::BIGINT AS n FROM p JOIN g ON abs(p.row - g.row) <= 1 AND abs(p.col - g.col) <= 1 GROUP BY ALL")
def sites_around(t: Tables):
    g = _grid(t)
    points = g.select("row", "col").distinct().withColumn("id", F.col("row") * 1000 + F.col("col"))
    return sp.sums_around(points, g, "n")


@query(f"""WITH {_GRID}, c AS (SELECT row * 1000 + col AS cell, key AS species, least(n, 65535) AS n FROM g)
SELECT cell, species, n, row_number() OVER (PARTITION BY cell ORDER BY n DESC, species)::INTEGER AS pos FROM c""")
def nearby_grid(t: Tables):
    e = F.col("embedding")
    points = t.embeddings.select(F.floor((e[0] + 1) / 0.05).alias("col"), F.floor((e[1] + 1) / 0.05).alias("row"), F.col("label").alias("species"))
    return ind.count_grid(points, F.col("row") * 1000 + F.col("col"))


@query("""SELECT o_orderkey, abs(60 * k - 1000 * round_even(60 * k / 1000.0, 0)) <= 30 AS minute, k % 100 = 0 AS deci, CAST(floor((k + 44000 + 5) / 10) AS BIGINT) AS cell
FROM (SELECT o_orderkey, o_orderkey * 37 % 5000 AS k FROM orders)""")
def arc_minute_filter(t: Tables):
    k = F.col("o_orderkey") * 37 % 5000
    return t.orders.select("o_orderkey", geo.arc_minute(k).alias("minute"), (k % 100 == 0).alias("deci"), geo.half_up_cell(k, 44000).alias("cell"))


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
g AS (SELECT floor(embedding[2]::DOUBLE / 0.05)::BIGINT AS row, floor(embedding[1]::DOUBLE / 0.05)::BIGINT AS col, label AS key, count(*) AS n FROM embeddings GROUP BY ALL),
j AS (SELECT id, key, n, (x - (col + 0.5) * 0.05) ** 2 + (y - (row + 0.5) * 0.05) ** 2 AS d2 FROM p CROSS JOIN g)
SELECT id, key, round(sum(n * exp(-d2 / (2 * 0.06 * 0.06))), 6) AS k FROM j WHERE d2 <= 9 * 0.06 * 0.06 GROUP BY ALL""")
def kernel_prior(t: Tables):
    e = F.col("embedding")
    x, y = e[0].cast("double"), e[1].cast("double")
    points = t.embeddings.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y"))
    grid = t.embeddings.groupBy(geo.cell(y, 0.0, 0.05).alias("row"), geo.cell(x, 0.0, 0.05).alias("col"), F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sp.kernel_sums(points, grid, 0.06, 0.05).withColumn("k", F.round("k", 6))


_AT = "(c_custkey * 7919 % 4000) / 1000.0::DOUBLE - 44 AS lat, (c_custkey * 104729 % 4000) / 1000.0::DOUBLE + 144 AS lon"


def _places(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), (k * 7919 % 4000 / 1000.0 - 44).alias("lat"), (k * 104729 % 4000 / 1000.0 + 144).alias("lon"), "c_nationkey", "c_mktsegment")


@query(f"""WITH p AS (SELECT c_custkey AS id, {_AT} FROM customer),
j AS (SELECT a.id, b.id AS rid, sqrt(((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)) * 111.32) ** 2 + ((b.lat - a.lat) * 110.57) ** 2) AS km FROM p a JOIN p b ON abs(a.lat - b.lat) < 0.2 AND a.id % 5 = 0 AND b.id % 5 <> 0)
SELECT id, rid, round(km, 6) AS km FROM j WHERE km <= 12""")
def radius_join(t: Tables):
    p = _places(t)
    right = p.where("id % 5 <> 0").select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    left = p.where("id % 5 = 0").select("id", "lat", "lon")
    near = sp.near_places(left, right, 12.0).withColumn("km", F.round("km", 6))  # once a pair of places
    return sp.at_places(left, right, near).select("id", "rid", "km")


@query(f"""WITH p AS (SELECT c_custkey AS id, {_AT} FROM customer), b AS (SELECT id * 2 AS poly, floor(lon * 4) / 4 AS w, floor(lat * 4) / 4 AS s FROM p)
SELECT p.id, min(poly) AS poly FROM p JOIN b ON lon BETWEEN w AND w + 0.5 AND lat BETWEEN s AND s + 0.5 AND (lon - w) + (lat - s) <= 0.5 GROUP BY p.id""")
def point_in_polygon(t: Tables):
    """Right triangles as polygons; coordinates exact in binary, so that edges count alike in both engines."""
    p = _places(t)
    w, s = F.floor(F.col("lon") * 4) / 4, F.floor(F.col("lat") * 4) / 4
    corner = lambda dx, dy: F.struct((w + dx).alias("x"), (s + dy).alias("y"))
    tri = p.select((F.col("id") * 2).alias("poly"), F.array(F.array(corner(0.0, 0.0), corner(0.5, 0.0), corner(0.0, 0.5), corner(0.0, 0.0))).alias("rings"))
    return sp.point_in_polygon(p.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), tri, 0.5)


@query(f"""WITH p AS (SELECT c_custkey AS id, c_nationkey AS cls, {_AT} FROM customer), b AS (SELECT id, cls, lon AS w, lat AS s, lon + 0.125 AS e, lat + 0.125 AS n FROM p)
SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.cls = b.cls AND a.id < b.id AND a.w <= b.e AND b.w <= a.e AND a.s <= b.n AND b.s <= a.n""")
def boxes_touching(t: Tables):
    p = _places(t)
    b = p.select("id", F.col("c_nationkey").alias("cls"), F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 0.125).alias("east"), (F.col("lat") + 0.125).alias("north"))
    return sp.boxes_touching(b, 0.25)


_PIX = "pix AS (SELECT o_orderkey AS i, (o_orderkey * 31 % 97) AS row, (o_orderkey * 17 % 89) AS col, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS cls FROM orders)"


def _pixels(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select((k * 31 % 97).alias("row"), (k * 17 % 89).alias("col"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("cls"))


@query(f"""WITH {_PIX}, n AS (SELECT row // 10 AS row, col // 10 AS col, cls, count(*) AS n FROM pix GROUP BY ALL),
b AS (SELECT row, col, cls, row_number() OVER (PARTITION BY row, col ORDER BY cls IS NULL, n DESC, cls) AS rn, sum(CASE WHEN cls IS NOT NULL THEN n ELSE 0 END) OVER w / sum(n) OVER w AS dry FROM n WINDOW w AS (PARTITION BY row, col))
SELECT row, col, CASE WHEN dry >= 0.9 THEN cls END AS cls FROM b WHERE rn = 1""")
def mode_resample(t: Tables):
    return ras.mode_resample(_pixels(t), 10, land=0.9)


@query(f"""WITH {_PIX}, n AS (SELECT row // 20 AS row, col // 20 AS col, cls, count(*) AS n FROM pix WHERE cls IS NOT NULL GROUP BY ALL), s AS (SELECT *, n * 1000 / sum(n) OVER (PARTITION BY row, col) AS pm FROM n)
SELECT row, col, cls, n, CASE WHEN pm >= 500 THEN 4 WHEN pm >= 250 THEN 3 WHEN pm >= 50 THEN 2 WHEN pm > 0 THEN 1 ELSE 0 END AS level FROM s""")
def presence_levels(t: Tables):
    s = ras.shares(_pixels(t).where("cls is not null"), F.expr("row div 20"), F.expr("col div 20"))
    return s.select("row", "col", "cls", "n", ras.level(F.col("permille")).alias("level"))


@query("""WITH n AS (SELECT p_brand AS child, p_type AS parent, count(*) AS n FROM part GROUP BY ALL), v AS (SELECT child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS rn FROM n) WHERE rn = 1)
SELECT child, CASE WHEN child = 'Brand#11' THEN 'NAMED' ELSE parent END AS parent FROM v""")
def parent_votes(t: Tables):
    n = t.part.groupBy(F.col("p_brand").alias("child"), F.col("p_type").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    named = t.part.where("p_brand = 'Brand#11'").select(F.col("p_brand").alias("child"), F.lit("NAMED").alias("parent")).distinct()
    return ras.parent_votes(n, named)


_BOX = "b AS (SELECT n_nationkey AS id, n_nationkey * 13 AS x0, n_nationkey * 13 + n_nationkey % 7 AS x1, n_nationkey * 11 AS y0, n_nationkey * 11 + n_nationkey % 5 AS y1 FROM nation)"


def _tile_boxes(t: Tables):
    k = F.col("n_nationkey").cast("bigint")
    return t.nation.select(k.alias("id"), (k * 13).alias("x0"), (k * 13 + k % 7).alias("x1"), (k * 11).alias("y0"), (k * 11 + k % 5).alias("y1"))


@query(f"""WITH {_BOX}, z AS (SELECT id, z, x0 // (2 ** (9 - z))::BIGINT AS x0, x1 // (2 ** (9 - z))::BIGINT AS x1, y0 // (2 ** (9 - z))::BIGINT AS y0, y1 // (2 ** (9 - z))::BIGINT AS y1 FROM b, range(5, 10) r(z))
SELECT id, z::INTEGER AS z, x, y FROM (SELECT id, z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM z) q, unnest(range(y0, y1 + 1)) u(y)""")
def tile_pyramid(t: Tables):
    return ras.pyramid(_tile_boxes(t), 5, 9)


@query(f"""WITH {_BOX}, z AS (SELECT id, z, (x1 // (2 ** (9 - z))::BIGINT - x0 // (2 ** (9 - z))::BIGINT + 1) * (y1 // (2 ** (9 - z))::BIGINT - y0 // (2 ** (9 - z))::BIGINT + 1) AS n FROM b, range(5, 10) r(z)),
r AS (SELECT id, z, sum(n) OVER (PARTITION BY id ORDER BY z) AS total FROM z) SELECT id, max(CASE WHEN total <= 20 THEN z END)::INTEGER AS deepest FROM r GROUP BY id""")
def deepest_zoom(t: Tables):
    return run.admitted_zoom(ras.pyramid_counts(_tile_boxes(t), 5, 9), "id", "z", "n", 20)


@query(f"""WITH {_BOX}, s AS (SELECT DISTINCT x0 // 4 AS x, y0 // 4 AS y FROM b WHERE id % 2 = 0) SELECT id FROM b WHERE EXISTS (SELECT 1 FROM s WHERE s.x = b.x0 // 4 AND s.y = b.y0 // 4)""")
def stored_parents(t: Tables):
    b = _tile_boxes(t).select("id", F.lit(9).alias("z"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    stored = b.where("id % 2 = 0").select(F.lit(7).alias("z"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y")).distinct()
    return ras.with_stored_parent(b, stored, 2).select("id")


@query("""
WITH RECURSIVE t0 AS (SELECT DISTINCT c_custkey AS id, c_custkey * 7919 % 512 AS x, c_custkey * 104729 % 512 AS y FROM customer),
r AS (SELECT id, x AS x0, y AS y0, x, y, (4 ** 9 - 1)::BIGINT // 3 AS acc, 256::BIGINT AS s FROM t0
 UNION ALL SELECT id, x0, y0,
  CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) <> 0 THEN s - 1 - (y & (s - 1)) ELSE y & (s - 1) END ELSE x & (s - 1) END,
  CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) <> 0 THEN s - 1 - (x & (s - 1)) ELSE x & (s - 1) END ELSE y & (s - 1) END,
  acc + s * s * xor(3 * CASE WHEN (x & s) <> 0 THEN 1 ELSE 0 END, CASE WHEN (y & s) <> 0 THEN 1 ELSE 0 END), s // 2 FROM r WHERE s > 0)
SELECT id, x0 AS x, y0 AS y, acc AS tile_id, x0 AS back_x, y0 AS back_y FROM r WHERE s = 0""")
def tile_ids(t: Tables):
    k = F.col("c_custkey")
    tiles = t.customer.select(k.alias("id"), (k * 7919 % 512).alias("x"), (k * 104729 % 512).alias("y")).withColumn("tile_id", geo.tile_id(9, F.col("x"), F.col("y")))
    back = geo.tile_of_id(F.col("tile_id"))
    return tiles.withColumn("back", back).select("id", "x", "y", "tile_id", F.col("back.x").alias("back_x"), F.col("back.y").alias("back_y"))


@query("""WITH t AS (SELECT o_orderkey AS tile_id, sha256(o_orderstatus) AS d FROM orders), b AS (SELECT *, CASE WHEN lag(tile_id) OVER w = tile_id - 1 AND lag(d) OVER w = d THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY tile_id // 1048576 ORDER BY tile_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY tile_id // 1048576 ORDER BY tile_id) AS run FROM b)
SELECT min(tile_id) AS tile_id, count(*) AS run_length, d AS digest FROM r GROUP BY tile_id // 1048576, run, d""")
def tile_directory(t: Tables):
    return ras.archive_directory(t.orders.select(F.col("o_orderkey").alias("tile_id"), F.col("o_orderstatus").cast("binary").alias("blob")))


@query("""SELECT o_orderkey AS tile_id, sha256(o_orderstatus) AS digest FROM orders""")
def tile_lookup(t: Tables):
    tiles = t.orders.select(F.col("o_orderkey").alias("tile_id"), F.col("o_orderstatus").cast("binary").alias("blob"))
    return ras.tile_lookup(ras.archive_directory(tiles), tiles)


@query(f"""WITH p AS (SELECT c_custkey AS id, {_AT} FROM customer) SELECT id, floor((lon + 180) / 360 * 4096)::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS y FROM p""")
def lonlat_tiles(t: Tables):
    p = _places(t)
    return p.select("id", geo.tile_x(F.col("lon"), 12).alias("x"), geo.tile_y(F.col("lat"), 12).alias("y"))


@query(f"""WITH k AS (SELECT 1 / (2 * 298.257222101::DOUBLE - 1) AS n, sqrt((2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE) AS e),
c AS (SELECT e, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64 + n ** 6 / 256) AS a, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 - 127 * n ** 5 / 288 + 7891 * n ** 6 / 37800,
  13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 + 281 * n ** 5 / 630 - 1983433 * n ** 6 / 1935360, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 + 15061 * n ** 5 / 26880 + 167603 * n ** 6 / 181440,
  49561 * n ** 4 / 161280 - 179 * n ** 5 / 168 + 6601661 * n ** 6 / 7257600, 34729 * n ** 5 / 80640 - 3418889 * n ** 6 / 1995840, 212378941 * n ** 6 / 319334400] AS al FROM k),
p AS (SELECT c_custkey AS id, {_AT} FROM customer), s AS (SELECT id, radians(lon - 147) AS lam, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, a, al FROM p, c),
x AS (SELECT id, a, al, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM s)
SELECT id, round(500000 + a * (eta + list_sum(list_transform(al, lambda v, j: v * cos(2 * j * xi) * sinh(2 * j * eta)))), 3) AS e, round(10000000 + a * (xi + list_sum(list_transform(al, lambda v, j: v * sin(2 * j * xi) * cosh(2 * j * eta)))), 3) AS n FROM x""")
def mga_grid(t: Tables):
    p = _places(t)
    g = geo.mga55(F.col("lat"), F.col("lon"))
    return p.select("id", F.round(g["e"], 3).alias("e"), F.round(g["n"], 3).alias("n"))


@query(f"""WITH {_PIX}, g AS (SELECT cls AS code, row // 8 AS row, col // 8 AS col, count(*) AS n FROM pix WHERE cls IS NOT NULL GROUP BY ALL), t AS (SELECT code, sum(n) AS t FROM g GROUP BY 1),
r AS (SELECT DISTINCT code, row FROM g), c AS (SELECT DISTINCT code, col FROM g),
s AS (SELECT a.code, a.row AS row0, b.row AS row1, g.col, sum(n) AS n FROM r a JOIN r b ON a.code = b.code AND a.row <= b.row JOIN g ON g.code = a.code AND g.row BETWEEN a.row AND b.row GROUP BY ALL),
x AS (SELECT s.code, row0, row1, a.col AS col0, b.col AS col1, sum(n) AS n FROM s JOIN c a ON a.code = s.code JOIN c b ON b.code = s.code AND a.col <= b.col AND s.col BETWEEN a.col AND b.col GROUP BY ALL)
SELECT code, row0, col0, row1, col1 FROM (SELECT x.*, row_number() OVER (PARTITION BY x.code ORDER BY (row1 - row0 + 1) * (col1 - col0 + 1), row0, col0, row1, col1) AS rn FROM x JOIN t ON x.code = t.code WHERE n >= 0.5 * t) WHERE rn = 1""")
def core_boxes(t: Tables):
    cells = _pixels(t).where("cls is not null").groupBy(F.col("cls").alias("code"), F.expr("row div 8").alias("row"), F.expr("col div 8").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return sp.core_box(cells, 0.5)


@query()
def dissolved_cells(t: Tables):
    cells = _pixels(t).where("cls is not null").select(F.col("cls").alias("code"), F.expr("row div 3").alias("row"), F.expr("col div 3").alias("col")).distinct().where("(row * 7 + col * 5) % 3 <> 0")
    return sp.dissolve(cells).select("code", "ring", F.size("points").alias("corners"))
