"""Queries of styles, plans of pulls, grids and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import style as sty
from loam.operators import layout
from loam.operators import planning as pl
from loam.operators import scoring as sc

from .registry import Tables, query


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 0 END AS matched, CASE WHEN p_size >= 40 THEN 3.0 WHEN p_size >= 20 THEN 2.0 WHEN p_size >= 10 THEN 1.5 ELSE 1.0 END::DOUBLE AS stepped,
CASE WHEN p_size <= 10 THEN 0.0::DOUBLE WHEN p_size < 20 THEN 0.0 + (p_size - 10.0::DOUBLE) / 10.0 * 5.0 WHEN p_size < 40 THEN 5.0 + (p_size - 20.0::DOUBLE) / 20.0 * 1.0 ELSE 6.0 END AS linear FROM part""")
def style_expressions(t: Tables):
    s = F.col("p_size").cast("double")
    return t.part.select(
        "p_partkey", sty.match(F.col("p_brand"), {"Brand#11": 1, "Brand#22": 2}, 0).alias("matched"), sty.step(s, 1.0, [(10, 1.5), (20, 2.0), (40, 3.0)]).alias("stepped"),
        sty.interpolate(s, [(10.0, 0.0), (20.0, 5.0), (40.0, 6.0)]).alias("linear"),
    )


@query(r"""SELECT page_id, starts_with(url, 'https://') AND (ends_with(url, '.html') OR ends_with(url, '/')) AS allowed, regexp_matches(lower(url), '^https://([^/?#:]+\.)?example\.com([/?#:]|$)') AS hosted FROM pages""")
def allowed_addresses(t: Tables):
    u = F.col("url")
    return t.pages.select("page_id", sty.allowed_url(u, ["https://"], [".html", "/"]).alias("allowed"), sty.allowed_host(u, ["example.com"]).alias("hosted"))


@query("""SELECT DISTINCT p_size, CASE p_size % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'blank' ELSE 'blank' END AS kind, CASE WHEN p_size % 3 = 0 THEN p_size * 10 END::BIGINT AS "limit", CASE WHEN p_size % 3 < 2 THEN p_size % 15 END::INTEGER AS zoom FROM part""")
def prune_rules(t: Tables):
    s = F.col("p_size")
    spec = F.when(s % 3 == 0, F.concat(F.lit("size<"), s * 10, F.lit("@"), s % 15)).when(s % 3 == 1, F.concat(F.lit("blank@"), s % 15)).otherwise("blank")
    return t.part.select("p_size").distinct().select("p_size", sty.prune_rule(spec).alias("r")).select("p_size", "r.kind", "r.limit", "r.zoom")


_AREA = "a AS (SELECT n_nationkey AS id, n_nationkey * 13 AS x0, n_nationkey * 13 + 9 AS x1, n_nationkey * 11 AS y0, n_nationkey * 11 + 6 AS y1 FROM nation), s AS (SELECT DISTINCT o_orderkey * 7 % 80 AS x, o_orderkey * 3 % 70 AS y FROM orders)"


@query(f"""WITH {_AREA} SELECT id, sum((least(x1, x * 4 + 3) - greatest(x0, x * 4) + 1) * (least(y1, y * 4 + 3) - greatest(y0, y * 4) + 1))::BIGINT AS n
FROM a JOIN s ON x * 4 <= x1 AND x * 4 + 3 >= x0 AND y * 4 <= y1 AND y * 4 + 3 >= y0 GROUP BY id""")
def clipped_children(t: Tables):
    k = F.col("n_nationkey").cast("bigint")
    areas = t.nation.select(k.alias("id"), (k * 13).alias("x0"), (k * 13 + 9).alias("x1"), (k * 11).alias("y0"), (k * 11 + 6).alias("y1"))
    o = F.col("o_orderkey")
    tiles = t.orders.select((o * 7 % 80).alias("x"), (o * 3 % 70).alias("y"))
    return pl.clipped_children(areas, tiles, 2)


@query("""WITH p AS (SELECT o_orderkey % 5 AS z, o_orderkey // 5 AS x, o_custkey AS y, o_orderstatus AS s FROM orders)
SELECT z, count(*) AS planned, count(*) FILTER (WHERE s <> 'F' AND y % 10 <> 0) AS "left" FROM p GROUP BY z""")
def remaining_tiles(t: Tables):
    o = F.col("o_orderkey")
    p = t.orders.select((o % 5).alias("z"), F.expr("o_orderkey div 5").alias("x"), F.col("o_custkey").alias("y"), "o_orderstatus")
    return pl.remaining(p.select("z", "x", "y"), p.where("o_orderstatus = 'F'"), p.where("y % 10 = 0"))


@query("""WITH c AS (SELECT l_partkey AS project, floor(avg(l_suppkey))::BIGINT AS x, floor(avg(l_linenumber))::BIGINT AS y FROM lineitem GROUP BY 1),
s AS (SELECT *, (x % 3 = 0) AS st, (x % 3 = 1) AS bl FROM c) SELECT CASE WHEN st THEN 'stored' WHEN bl THEN 'blank' ELSE 'missing' END AS state, count(*) AS n FROM s GROUP BY 1""")
def footprint_check(t: Tables):
    grid = t.supplier.select(F.col("s_suppkey").alias("x")).unionByName(t.spark.range(1).select(F.col("id").alias("x"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")))
    p = t.lineitem.select(F.col("l_partkey").alias("project"), F.col("l_suppkey").alias("x"), F.col("l_linenumber").alias("y"))
    return pl.footprint_check(p, grid.where("x % 3 = 0"), grid.where("x % 3 = 1"))


@query("""WITH c AS (SELECT l_linenumber AS z, count(*) AS tiles, sum(CAST(l_quantity AS BIGINT)) AS bytes, l_returnflag FROM lineitem GROUP BY z, l_returnflag)
SELECT z, sum(bytes) / sum(tiles) AS mean, min(bytes / tiles) AS low, max(bytes / tiles) AS high FROM c GROUP BY z""")
def size_calibration(t: Tables):
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("z"), "l_returnflag").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.col("l_quantity").cast("bigint")).alias("bytes"))
    return pl.calibration(s)


@query("""WITH p AS (SELECT (c_custkey * 7919 % 4000) / 1000.0::DOUBLE - 44 AS lat, (c_custkey * 104729 % 4000) / 1000.0::DOUBLE + 144 AS lon, c_mktsegment AS cls, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS accuracy FROM customer)
SELECT floor((lat + 44) / 0.5)::BIGINT AS row, floor((lon - 144) / 0.5)::BIGINT AS col, cls, count(*) AS n FROM p WHERE accuracy IS NULL OR accuracy <= 4000 GROUP BY ALL""")
def record_grid(t: Tables):
    k = F.col("c_custkey")
    p = t.customer.select((k * 7919 % 4000 / 1000.0 - 44).alias("lat"), (k * 104729 % 4000 / 1000.0 + 144).alias("lon"), F.col("c_mktsegment").alias("cls"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("accuracy"))
    return pl.csr_decoded(pl.csr_cells(pl.grid_counts(p, -44.0, 144.0, 0.5, 4000.0)))


@query("""SELECT event_type AS kind, count(*) AS requests, sum(user_id)::BIGINT AS units, sum(user_id) * CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 2.0 ELSE 0.0 END::DOUBLE AS cost FROM events GROUP BY event_type""")
def usage_costs(t: Tables):
    prices = t.spark.createDataFrame([("view", 0.5), ("click", 2.0)], "kind string, price double")
    return pl.usage_costs(t.events.select(F.col("event_type").alias("kind"), F.col("user_id").alias("units")), prices)


@query("""WITH r AS (SELECT n_nationkey AS a, CASE WHEN n_nationkey % 6 < 5 AND n_nationkey < 24 THEN n_nationkey + 1 END AS nx FROM nation)
SELECT (a // 6 * 6)::BIGINT AS start, a::BIGINT AS "at", (a % 6)::BIGINT AS step FROM r""")
def blob_chain(t: Tables):
    k = F.col("n_nationkey").cast("bigint")
    sc_ = t.spark.sparkContext
    if sc_._jsc.sc().getCheckpointDir().isEmpty():
        from loam.operators.graph import _checkpoint_dir

        sc_.setCheckpointDir(_checkpoint_dir(t.nation))
    return pl.chain(t.nation.select(k.alias("at"), F.when((k % 6 < 5) & (k < 24), k + 1).alias("next"))).select("start", "at", "step")


@query("""WITH g AS (SELECT o_orderkey * 31 % 97 AS row, o_orderkey * 17 % 89 AS col, count(*) AS n FROM orders GROUP BY ALL),
d AS (SELECT r, c, exp(-(r * r + c * c) / 4.5::DOUBLE) AS w FROM range(-5, 6) a(r), range(-5, 6) b(c) WHERE r * r + c * c <= 20.25),
v AS (SELECT row + r AS row, col + c AS col, round(sum(n * w / (SELECT sum(w) FROM d)), 6) AS v FROM g, d GROUP BY ALL)
SELECT row, col, v, CAST(greatest(0, least(5, round_even(log2(4 / greatest(v, 1e-9::DOUBLE)), 0))) AS INTEGER) AS code FROM v""")
def smoothed_grid(t: Tables):
    o = F.col("o_orderkey")
    g = t.orders.groupBy((o * 31 % 97).alias("row"), (o * 17 % 89).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    s = pl.smoothed(g, 1.5)
    return s.select("row", "col", F.round("v", 6).alias("v"), pl.balloon_code(F.round("v", 6), 4.0, 6).alias("code"))


@query("""WITH c AS (SELECT label AS cls, label // 3 AS genus FROM embeddings GROUP BY 1), x AS (SELECT label AS cls, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
o AS (SELECT cls, i, avg(x) AS x FROM x WHERE cls % 3 <> 0 AND cls < 7 GROUP BY ALL), g AS (SELECT genus, i, avg(x) AS x FROM o JOIN c ON o.cls = c.cls GROUP BY ALL), a AS (SELECT i, avg(x) AS x FROM o GROUP BY i)
SELECT c.cls, a.i::INTEGER AS i, round(coalesce(o.x, g.x, a.x), 6) AS x, CASE WHEN o.x IS NOT NULL THEN 'own' WHEN g.x IS NOT NULL THEN 'genus' ELSE 'all' END AS how
FROM c CROSS JOIN a LEFT JOIN o ON o.cls = c.cls AND o.i = a.i LEFT JOIN g ON g.genus = c.genus AND g.i = a.i""")
def rows_for_empty_classes(t: Tables):
    e = t.embeddings.select(F.col("label").alias("cls"), "embedding")
    x = e.where("cls % 3 <> 0 and cls < 7").select("cls", F.posexplode("embedding").alias("i", "x")).groupBy("cls", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = x.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    classes = e.select("cls", F.expr("cls div 3").alias("genus")).distinct()
    return sc.rows_for_empty(classes, rows).select("cls", "how", F.posexplode("v").alias("i", "x")).select("cls", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"), "how")


@query("""WITH e AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), g AS (SELECT floor(y / 0.05)::BIGINT AS row, floor(x / 0.05)::BIGINT AS col, label AS key, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT row, col, sum(n) >= 4 AS dense FROM g GROUP BY ALL), f AS (SELECT label AS cls, (count(*) + 1) / sum(count(*) + 1) OVER () AS f FROM e GROUP BY 1),
p AS (SELECT id, x, y, CASE WHEN dense THEN 0.04::DOUBLE ELSE 0.08::DOUBLE END AS sigma, CASE WHEN dense THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS alpha FROM e JOIN c ON row = floor(y / 0.05)::BIGINT AND col = floor(x / 0.05)::BIGINT WHERE id % 7 <> 0),
j AS (SELECT id, key, n, sigma, (x - (col + 0.5) * 0.05) ** 2 + (y - (row + 0.5) * 0.05) ** 2 AS d2 FROM p CROSS JOIN g), k AS (SELECT id, key, sum(n * exp(-d2 / (2 * sigma * sigma))) AS k FROM j WHERE d2 <= 9 * sigma * sigma GROUP BY ALL),
s AS (SELECT id, sum(k) AS t FROM k GROUP BY 1)
SELECT p.id, f.cls, round(ln((coalesce(k.k, 0) + alpha * f.f) / (coalesce(s.t, 0) + alpha)), 6) AS lp FROM p CROSS JOIN f LEFT JOIN k ON k.id = p.id AND k.key = f.cls LEFT JOIN s ON s.id = p.id
UNION ALL SELECT id, cls, round(ln(f.f), 6) FROM e CROSS JOIN f WHERE id % 7 = 0""")
def adaptive_prior(t: Tables):
    """Widths by cell code; every seventh point has no location and gets the class frequency."""
    from loam.functions import geo

    v = F.col("embedding")
    x, y = v[0].cast("double"), v[1].cast("double")
    grid = t.embeddings.groupBy(geo.cell(y, 0.0, 0.05).alias("row"), geo.cell(x, 0.0, 0.05).alias("col"), F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    codes = grid.groupBy("row", "col").agg(F.sum("n").alias("s")).select("row", "col", F.when(F.col("s") >= 4, 0).otherwise(1).alias("code"))
    points = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 != 0, x).alias("x"), F.when(F.col("vec_id") % 7 != 0, y).alias("y"))
    f = sc.class_frequency(t.embeddings.select(F.col("label").alias("cls")).distinct(), t.embeddings.select(F.col("label").alias("cls")))
    return sc.adaptive_prior(points, grid, codes, [(0.04, 0.5), (0.08, 1.0), (0.1, 2.0)], f, 0.05).withColumn("lp", F.round("lp", 6))


@query(r"""WITH l AS (SELECT conv_id || '/' || turn AS page, role, list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ')) AS l FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT page, 'Name' AS label, trim(role) AS value FROM l UNION ALL SELECT page, 'Notes', array_to_string(CASE WHEN list_position(l, '') > 0 THEN l[1:list_position(l, '') - 1] ELSE l END, ' ') FROM l""")
def labelled_sections(t: Tables):
    """A page for each turn of each conversation."""
    page = F.concat_ws("/", "conv_id", "turn").alias("page")
    pages = t.conversations.select(page, F.concat(F.lit("Name: "), F.col("role"), F.lit("\nNotes\n"), F.col("text"), F.lit("\n\nEnd")).alias("text"))
    return layout.sections(pages, ["Name", "Notes"])
