"""Column functions and small operators on rows made to reach each of their cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import geo, style
from loam.functions import text as tx
from loam.functions.vector import dot
from loam.operators import catalog as cat
from loam.operators import dedup as dd
from loam.operators import indicator as ind
from loam.operators import metrics as met
from loam.operators import names as nm
from loam.operators import raster as ras
from loam.operators import relational as rel
from loam.operators import scoring as sc
from loam.operators import search as se
from loam.operators import spatial as sp

from .registry import Tables, query


def _case(k, n: int, *values):
    """values[k mod n], the last for all others; strings are columns' expressions."""
    out = F.expr(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(k % n == i, F.expr(v)).otherwise(out)
    return out


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 23 = 0 THEN '-inf'::DOUBLE ELSE (c_custkey * 7919 % 4000) / 1000.0::DOUBLE - 44 END AS lat, (c_custkey * 104729 % 4000) / 1000.0::DOUBLE + 144 AS lon FROM customer)
SELECT id, coalesce(lat BETWEEN -43.5 AND -41 AND lon BETWEEN 145 AND 147.5, FALSE) AS inside, coalesce(isfinite(lat), FALSE) AS finite FROM p""")
def box_filter(t: Tables):
    k = F.col("c_custkey")
    lat = F.when(k % 17 == 0, None).when(k % 19 == 0, float("nan")).when(k % 23 == 0, float("-inf")).otherwise(k * 7919 % 4000 / 1000.0 - 44)
    return t.customer.select(k.alias("id"), lat.alias("lat"), (k * 104729 % 4000 / 1000.0 + 144).alias("lon")).select("id", geo.in_box(F.col("lat"), F.col("lon"), -43.5, 145.0, -41.0, 147.5).alias("inside"), geo.finite(F.col("lat")).alias("finite"))


@query("""WITH p AS (SELECT c_custkey AS id, 'R' || n_regionkey || '/N' || n_nationkey || '/C' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey), i AS (SELECT 'R' || r_regionkey AS k FROM region WHERE r_regionkey = 1 UNION SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey % 7 = 0)
SELECT id, path FROM p WHERE EXISTS (SELECT 1 FROM i WHERE path LIKE k || '/%' OR path LIKE '%/' || k || '/%' OR path LIKE '%/' || k)""")
def path_members(t: Tables):
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    part = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    paths = place.select(F.col("c_custkey").alias("id"), F.concat_ws("/", part("R", "n_regionkey"), part("N", "n_nationkey"), part("C", "c_custkey")).alias("path"))
    ids = t.region.where("r_regionkey = 1").select(part("R", "r_regionkey").alias("k")).unionByName(t.nation.where("n_nationkey % 7 = 0").select(part("N", "n_nationkey").alias("k")))
    return rel.contains_path(paths, "path", ids, "k")


@query("""SELECT o_orderkey AS id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN (n + 500) // 1000 || ' kB' WHEN n < 1000000000 THEN (n + 500000) // 1000000 || ' MB' ELSE (n // 100000000 / 10.0)::DECIMAL(18, 1) || ' GB' END AS size,
(k // 10) || '%' AS percent, CASE WHEN k < 950 THEN greatest(50, (k * 20 + 500) // 1000 * 50) || ' m' ELSE (k // 1000) || '.0 km' END AS distance
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 100000000 ELSE o_orderkey * o_orderkey * 37 % 900000000 END AS n, CASE WHEN o_orderkey % 1001 < 950 THEN o_orderkey % 1001 ELSE 1000 END AS k FROM orders) WHERE n < 1000000000 OR n % 100000000 = 0""")
def formatted_figures(t: Tables):
    o = F.col("o_orderkey")
    n = F.when(o % 5 == 0, o * 100000000).otherwise(o * o * 37 % 900000000)
    k = F.when(o % 1001 < 950, o % 1001).otherwise(1000)
    size = F.regexp_replace(tx.size_text(F.col("n")), ",", "")
    return t.orders.select(o.alias("id"), n.alias("n"), k.alias("k")).select("id", size.alias("size"), tx.percent_down(F.col("k") / 1000).alias("percent"), tx.distance_text(F.col("k") / 1000).alias("distance"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS c, split_part(p_name, ' ', 2) AS w FROM part)
SELECT id, CASE c WHEN 0 THEN 'Acacia ' || w WHEN 3 THEN 'Poa ' || w END AS key, c = 0 AND length(w) >= 5 OR c = 3 AND left(w, 5) = 'gizmo' AS kin, CASE c WHEN 0 THEN 'Acacia ' || w ELSE 'other' END AS bare, 'top' AS top FROM p""")
def species_names(t: Tables):
    k, w = F.col("p_partkey"), F.substring_index("p_name", " ", -1)
    name = _case(k, 6, "concat('Acacia ', w)", "'Poa sp.'", "concat('Poa × ', w)", "concat('  Poa   ', w, ' var. x')", "'Poa'", "'Poa Capital'")
    p = t.part.select(k.alias("id"), "p_partkey", w.alias("w")).withColumn("name", name)
    kin = F.when(k % 6 == 0, tx.same_stem(F.col("name"), F.concat(F.lit("Acacia "), F.left("w", F.lit(5)), F.lit("zz")))).otherwise((k % 6 == 3) & tx.same_stem(F.concat(F.lit("Poa "), "w"), F.lit("Poa gizmonia")))
    stripped = tx.code_prefix_stripped(F.when(k % 6 == 0, F.concat(F.lit("(ABC) "), "name")).otherwise("(XYZ)other"))
    return p.select("id", tx.species_key(F.col("name")).alias("key"), kin.alias("kin"), stripped.alias("bare"), tx.top_of_hierarchy(F.concat(F.lit(" top > "), "w")).alias("top"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN c_custkey || 'b' WHEN 3 THEN c_custkey || 'a' WHEN 4 THEN NULL ELSE c_custkey::VARCHAR END AS number, CASE c_custkey % 5 WHEN 4 THEN 'smith road' ELSE 'smith rd' END AS rest,
c_custkey % 5 = 2 AS at_end, CASE c_custkey % 5 WHEN 4 THEN 'smith road' ELSE 'smith road' END AS expanded, c_custkey AS lead FROM customer""")
def house_numbers(t: Tables):
    k = F.col("c_custkey")
    typed = _case(k, 5, "concat('3/', c_custkey, 'b Smith Rd')", "concat(c_custkey, '-', c_custkey + 4, ' Smith Rd')", "concat('Smith Rd ', c_custkey)", "concat('3 ', c_custkey, 'a Smith Rd')", "'Smith Road'")
    split = tx.split_house_number(tx.words(tx.normalise(tx.strip_unit_and_range(typed))))
    s = t.customer.select(k.alias("id"), split.alias("s"), tx.leading_int(F.concat(k, F.lit("th"))).alias("lead"))
    return s.select("id", "s.number", F.array_join("s.rest", " ").alias("rest"), "s.at_end", F.array_join(F.transform("s.rest", tx.expand), " ").alias("expanded"), "lead")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey * 7919 % 256 AS r, p_partkey * 104729 % 256 AS g, p_partkey % 256 AS b, CASE WHEN p_partkey % 3 = 0 THEN 255 ELSE p_partkey * 31 % 256 END AS a, (p_partkey + 1) * 7.3::DOUBLE AS m FROM part),
w AS (SELECT *, a / 255.0::DOUBLE AS f, 10.0::DOUBLE ** floor(log10(m)) AS p FROM p)
SELECT id, printf('#%02X%02X%02X', round_even(r * f + 255 * (1 - f), 0)::INT, round_even(g * f + 255 * (1 - f), 0)::INT, round_even(b * f + 255 * (1 - f), 0)::INT) AS colour, round_even(r * f + 255 * (1 - f), 0)::INT AS red,
CASE WHEN m >= 5 * p THEN 5 * p WHEN m >= 2 * p THEN 2 * p ELSE p END AS bar, CASE id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gzip' WHEN 3 THEN 'pmtiles' END AS kind FROM w""")
def drawn_things(t: Tables):
    k = F.col("p_partkey")
    a = F.when(k % 3 == 0, 255).otherwise(k * 31 % 256)
    byte = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    red = k * 7919 % 256
    code = F.concat(F.lit("#"), F.lower(byte(red)), byte(k * 104729 % 256), byte(k % 256), F.when(k % 3 != 0, byte(a)).otherwise(""))
    head = F.unhex(_case(k, 5, "'FFD8FFE000'", "'89504E470D0A'", "'1F8B0800'", "'504D54696C657303'", "'00112233'"))
    head = F.when(k % 5 == 3, F.unhex(F.lit("504D54696C657303"))).otherwise(head)
    return t.part.select(k.alias("id"), tx.colour(code).alias("colour"), style.over_white(red, a / 255.0).alias("red"), style.scale_bar((k + 1) * F.lit(7.3)).alias("bar"), style.content_kind(head).alias("kind"))


@query("""WITH p AS (SELECT p_brand AS id, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_size AS taken FROM part)
SELECT name, id, pos::INTEGER AS pos, taken FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id, pos) AS rn FROM p) WHERE rn = 1""")
def photo_work_list(t: Tables):
    photos = F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("taken")))).alias("photos")
    return cat.work_list(t.part.groupBy(F.col("p_brand").alias("id")).agg(photos), "photos").select("name", "id", "pos", "taken")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS a FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM a WHERE a = 1)
SELECT p_partkey AS pos, p_name AS key, p_brand AS profile, p_size % 3 AS photos FROM b WHERE b = 1 ORDER BY p_size % 3 > 0 DESC, p_partkey LIMIT 5""")
def card_faces(t: Tables):
    return cat.faces(t.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("key"), F.col("p_brand").alias("profile"), (F.col("p_size") % 3).alias("photos")))


_KINDS = ["MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"]


@query(f"""SELECT c_nationkey AS tap, c_mktsegment AS kind, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY list_position({_KINDS}, c_mktsegment), round(c_acctbal), c_custkey) AS rn FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 0) WHERE rn = 1""")
def tapped(t: Tables):
    hits = t.customer.where("c_mktsegment <> 'MACHINERY' or c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("tap"), F.col("c_mktsegment").alias("kind"), F.round("c_acctbal").alias("dist"), F.col("c_custkey").alias("id"))
    return cat.first_hit(hits, _KINDS).select("tap", "kind", "id")


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'HR' ELSE '' END || c_custkey % 300 AS ref, CASE WHEN c_custkey % 4 = 0 THEN 'HR' ELSE '' END AS p, c_custkey % 300 AS n, c_nationkey FROM customer) SELECT id, ref, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, n, ref, id)::INTEGER AS pos FROM r""")
def registry_order(t: Tables):
    k = F.col("c_custkey")
    r = t.customer.select(k.alias("id"), F.concat(F.when(k % 4 == 0, "HR").otherwise(""), k % 300).alias("ref"), "c_nationkey")
    return r.withColumn("pos", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*cat.ref_key(F.col("ref")), "id"))).drop("c_nationkey")


@query("""WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS key, CASE WHEN p_size % 4 = 0 AND p_brand = 'Brand#11' THEN split_part(p_name, ' ', 2) ELSE p_name END AS name FROM part)
SELECT key, coalesce(max(name) FILTER (WHERE name = key), min(name)) AS name FROM k GROUP BY key""")
def conflicting_keys(t: Tables):
    word = F.substring_index("p_name", " ", -1)
    name = F.when((F.col("p_size") % 4 == 0) & (F.col("p_brand") == "Brand#11"), word).otherwise(F.col("p_name"))
    return rel.conflict_keys(t.part.select(word.alias("key"), name.alias("name")), "key", "name")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'endangered' WHEN 1 THEN 'vulnerable' WHEN 2 THEN 'rare' WHEN 3 THEN 'vulnerable' END AS status,
CASE p_partkey % 6 WHEN 0 THEN 'fern' WHEN 1 THEN CASE WHEN p_size >= 4 THEN 'tree' WHEN p_size >= 1 THEN 'shrub' ELSE 'low shrub' END WHEN 2 THEN CASE WHEN p_size >= 1 THEN 'shrub' ELSE 'low shrub' END WHEN 3 THEN 'grass' WHEN 4 THEN 'tree' ELSE 'other' END AS shape FROM part""")
def plant_notes(t: Tables):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    notes = _case(k, 5, "array('Rare', 'Endangered (EPBC)')", "array('vulnerable')", "array('Rare in the south')", "array('rare', 'Vulnerable')", "array('common')")
    form = _case(k, 6, "'Tree-fern'", "'Small Tree'", "'Shrub'", "'Sedge'", "'tree'", "cast(null as string)")
    return t.part.select(k.alias("id"), cat.status(notes).alias("status"), cat.silhouette(form, F.when(k % 6 != 4, size)).alias("shape"))


@query("""WITH r AS (SELECT p_partkey AS ref, p_name AS botanical, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS common, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS height FROM part WHERE p_partkey % 3 <> 0),
s AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 7 = 0 THEN 'other name' ELSE p_name END AS botanical, p_brand AS common, p_size + 1 AS height FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(r.ref, s.ref) AS ref, coalesce(r.botanical, s.botanical) AS botanical, coalesce(r.common, CASE WHEN r.ref IS NULL OR s.ref IS NULL OR split_part(r.botanical, ' ', 1) = split_part(s.botanical, ' ', 1) THEN s.common END) AS common, coalesce(r.height, s.height)::BIGINT AS height FROM r FULL JOIN s ON r.ref = s.ref""")
def merged_plant_facts(t: Tables):
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    register = t.part.where("p_partkey % 3 <> 0").select(k.alias("ref"), F.col("p_name").alias("botanical"), F.when(k % 4 == 0, F.col("p_type")).alias("common"), F.when(k % 5 == 0, size).alias("height"))
    sheets = t.part.where("p_partkey % 2 = 0").select(k.alias("ref"), F.when(k % 7 == 0, "other name").otherwise(F.col("p_name")).alias("botanical"), F.col("p_brand").alias("common"), (size + 1).alias("height"))
    return cat.merged_facts(register, sheets)[0]


@query("""WITH l AS (SELECT DISTINCT o_orderkey % 37 AS row, o_orderkey % 41 AS col, o_orderstatus AS cls, (o_orderkey % 5)::INTEGER AS level FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT DISTINCT o_orderkey % 37 AS row, o_orderkey % 41 AS col, o_orderstatus AS cls, 1 AS level FROM orders WHERE o_orderkey % 3 = 1),
m AS (SELECT row, col, cls, max(level) AS level FROM (SELECT * FROM l UNION ALL SELECT * FROM p) GROUP BY ALL) SELECT *, CASE level WHEN 1 THEN 0.025 WHEN 2 THEN 0.15 WHEN 3 THEN 0.375 WHEN 4 THEN 0.75 END::DOUBLE AS share FROM m WHERE level > 0""")
def rescued_levels(t: Tables):
    o = F.col("o_orderkey")
    at = [(o % 37).alias("row"), (o % 41).alias("col"), F.col("o_orderstatus").alias("cls")]
    levels, present = t.orders.where(o % 3 == 0).select(*at, (o % 5).cast("int").alias("level")), t.orders.where(o % 3 == 1).select(*at)
    return ras.rescued(levels, present).where("level > 0").withColumn("share", ras.typical_share(F.col("level")))


@query("""SELECT p_brand, p_partkey AS id, p_size, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rk FROM part) WHERE rk <= 10""")
def largest_patches(t: Tables):
    return ras.top_patches(t.part.select("p_brand", F.col("p_partkey").alias("id"), "p_size"), "p_brand", "p_size")


@query("""WITH p AS (SELECT event_id % 7 AS dp, event_id % 5 AS dd, event_id % 3 = 0 AS copy FROM events), g AS (SELECT tp, td FROM (SELECT unnest([0, 2, 4]) AS tp), (SELECT unnest([1, 3]) AS td))
SELECT tp, td, round(avg(CASE WHEN copy THEN (dp <= tp AND dd <= td)::INT END), 9) AS recall, round(avg(CASE WHEN NOT copy THEN (dp <= tp AND dd <= td)::INT END), 9) AS false_share FROM p, g GROUP BY ALL""")
def threshold_grid(t: Tables):
    e = F.col("event_id")
    g = dd.threshold_grid(t.events.select((e % 7).alias("dp"), (e % 5).alias("dd"), (e % 3 == 0).alias("copy")), [0, 2, 4], [1, 3])
    return g.select("tp", "td", F.round("recall", 9).alias("recall"), F.round("false_share", 9).alias("false_share"))


@query("""WITH r AS (SELECT event_type AS part, CASE event_id % 3 WHEN 0 THEN 'species' WHEN 1 THEN 'genus' ELSE 'unsure' END AS kind, event_id % 5 <> 0 AS ok FROM events)
SELECT part, round(avg(CASE WHEN kind = 'unsure' THEN 0 WHEN NOT ok THEN -1 WHEN kind = 'species' THEN 1 ELSE 0.5 END), 9)::DOUBLE AS utility, round(avg((kind = 'unsure')::INT), 9) AS unsure, round(avg((kind <> 'unsure' AND NOT ok)::INT), 9) AS wrong FROM r GROUP BY part""")
def answer_utility(t: Tables):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "species").when(e % 3 == 1, "genus").otherwise("unsure")
    u = met.utility(t.events.select(F.col("event_type").alias("part"), kind.alias("kind"), (e % 5 != 0).alias("ok")), "part", "kind", F.col("ok"))
    return u.select("part", *[F.round(c, 9).alias(c) for c in ("utility", "unsure", "wrong")])


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT l_returnflag, l_linestatus, greatest(round_even(sum(n), 0), 1)::BIGINT AS n FROM (SELECT l_returnflag, l_linestatus, n * 0.25::DOUBLE AS n FROM a UNION ALL SELECT l_returnflag, l_linestatus, n * 2.0::DOUBLE FROM b) GROUP BY ALL""")
def merged_count_tables(t: Tables):
    keys = ["l_returnflag", "l_linestatus"]
    n = lambda d: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return ind.merged_counts([(n(t.lineitem), 0.25), (n(t.lineitem.where("l_orderkey % 2 = 0")), 2.0)], keys)


@query("""WITH z AS (SELECT vec_id AS id, (i - 1)::INTEGER AS cls, x::DOUBLE AS z FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings)),
m AS (SELECT id, CASE WHEN cls % 5 = 1 THEN cls - 1 ELSE cls END AS cls, CASE WHEN cls % 7 = 3 THEN -1e4::DOUBLE ELSE z END AS z FROM z) SELECT id, cls, round(max(z), 6) AS z FROM m GROUP BY ALL""")
def remapped_scores(t: Tables):
    z = t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("cls", "z")).withColumn("z", F.col("z").cast("double"))
    classes = z.select("cls").distinct()
    return sc.remapped(z, classes.where("cls % 5 = 1").select("cls", (F.col("cls") - 1).alias("into")), classes.where("cls % 7 = 3")).withColumn("z", F.round("z", 6))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT id, round(list_dot_product(v, list_reverse(v)) / n, 6) AS mirrored, round(CASE WHEN id % 4 = 0 THEN 0 ELSE exp(-((id % 50) ** 2) / 200.0::DOUBLE) END + 0.1, 9)::DOUBLE AS decay FROM n""")
def scaled_weights(t: Tables):
    """Vectors over the root of their length, multiplied with their mirror images; votes that fade with distance."""
    rows = sc.tau_norm(t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")), 0.5)
    km = F.when(F.col("id") % 4 != 0, (F.col("id") % 50).cast("double"))
    return rows.select("id", F.round(dot(F.col("v"), F.reverse("v")), 6).alias("mirrored"), F.round(sc.geo_decay(km, 10.0, 0.1), 9).alias("decay"))


@query("""WITH s AS (SELECT user_id AS id, value AS s, event_id % 3 <> 0 AS other FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS rk FROM s WHERE other) SELECT id, round(avg(s), 6) AS "offset" FROM r WHERE rk <= 5 GROUP BY id""")
def hub_offsets(t: Tables):
    e = t.events.select(F.col("user_id").alias("id"), F.col("value").alias("s"), (F.col("event_id") % 3 != 0).alias("other"))
    return met.hub_offsets(e, 5).withColumn("offset", F.round("offset", 6))


@query("""WITH x AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_partkey ELSE p_partkey - p_partkey % 4 END AS a FROM part)
SELECT o.id, o.name, coalesce(s.n, '') AS synonyms FROM x o LEFT JOIN (SELECT a, string_agg(name, '|' ORDER BY name) AS n FROM x WHERE a <> id GROUP BY a) s ON s.a = o.id WHERE o.a IS NULL OR o.a = o.id""")
def accepted_names(t: Tables):
    k = F.col("p_partkey")
    accepted = F.when(k % 4 == 0, None).when(k % 4 == 1, k).otherwise(k - k % 4)
    out = nm.accepted_table(t.part.select(k.alias("id"), F.col("p_name").alias("name"), accepted.alias("accepted_id")))
    return out.withColumn("synonyms", F.array_join("synonyms", "|"))


@query("""WITH l AS (SELECT p_partkey AS label, p_size % 60 AS cls, p_partkey * 7919 % 101 AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, label) AS rk FROM l WHERE cls < 40)
SELECT l.label, l.cls, coalesce(rk = 1, FALSE) AS attached FROM l LEFT JOIN r ON l.label = r.label""")
def attached_labels(t: Tables):
    k = F.col("p_partkey")
    labels = t.part.select(k.alias("label"), (F.col("p_size") % 60).alias("cls"), (k * 7919 % 101).alias("score"))
    taken, left = nm.attach_one(labels.where("cls < 40").select("cls").distinct(), labels, "score")
    return taken.select("label", "cls", F.lit(True).alias("attached")).unionByName(left.select("label", "cls", F.lit(False).alias("attached")))


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE rn = 1""")
def newest_season(t: Tables):
    return sp.season(t.customer.select("c_nationkey", "c_custkey", "c_mktsegment"), "c_nationkey", "c_custkey", F.col("c_mktsegment") != "BUILDING").select("c_nationkey", "c_custkey")


@query("""SELECT p_partkey AS id, '20' || (10 + p_partkey % 10) AS year, CASE WHEN p_partkey % 3 = 0 THEN '300x200' END AS size, replace(p_name, ' ', '-') AS stem,
'Hill' || ' · ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' ELSE '' END || 'Hobart' AS meta FROM part""")
def place_and_upload_texts(t: Tables):
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://example.org/uploads/20"), 10 + k % 10, F.lit("/07/"), F.translate("p_name", " ", "-"), F.when(k % 3 == 0, "-300x200").otherwise(""), F.lit(".jpg?x=1"))
    meta = tx.meta_line(F.lit("Hill"), F.col("p_name"), F.lit("Hobart, Glenorchy"), F.when(k % 2 == 0, "else").otherwise(F.col("p_name")))
    return t.part.select(k.alias("id"), tx.upload_parts(url).alias("u"), meta.alias("meta")).select("id", "u.year", "u.size", "u.stem", "meta")


@query("""SELECT DISTINCT l_partkey % 500 AS cell FROM lineitem""")
def footprint_union(t: Tables):
    return ras.union_footprint(t.lineitem.select(F.col("l_suppkey").alias("pack"), (F.col("l_partkey") % 500).alias("cell")))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM n)
SELECT p_name AS row_id, pos::INTEGER AS pos, token, left(token, k::INT) AS prefix FROM w, range(1, 30) r(k) WHERE k <= length(token)""")
def token_prefixes(t: Tables):
    n = t.part.select(F.col("p_name").alias("row_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("context")).distinct()
    return se.token_index(n).where("kind = 'name'").select("row_id", "pos", "token", "prefix")


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'promo')""")
def credit_filter(t: Tables):
    has = lambda c, x: F.contains(F.lower(F.col(c)), F.lit(x))
    return t.part.where(has("p_name", "ring") | has("p_type", "promo")).select("p_partkey", "p_name", "p_type")


@query("""SELECT c_custkey AS id, round(log2(least(390.0::DOUBLE / ((c_custkey % 97 + 1) / 1000.0::DOUBLE * 512), 844.0::DOUBLE / ((c_custkey % 89 + 1) / 1000.0::DOUBLE * 512))), 9) AS zoom FROM customer""")
def fit_zoom(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), F.round(cat.fit_zoom((k % 97 + 1) / 1000.0, (k % 89 + 1) / 1000.0, 390.0, 844.0), 9).alias("zoom"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Tas:native and naturalised|Vic:' WHEN 1 THEN 'NSW:' WHEN 2 THEN 'Tas:extinct, once common|Qld:' ELSE '' END AS states FROM customer""")
def qualified_states(t: Tables):
    text = _case(F.col("c_custkey"), 4, "'Tas (native and naturalised), Vic'", "' NSW '", "'Tas (extinct, once common), , Qld'", "''")
    states = F.transform(nm.qualified_states(text), lambda s: F.concat(s.state, F.lit(":"), F.coalesce(s.note, F.lit(""))))
    return t.customer.select(F.col("c_custkey").alias("id"), F.array_join(states, "|").alias("states"))


@query("""WITH z AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS cls, 10 * unnest(embedding)::DOUBLE AS z FROM embeddings) SELECT id, cls::INTEGER AS cls, round(z - ln(sum(exp(z)) OVER (PARTITION BY id)), 6) AS z FROM z""")
def log_softmax(t: Tables):
    z = t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("cls", "z")).select("id", (F.col("cls") + 1).alias("cls"), (F.col("z").cast("double") * 10).alias("z"))
    return sc.log_softmax(z, "z").withColumn("z", F.round("z", 6))


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_id AS id, e.event_type AS cls, round(n ** -0.5::DOUBLE * CASE WHEN user_id % 2 = 0 THEN (user_id + 1) ** 0.25::DOUBLE ELSE 1 END, 9) AS w FROM events e JOIN n ON e.event_type = n.event_type""")
def vote_weights(t: Tables):
    near = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("rid"), F.col("event_type").alias("cls"))
    masses = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("rid"), (F.col("user_id") + 1).cast("double").alias("mass")).distinct()
    return sc.vote_weights(near, near.groupBy("cls").agg(F.count(F.lit(1)).alias("n")), 0.5, masses, 0.25).select("id", "cls", F.round("w", 9).alias("w"))


@query("""WITH e AS (SELECT vec_id AS id, label AS cls, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT cls, v, count(*) OVER (PARTITION BY cls) AS k FROM e WHERE id < 60)
SELECT e.id, b.cls, round(0.5 * (ln(sum(exp(list_dot_product(e.v, b.v) / 0.5))) - ln(any_value(k))) + b.cls / 100.0::DOUBLE, 6) AS z FROM e CROSS JOIN b GROUP BY e.id, b.cls""")
def prototype_head(t: Tables):
    """The first 60 vectors are a head of several prototypes a class."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("embedding").alias("v"))
    rows = e.where("id < 60").select("cls", "v", (F.col("cls") / 100.0).alias("bias"))
    return sc.head_scores(e, rows, 0.5).withColumn("z", F.round("z", 6))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 'Acacia ' || split_part(p_name, ' ', 2) END AS botanical, CASE p_partkey % 3 WHEN 2 THEN p_name ELSE 'Silver ' || upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) END AS common FROM part""")
def named_lines(t: Tables):
    from loam.operators import layout

    w1, w2 = F.initcap(F.substring_index("p_name", " ", 1)), F.substring_index("p_name", " ", -1)
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("Acacia "), w2, F.lit(" - Silver "), w1)).when(k % 3 == 1, F.concat(F.lit("Silver "), w1, F.lit("  (Acacia "), w2, F.lit(")"))).otherwise(F.col("p_name"))
    return layout.name_lines(t.part.select(k.alias("id"), line.alias("line")), "line").select("id", "botanical", "common")


@query("""SELECT DISTINCT p_brand, array_to_string(list_transform(string_split(upper(p_type), ''), lambda x: chr(ascii(x) + 5)), '') AS shifted FROM part""")
def shifted_glyphs(t: Tables):
    return t.part.select("p_brand", tx.unshift(F.upper("p_type"), 5).alias("shifted")).distinct()


@query("""WITH p AS (SELECT o_custkey AS cls, o_orderkey AS id, o_totalprice AS s FROM orders) SELECT cls, id, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY s DESC, id) AS rk FROM p)""")
def stable_order(t: Tables):
    """Score descending, then index."""
    return t.orders.select(F.col("o_custkey").alias("cls"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rk"))


@query("""WITH c AS (SELECT c_custkey AS id, 'Shrub number ' || c_custkey || ' flowers.' AS s, c_custkey % 25 + 1 AS n FROM customer)
SELECT id, CASE WHEN id % 4 = 3 THEN repeat('word, ', 48) || 'word…' WHEN n * (length(s) + 1) - 1 > 300 THEN repeat(s || ' ', 299 // (length(s) + 1)) || '…' ELSE trim(repeat(s || ' ', n)) END AS text FROM c""")
def descriptions(t: Tables):
    k = F.col("c_custkey")
    sentences = F.array_join(F.array_repeat(F.concat(F.lit("Shrub number "), k, F.lit(" flowers.")), (k % 25 + 1).cast("int")), " ")
    growing = F.when(k % 3 == 0, "Sow seed in pots. ").otherwise("")
    text = F.when(k % 4 == 3, F.concat(F.repeat(F.lit("word, "), 60), F.lit("end"))).otherwise(F.concat(growing, sentences))
    return t.customer.select(k.alias("id"), tx.description(text).alias("text"))
