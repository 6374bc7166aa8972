"""Catalogue queries: profiles, lists, legends, integrity, credits, months."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import catalog as cat
from loam.operators import names as nm
from loam.operators import runs as run

from .registry import Tables, query


@query("""WITH p AS (SELECT p_name AS species, p_partkey AS id, p_size % 3 > 0 AS photo, p_size % 2 = 0 AS own FROM part)
SELECT species, id FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY photo AND own DESC, photo DESC, own DESC, id) AS rn FROM p) WHERE rn = 1""")
def best_profiles(t: Tables):
    p = t.part.select(F.col("p_name").alias("species"), F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("photos"), (F.col("p_size") % 2 == 0).alias("own_name"))
    return cat.best_profiles(p).select("species", "id")


@query("""SELECT code, species, CASE WHEN c % 4 = 0 THEN NULL ELSE s END AS score, bool_and(c % 4 = 0) OVER (PARTITION BY code) AS tally
FROM (SELECT c_nationkey AS code, c_mktsegment AS species, c_nationkey AS c, sum(c_custkey)::DOUBLE AS s FROM customer GROUP BY ALL)""")
def often_lists(t: Tables):
    l = t.customer.groupBy(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("species")).agg(F.sum("c_custkey").cast("double").alias("s"))
    return cat.often_lists(l.select("code", "species", F.when(F.col("code") % 4 != 0, F.col("s")).alias("score")))


@query("""WITH a AS (SELECT c_nationkey AS code, c_mktsegment AS species, count(*) AS n FROM customer WHERE c_acctbal > 3000 GROUP BY ALL), b AS (SELECT c_nationkey AS code, c_mktsegment AS species, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.species, b.species) AS species, coalesce(b.n, a.n) AS sites FROM a FULL JOIN b ON a.code = b.code AND a.species = b.species""")
def community_sites(t: Tables):
    n = lambda d: d.groupBy(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("species")).agg(F.count(F.lit(1)).alias("sites"))
    return cat.community_sites(n(t.customer.where("c_acctbal > 3000")), n(t.customer.where("c_custkey % 2 = 0")))


@query("""WITH m AS (SELECT DISTINCT p_brand AS grp, p_name AS species FROM part), h AS (SELECT p_name AS species, count(*) AS n FROM part WHERE p_size = 7 GROUP BY 1), e AS (SELECT p_name AS species, count(*) AS n FROM part WHERE p_size < 4 GROUP BY 1),
s AS (SELECT grp, m.species, CASE WHEN h.n > 0 THEN 'here' WHEN e.n > 0 THEN 'near' ELSE 'rest' END AS section, coalesce(h.n, e.n, 0) AS n FROM m LEFT JOIN h ON m.species = h.species LEFT JOIN e ON m.species = e.species)
SELECT grp, species, section, row_number() OVER (PARTITION BY grp, section ORDER BY n DESC, species)::INTEGER AS pos FROM s""")
def group_sections(t: Tables):
    n = lambda c: t.part.where(c).groupBy(F.col("p_name").alias("species")).agg(F.count(F.lit(1)).alias("sites"))
    return cat.sections(t.part.select(F.col("p_brand").alias("grp"), F.col("p_name").alias("species")).distinct(), n("p_size = 7"), n("p_size < 4"))


@query("""WITH r AS (SELECT CASE WHEN r_name = 'ASIA' THEN 'Other' ELSE r_name END AS grp, n_nationkey AS pos, n_nationkey * 7 % 13 AS age, n_nationkey % 4 AS colour FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT *, max(age) OVER (PARTITION BY grp) AS g, min(pos) OVER (PARTITION BY grp, colour) AS c FROM r) SELECT grp, pos, age, colour, row_number() OVER (ORDER BY grp = 'Other', g DESC, grp, c, pos)::INTEGER AS rk FROM p""")
def legend_order(t: Tables):
    r = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return cat.legend(r.select(F.when(F.col("r_name") == "ASIA", "Other").otherwise(F.col("r_name")).alias("grp"), k.alias("pos"), (k * 7 % 13).alias("age"), (k % 4).alias("colour")))


@query("""SELECT o_orderkey, CASE WHEN have IS NULL THEN 'missing' WHEN have < need THEN 'short' WHEN have > need THEN 'long' ELSE 'ok' END AS verdict
FROM (SELECT o_orderkey, o_custkey % 10 AS need, sum(CAST(l_quantity AS BIGINT)) % 10 AS have FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)""")
def integrity_verdicts(t: Tables):
    have = t.lineitem.groupBy("l_orderkey").agg((F.sum(F.col("l_quantity").cast("bigint")) % 10).alias("have"))
    j = t.orders.join(have, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", (F.col("o_custkey") % 10).alias("need"), "have")
    return cat.integrity(j).select("o_orderkey", "verdict")


@query("""WITH n AS (SELECT o_custkey AS creator, o_orderpriority AS licence, count(*) AS n FROM orders GROUP BY ALL) SELECT creator, sum(n)::BIGINT AS n, string_agg(licence || '=' || n, ',' ORDER BY licence) AS licences FROM n GROUP BY 1""")
def creator_totals(t: Tables):
    c = cat.creator_totals(t.orders.select(F.col("o_custkey").alias("creator"), F.col("o_orderpriority").alias("licence")))
    return c.select("creator", "n", F.array_join(F.transform(F.map_entries("licences"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("licences"))


@query("""WITH m AS (SELECT DISTINCT c_custkey AS id, month(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0),
b AS (SELECT *, m - row_number() OVER (PARTITION BY id ORDER BY m) AS g FROM m), r AS (SELECT id, min(m) AS a, max(m) AS z FROM b GROUP BY id, g),
w AS (SELECT *, min(a) OVER (PARTITION BY id) = 1 AND max(z) OVER (PARTITION BY id) = 12 AND count(*) OVER (PARTITION BY id) > 1 AS wraps FROM r)
SELECT id, a::INTEGER AS "from", CASE WHEN wraps AND z = 12 THEN (SELECT z FROM r r2 WHERE r2.id = w.id AND r2.a = 1) ELSE z END::INTEGER AS "to" FROM w WHERE NOT (wraps AND a = 1)""")
def month_runs(t: Tables):
    m = t.orders.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.month("o_orderdate")).alias("m"))
    return m.select("id", F.explode(run.month_runs(F.col("m"))).alias("r")).select("id", F.col("r.from").alias("from"), F.col("r.to").alias("to"))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_type, p_name, p_size % 2 AS k FROM part), d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, k, p_name ORDER BY p_partkey) - 1 AS dup FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, k ORDER BY dup, p_partkey) AS rk FROM d) SELECT p_partkey, dup::INTEGER AS dup, rk::INTEGER AS rk FROM r WHERE rk <= CASE WHEN k = 0 THEN 4 ELSE 2 END""")
def quota_pick(t: Tables):
    c = t.part.withColumn("k", (F.col("p_size") % 2).cast("string"))
    return cat.quota_pick(c, "p_brand", "p_name", "k", {"0": 4, "1": 2}, [F.col("p_partkey")]).select("p_partkey", "dup", "rk")


@query("""WITH s AS (SELECT 1 AS p, s_nationkey AS id, min(s_name) AS who FROM supplier WHERE s_acctbal > 5000 GROUP BY 2 UNION ALL SELECT 2, c_nationkey, min(c_name) FROM customer GROUP BY 2 UNION ALL SELECT 3, n_nationkey, n_name FROM nation)
SELECT id, arg_min(who, p) AS who FROM s GROUP BY id""")
def credit_precedence(t: Tables):
    one = lambda d, k, n: d.groupBy(F.col(k).alias("id")).agg(F.min(n).alias("who"))
    return cat.credits([one(t.supplier.where("s_acctbal > 5000"), "s_nationkey", "s_name"), one(t.customer, "c_nationkey", "c_name"), one(t.nation, "n_nationkey", "n_name")], "id")


@query("""WITH r AS (SELECT p_brand AS ref, p_size AS trees, p_type AS note, p_name AS sheet FROM part), n AS (SELECT ref, note, count(*) AS n FROM r GROUP BY ALL)
SELECT ref, max(trees) AS trees, array_to_string(list_sort(list(DISTINCT sheet)), ',') AS sheets, (SELECT note FROM n WHERE n.ref = r.ref ORDER BY n DESC, note LIMIT 1) AS note FROM r GROUP BY ref""")
def reference_rows(t: Tables):
    r = cat.references(t.part.select(F.col("p_brand").alias("ref"), F.col("p_size").alias("trees"), F.col("p_type").alias("note"), F.col("p_name").alias("sheet")))
    return r.select("ref", "trees", F.array_join("sheets", ",").alias("sheets"), "note")


@query("""SELECT event_id, CASE WHEN code = 200 THEN CASE WHEN event_type IN ('click', 'view') THEN 'ok' ELSE 'refused' END WHEN code IN (404, 410) THEN 'gone' WHEN code >= 500 OR code IN (408, 429) THEN 'retry' ELSE 'refused' END AS verdict
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 403 ELSE 200 END AS code FROM events)""")
def fetch_verdicts(t: Tables):
    code = F.element_at(F.array(*map(F.lit, (404, 503, 429, 403, 200))), (F.col("event_id") % 5 + 1).cast("int"))
    magic = F.when(F.col("event_type").isin("click", "view"), "FFD8FF").otherwise("3C6874")
    return t.events.select("event_id", cat.verdict(code, magic).alias("verdict"))


@query("""SELECT s_suppkey, coalesce(a.v, b.v) AS found, CASE WHEN a.v IS NOT NULL THEN 'id' WHEN b.v IS NOT NULL THEN 'nation' END AS "by" FROM supplier
LEFT JOIN (SELECT l_suppkey AS k, min(l_partkey) AS v FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a ON s_suppkey = a.k LEFT JOIN (SELECT c_nationkey AS k, min(c_custkey) AS v FROM customer GROUP BY 1) b ON s_nationkey = b.k""")
def lookup_chain(t: Tables):
    a = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("value"))
    b = t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value"))
    return cat.looked_up(t.supplier, [("id", a, "s_suppkey"), ("nation", b, "s_nationkey")]).select("s_suppkey", "found", "by")


@query("""WITH e AS (SELECT p_brand AS cls, unnest(string_split(p_name || '|' || p_type, '|')) AS alias, p_partkey FROM part)
SELECT alias, arg_min(cls, p_partkey) AS cls FROM e GROUP BY alias""")
def alias_map(t: Tables):
    c = t.part.select(F.col("p_brand").alias("cls"), F.concat_ws("|", "p_name", "p_type").alias("aliases"), "p_partkey")
    return cat.alias_map(c, "aliases", "p_partkey")


@query("""WITH n AS (SELECT DISTINCT p_name AS t, split_part(p_name, ' ', 2) AS w FROM part), c AS (SELECT t, w, row_number() OVER (ORDER BY t) AS i,
  CASE w WHEN 'plate' THEN left(t, -1) || 'is' WHEN 'ring' THEN left(t, -1) || '-g' WHEN 'bolt' THEN t || 'us' WHEN 'rod' THEN t || 'x' ELSE t END AS name FROM n)
SELECT name, CASE WHEN i = 1 THEN 'by hand' WHEN w NOT IN ('bolt', 'rod') THEN t END AS target, CASE WHEN i = 1 THEN 'hand' WHEN w IN ('plate', 'ring') THEN 'variant' WHEN w = 'bolt' THEN 'ambiguous' WHEN w = 'rod' THEN 'none' ELSE 'exact' END AS relation FROM c""")
def name_resolution(t: Tables):
    """Names with another gender's ending, a hyphen, an ending that two accepted names share, and no accepted name."""
    n = t.part.select(F.col("p_name").alias("name")).distinct()
    name = F.col("name")
    changed = n.select(
        F.when(name.endswith("plate"), F.regexp_replace(name, "e$", "is")).when(name.endswith("ring"), F.regexp_replace(name, "g$", "-g"))
        .when(name.endswith("bolt"), F.concat(name, F.lit("us"))).when(name.endswith("rod"), F.concat(name, F.lit("x"))).otherwise(name).alias("name")
    )
    more = n.where(name.endswith("bolt")).select(F.explode(F.array(F.concat(name, F.lit("a")), F.concat(name, F.lit("um")))).alias("name"))
    hand = n.orderBy("name").limit(1).select("name", F.lit("by hand").alias("target"))
    return nm.decided(changed, nm.candidates(changed, n.unionByName(more)), hand)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS w FROM part), s AS (SELECT name AS accepted, 'old ' || w AS target FROM n WHERE g < 'm'),
c AS (SELECT name, 'old ' || w AS target FROM n), b AS (SELECT name AS owner, name AS target FROM n UNION SELECT accepted, target FROM s)
SELECT c.name, c.target, coalesce(string_agg(owner, ',' ORDER BY owner), '') AS others FROM c LEFT JOIN b ON c.target = b.target AND owner <> c.name GROUP BY ALL""")
def owned_elsewhere(t: Tables):
    n = t.part.select(F.col("p_name").alias("name")).distinct()
    old = F.concat(F.lit("old "), F.substring_index("name", " ", -1))
    synonyms = n.where(F.substring_index("name", " ", 1) < "m").select(old.alias("name"), F.col("name").alias("accepted"))
    return nm.owned_elsewhere(n.select("name", old.alias("target")), n, synonyms).withColumn("others", F.array_join("others", ","))
