"""Search queries: part names as places, brands and types as context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import search as se

from .registry import Tables, query

_KIND = "CASE WHEN p_size % 5 = 0 THEN 'property' WHEN p_size % 5 = 1 THEN 'road' WHEN p_size % 5 = 2 THEN 'transport' ELSE 'place' END"


def names(t: Tables):
    return t.part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("context"), F.expr(_KIND).alias("kind"))


def typed(t: Tables):
    """Full names, first words, prefixes, swapped words, a name and its type, an infix: from the names themselves."""
    n = t.part.select("p_name", "p_type").groupBy("p_name").agg(F.min("p_type").alias("ty"))
    n = n.withColumn("i", F.row_number().over(Window.orderBy("p_name")))
    w = F.split("p_name", " ")
    forms = F.array(F.col("p_name"), F.element_at(w, 1), F.substring("p_name", 1, 3), F.concat_ws(" ", F.element_at(w, -1), F.element_at(w, 1)), F.concat_ws(" ", F.element_at(w, 1), F.col("ty")), F.substring("p_name", 2, 4), F.lit("x"))
    return n.select("i", F.posexplode(forms).alias("f", "text")).select((F.col("i") * 10 + F.col("f")).cast("bigint").alias("query_id"), "text")


_TYPED = """n AS (SELECT p_name, min(p_type) AS ty, row_number() OVER (ORDER BY p_name) AS i FROM part GROUP BY p_name),
t AS (SELECT i, ty, p_name, string_split(p_name, ' ') AS w FROM n),
q0 AS (SELECT i * 10 AS query_id, p_name AS text FROM t UNION ALL SELECT i * 10 + 1, w[1] FROM t UNION ALL SELECT i * 10 + 2, substr(p_name, 1, 3) FROM t UNION ALL SELECT i * 10 + 3, w[-1] || ' ' || w[1] FROM t
  UNION ALL SELECT i * 10 + 4, w[1] || ' ' || ty FROM t UNION ALL SELECT i * 10 + 5, substr(p_name, 2, 4) FROM t UNION ALL SELECT i * 10 + 6, 'x' FROM t),
q AS MATERIALIZED (SELECT query_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM q0 WHERE length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) >= 2),
nt AS MATERIALIZED (SELECT p_partkey AS row_id, unnest(string_split(norm, ' ')) AS token, unnest(range(len(string_split(norm, ' ')))) AS pos FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part)),
ct AS (SELECT p_partkey AS row_id, unnest(string_split(norm, ' ')) AS token FROM (SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part)),
w AS MATERIALIZED (SELECT query_id, norm, unnest(string_split(norm, ' ')) AS word, unnest(range(len(string_split(norm, ' ')))) AS qi, len(string_split(norm, ' ')) AS n FROM q),
a AS (SELECT query_id, row_id, qi, max(CASE WHEN word = token THEN 3 ELSE 2 END + CASE WHEN qi = 0 AND pos = 0 THEN 1 ELSE 0 END) AS s FROM w JOIN nt ON starts_with(token, word) GROUP BY ALL),
b AS (SELECT DISTINCT query_id, row_id, qi FROM w JOIN ct ON starts_with(token, word)),
m AS MATERIALIZED (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.qi, b.qi) AS qi, coalesce(a.s, 1) AS s FROM a FULL JOIN b ON a.query_id = b.query_id AND a.row_id = b.row_id AND a.qi = b.qi),
g AS (SELECT query_id, row_id, s FROM (SELECT m.query_id, m.row_id, sum(s) AS s, count(*) AS c FROM m GROUP BY ALL) JOIN (SELECT DISTINCT query_id AS k, n FROM w) ON query_id = k WHERE c = n),
h AS MATERIALIZED (SELECT g.query_id, row_id, p_name, KIND AS kind, g.s + CASE WHEN KIND = 'property' THEN CASE WHEN lower(p_name) = q.norm THEN 0.5 ELSE -0.5 END
   ELSE CASE WHEN lower(p_name) = q.norm THEN 3 ELSE 0 END + CASE WHEN KIND IN ('road', 'transport') THEN -1 ELSE 0 END END AS score
  FROM g JOIN part ON row_id = p_partkey JOIN q ON g.query_id = q.query_id)""".replace("KIND", _KIND)


@query(f"""WITH {_TYPED} SELECT query_id, row_id, kind, score::DOUBLE AS score FROM h""")
def token_search(t: Tables):
    q = se.parsed(typed(t))
    n, members = se.grouped(names(t))
    return se.every_row(se.place_hits(q, se.token_scores(se.variants(q), se.token_index(n), n), n), members).select("query_id", "row_id", "kind", F.col("score").cast("double").alias("score"))


_SUBSTRING = """hc AS (SELECT query_id AS hq, count(*) AS hits FROM h GROUP BY 1), o AS (SELECT query_id FROM q LEFT JOIN hc ON hq = query_id WHERE coalesce(hits, 0) < 30 AND len(list_filter(string_split(norm, ' '), lambda x: length(x) >= 3)) > 0),
v AS MATERIALIZED (SELECT DISTINCT token FROM nt), sw AS MATERIALIZED (SELECT DISTINCT w.query_id, n, qi, token FROM w JOIN o ON w.query_id = o.query_id JOIN v ON contains(token, word)),
x AS MATERIALIZED (SELECT query_id, row_id, n FROM sw JOIN nt ON sw.token = nt.token GROUP BY ALL HAVING count(DISTINCT qi) = n),
sub AS MATERIALIZED (SELECT query_id, row_id, 0.5::DOUBLE AS score FROM x ANTI JOIN h ON h.query_id = x.query_id AND h.row_id = x.row_id)"""


@query(f"""WITH {_TYPED}, {_SUBSTRING} SELECT query_id, row_id, score FROM sub""")
def substring_tier(t: Tables):
    q = se.parsed(typed(t))
    n, members = se.grouped(names(t))
    hits = se.place_hits(q, se.token_scores(se.variants(q), se.token_index(n), n), n).join(n.select("row_id", "n_rows"), "row_id")
    return se.every_row(se.substring_hits(q, n, hits), members).select("query_id", "row_id", F.col("score").cast("double").alias("score"))


@query(f"""WITH {_TYPED}, {_SUBSTRING}, u AS (SELECT query_id, row_id, score::DOUBLE AS score, TRUE AS whole FROM h UNION ALL SELECT query_id, row_id, score, FALSE FROM sub),
k AS (SELECT query_id, row_id, p_name AS name, {_KIND} = 'property' AS prop, lower(p_name) || '|' || lower(p_type || ' ' || p_brand) AS key, score, whole FROM u JOIN part ON row_id = p_partkey),
d AS (SELECT query_id, row_id, name, score - CASE WHEN prop AND bool_or(whole AND NOT prop) OVER (PARTITION BY query_id) THEN 2 ELSE 0 END AS score, prop, bool_or(NOT prop) OVER (PARTITION BY query_id, key) AS twin FROM k)
SELECT query_id, rk::INTEGER AS rk, row_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, row_id) AS rk FROM d WHERE NOT (prop AND twin)) WHERE rk <= 30""")
def search_results(t: Tables):
    """The whole search: tiers, demotion, twins, top 30."""
    return se.search(typed(t), names(t))


@query("""WITH s AS (SELECT DISTINCT p_brand, p_size FROM part), q AS (SELECT unnest(range(1, 60, 4)) AS want),
c AS (SELECT p_brand, want, p_size, abs(p_size - want) AS d, row_number() OVER (PARTITION BY p_brand, want ORDER BY abs(p_size - want), p_size) AS rn FROM s CROSS JOIN q)
SELECT p_brand, want, p_size AS number, d = 0 AS exact, CASE WHEN d = 0 THEN 5 ELSE 4 - least(0.9::DOUBLE, d / 100) END::DOUBLE AS score FROM c WHERE rn = 1""")
def nearest_number(t: Tables):
    s = t.part.select("p_brand", "p_size").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size")))
    q = t.spark.range(1, 60, 4).select(F.col("id").alias("query_id"), F.col("id").cast("string").alias("number"))
    scores = q.select("query_id").crossJoin(F.broadcast(t.part.select(F.col("p_brand").alias("row_id")).distinct())).withColumn("score", F.lit(0))  # 15 numbers by 25 brands
    hit = se.address_hits(q, scores, s.select(F.col("p_brand").alias("row_id"), "pos", F.col("p_size").cast("string").alias("number")))
    return hit.select(F.col("row_id").alias("p_brand"), F.col("query_id").alias("want"), F.col("number").cast("int").alias("number"), "exact", F.col("score").cast("double").alias("score"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS a FROM events) WHERE a = 1 ORDER BY event_id DESC LIMIT 8""")
def recent_picks(t: Tables):
    p = t.events.select(F.col("event_id").alias("seq"), F.concat_ws(":", "user_id", "event_type").alias("id"), F.col("user_id").alias("name"), F.col("event_type").alias("meta"))
    return se.recent(p).select(F.col("seq").alias("event_id"), F.col("name").alias("user_id"), F.col("meta").alias("event_type"))
