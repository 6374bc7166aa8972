"""Relational queries: splits, samples, joins, votes, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions.hashing import bucket, md5_int
from loam.operators import relational as rel
from loam.operators import runs as run
from loam.operators import sampling as smp

from .registry import Tables, h, query

SEED = "loam"


@query(f"""SELECT DISTINCT user_id, CASE WHEN b < 2 THEN 'test' WHEN b < 4 THEN 'val' ELSE 'pool' END AS role
FROM (SELECT user_id, {h("user_id", seed=SEED)} % 20 AS b FROM events)""")
def split_roles(t: Tables):
    return smp.split_roles(t.events.select("user_id").distinct(), "user_id", SEED, {"test": 2, "val": 2}).select("user_id", "role")


_SAMPLE = f"""
WITH j AS (SELECT p_brand, o_custkey, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS tier,
  {h("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seed=SEED)} AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, o_custkey ORDER BY h, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rk_person FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rk_person > 1, tier, h, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rk FROM a)
SELECT p_brand, o_custkey, l_orderkey, l_partkey, l_linenumber, rk FROM b WHERE rk <= 40"""


@query(_SAMPLE)
def capped_diverse_sample(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    j = j.withColumn("tier", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    j = j.withColumn("h", md5_int("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seed=SEED))
    order = [F.col(c) for c in ("h", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")]
    j = j.select("p_brand", "o_custkey", "tier", *order)
    return smp.capped_diverse(j, "p_brand", "o_custkey", 1, 40, order, [F.col("tier")]).select("p_brand", "o_custkey", "l_orderkey", "l_partkey", "l_linenumber", "rk")


@query(f"""
WITH e AS (SELECT *, {h("event_id", seed=SEED)} AS h FROM events
           WHERE user_id NOT IN (SELECT user_id FROM events WHERE {h("user_id", seed=SEED)} % 20 < 4)),
r AS (SELECT *, count(*) OVER (PARTITION BY event_type, user_id) AS n_all, row_number() OVER (PARTITION BY event_type, user_id ORDER BY h, event_id) AS rk FROM e)
SELECT event_id, event_type, user_id, n_all, rk FROM r WHERE rk <= 2""")
def eval_sample_with_split_counts(t: Tables):
    held = t.events.where(bucket("user_id", n=20, seed=SEED) < 4).select("user_id").distinct()
    e = t.events.join(held, "user_id", "left_anti").withColumn("h", md5_int("event_id", seed=SEED))
    return smp.capped_with_counts(e, "event_type", "user_id", [F.col("h"), F.col("event_id")], 2).select("event_id", "event_type", "user_id", "n_all", "rk")


@query(f"""
WITH j AS (SELECT c_nationkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS n, {h("o_orderkey", seed=SEED)} AS h FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY h, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM j)
SELECT c_nationkey, o_orderkey, n, before FROM b WHERE n + before < 2000000""")
def budget_admission(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", F.round("o_totalprice").cast("bigint").alias("n"), md5_int("o_orderkey", seed=SEED).alias("h"))
    return smp.admit_by_budget(j, "c_nationkey", F.col("n"), [F.col("h"), F.col("o_orderkey")], 2000000).select("c_nationkey", "o_orderkey", "n", "before")


@query("""SELECT l_orderkey, (arg_min(l_partkey, l_linenumber * 10000000 + l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey""")
def first_per_order(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("l_partkey"))


@query("""SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1""")
def shared_items(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n")).where("parts > 1")


@query("""
WITH a AS (SELECT p_name AS k, max(p_brand) AS v FROM part GROUP BY 1), b AS (SELECT p_name AS k, max(p_type) AS v FROM part WHERE p_size < 10 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def override_map(t: Tables):
    a = t.part.groupBy(F.col("p_name").alias("k")).agg(F.max("p_brand").alias("v"))
    b = t.part.where("p_size < 10").groupBy(F.col("p_name").alias("k")).agg(F.max("p_type").alias("v"))
    return rel.override(a, b, "k", "v")


@query("""SELECT p_name AS k, arg_max(p_type, p_size * 1000 + ascii(p_type)) AS v FROM
(SELECT p_name, p_size, max(p_type) AS p_type FROM part GROUP BY ALL) GROUP BY p_name""")
def most_specific_level(t: Tables):
    return rel.most_specific(t.part.select(F.col("p_name").alias("k"), F.col("p_type").alias("v"), F.col("p_size").alias("lvl")), "k", "v", "lvl")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS undiscounted,
avg(CAST(l_tax > 0.04 AS INT)) AS taxed, CAST(sum(CASE WHEN l_shipdate >= TIMESTAMP '1995-01-01' THEN l_quantity ELSE 0 END) AS BIGINT) AS late_quantity, bool_or(l_quantity = 1) AS single
FROM lineitem GROUP BY ALL""")
def conditional_counts(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if(F.col("l_discount") == 0).alias("undiscounted"),
        F.avg((F.col("l_tax") > 0.04).cast("int")).alias("taxed"),
        F.sum(F.when(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), F.col("l_quantity")).otherwise(0.0)).cast("bigint").alias("late_quantity"),
        F.bool_or(F.col("l_quantity") == 1).alias("single"),
    )


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90, max(value) AS most FROM events GROUP BY event_type""")
def quantiles_per_class(t: Tables):
    q = lambda p: F.round(F.percentile("value", p), 6)
    return t.events.groupBy("event_type").agg(q(0.5).alias("q50"), q(0.9).alias("q90"), F.max("value").alias("most"))


@query("""
WITH done AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), new AS (SELECT event_id FROM events EXCEPT SELECT event_id FROM done)
SELECT event_id, user_id, TRUE AS old FROM done UNION ALL SELECT event_id, user_id, FALSE FROM events WHERE event_id IN (SELECT event_id FROM new)""")
def incremental_scan(t: Tables):
    e = t.events.select("event_id", "user_id", "ts")
    done = e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return rel.incremental(done.select("event_id", "user_id").withColumn("old", F.lit(True)), e.select("event_id", "user_id").withColumn("old", F.lit(False)), "event_id")


@query("""
WITH v AS (SELECT c_nationkey, c_mktsegment, count(*) AS votes FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, votes FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY votes DESC, c_mktsegment) AS rn FROM v) WHERE rn = 1""")
def majority_vote(t: Tables):
    return rel.majority(t.customer, "c_nationkey", "c_mktsegment")


@query("""SELECT label, min(embedding[1]) AS west, min(embedding[2]) AS south, max(embedding[1]) AS east, max(embedding[2]) AS north FROM embeddings GROUP BY label""")
def bbox_union(t: Tables):
    return rel.boxes(t.embeddings, "label", F.col("embedding")[0], F.col("embedding")[1])


@query("""SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) >= 6 AND count(DISTINCT p_brand) >= 24)""")
def generic_label_drop(t: Tables):
    generic = t.part.groupBy("p_name").agg(F.countDistinct("p_type").alias("a"), F.countDistinct("p_brand").alias("b")).where("a >= 6 and b >= 24").select("p_name")
    return t.part.join(generic, "p_name", "left_anti").select("p_partkey", "p_name")


@query("""WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS rk FROM n)
SELECT CASE WHEN rk <= 10 THEN p_brand ELSE 'other' END AS p_brand, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def top_and_other(t: Tables):
    return rel.top_and_other(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand", "n", 10)


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'segment' WHEN c_nationkey BETWEEN 0 AND 4 THEN 'box' END AS reason, count(*) AS n FROM customer GROUP BY 1""")
def drop_reasons(t: Tables):
    rules = [("debt", F.col("c_acctbal") < 0), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), ("box", F.col("c_nationkey").between(0, 4))]
    return rel.drop_reasons(t.customer, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
SELECT o_orderkey, k, p FROM o WHERE (p IS NULL OR p <= 50000) AND k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def null_handling(t: Tables):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("p"))
    bad = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return o.where(F.col("p").isNull() | (F.col("p") <= 50000)).where("k is not null").join(bad, "k", "left_anti").select("o_orderkey", "k", "p")


@query("""SELECT p_partkey, p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) AS small_brand, CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 30 THEN '10-29' ELSE '30+' END AS bucket FROM part""")
def projected_membership(t: Tables):
    small = t.part.where("p_size = 1").select("p_brand").distinct().withColumn("_s", F.lit(True))
    b = F.when(F.col("p_size") < 10, "<10").when(F.col("p_size") < 30, "10-29").otherwise("30+")
    return t.part.join(small, "p_brand", "left").select("p_partkey", F.col("_s").isNotNull().alias("small_brand"), b.alias("bucket"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS period, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders""")
def half_years(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.concat(F.year(d), F.lit("-H"), F.when(F.month(d) <= 6, 1).otherwise(2)).alias("period"), F.datediff(d, F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"))


@query("""SELECT s.s_nationkey AS nation, count(*) FILTER (WHERE c.n IS NOT NULL) AS with_customers, count(*) FILTER (WHERE c.n IS NULL) AS without, coalesce(sum(c.n), 0)::BIGINT AS customers
FROM supplier s LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.s_nationkey = c.c_nationkey GROUP BY 1""")
def left_join_counts(t: Tables):
    c = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = t.supplier.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return j.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count_if(F.col("n").isNotNull()).alias("with_customers"), F.count_if(F.col("n").isNull()).alias("without"), F.coalesce(F.sum("n"), F.lit(0)).alias("customers"))


@query("""
WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY i) AS run FROM b)
SELECT user_id, event_type, min(i) AS start, count(*) AS length FROM r GROUP BY user_id, run, event_type""")
def runs_rle(t: Tables):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return run.runs(t.events.select("user_id", "event_type", i.alias("i")), "user_id", "i", "event_type").select("user_id", "event_type", "start", "length")


@query("""WITH l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)
SELECT l_orderkey, i, q - coalesce(lag(q) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS delta, q AS value FROM l""")
def delta_roundtrip(t: Tables):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("bigint")
    d = run.deltas(t.lineitem.select("l_orderkey", F.col("l_quantity").cast("bigint").alias("q"), i.alias("i")), "l_orderkey", [F.col("i")], "q")
    return run.undelta(d, "l_orderkey", [F.col("i")]).select("l_orderkey", "i", "delta", "value")


@query("""
WITH o AS (SELECT user_id, event_type = 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS streak FROM o)
SELECT user_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM s WHERE hit GROUP BY user_id, streak HAVING count(*) >= 2""")
def gone_streak(t: Tables):
    s = run.streaks(t.events, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 2)
    return s.select("user_id", "n", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


@query("""SELECT p_brand, p_partkey, p_retailprice, rk FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY floor(p_retailprice / 50) DESC) AS rk FROM part) WHERE rk <= 5""")
def top_with_ties(t: Tables):
    return run.top_with_ties(t.part, "p_brand", [F.desc(F.floor(F.col("p_retailprice") / 50))], 5).select("p_brand", "p_partkey", "p_retailprice", F.col("rk").cast("bigint").alias("rk"))


@query(f"""SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY {h("o_custkey", seed=SEED)}, o_custkey) + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1000000 END AS rk FROM orders""")
def hashed_dense_rank(t: Tables):
    rk = F.dense_rank().over(Window.partitionBy("o_orderpriority").orderBy(md5_int("o_custkey", seed=SEED), "o_custkey"))
    return t.orders.select("o_custkey", "o_orderkey", (rk + F.when(F.col("o_orderstatus") == "F", 0).otherwise(1000000)).cast("bigint").alias("rk"))


@query("""SELECT l_returnflag, l_partkey, n, n / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)""")
def share_of_total(t: Tables):
    n = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")))


@query("""SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders
UNION SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3""")
def set_operations(t: Tables):
    k = lambda df, c: df.select(F.col(c).alias("k"))
    both = k(t.customer.where("c_acctbal > 5000"), "c_custkey").intersect(k(t.orders, "o_custkey"))
    return both.union(k(t.supplier, "s_suppkey")).distinct().subtract(k(t.customer.where("c_nationkey = 3"), "c_custkey"))


@query("""
WITH a AS (SELECT p_name AS key, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1), r AS (SELECT p_name AS key, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS rank FROM part WHERE p_size > 25)
SELECT r.key, p_partkey FROM r LEFT JOIN a ON r.key = a.key WHERE rank < greatest(0, 20 - coalesce(n, 0))""")
def capacity_fill(t: Tables):
    have = t.part.where("p_size <= 25").groupBy(F.col("p_name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return smp.capacity_fill(t.part.where("p_size > 25").select(F.col("p_name").alias("key"), "p_partkey"), "key", [F.col("p_partkey")], have, 20).select("key", "p_partkey")


@query(f"""WITH s AS (SELECT * FROM events WHERE {h("event_id", seed=SEED)} % 10 < 3), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, n / count(*) OVER (PARTITION BY s.event_type) AS weight FROM s JOIN n ON s.event_type = n.event_type""")
def inverse_sampling_weight(t: Tables):
    s = t.events.where(bucket("event_id", n=10, seed=SEED) < 3)
    return smp.inverse_weights(s, "event_type", t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))).select("event_id", "weight")


@query(f"""SELECT p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY {h("p_partkey", seed=SEED)}, p_partkey) AS rk FROM part)
WHERE rk <= greatest(1, ceil(n * 0.1::DOUBLE))""")
def stratified_fraction(t: Tables):
    return smp.stratified_fraction(t.part, "p_brand", 0.1, [md5_int("p_partkey", seed=SEED), F.col("p_partkey")]).select("p_partkey")


@query(f"""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {h("p_partkey", seed=SEED)}, p_partkey) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, unnest(range(0, CAST(floor((120 - rk) / n) AS BIGINT) + 1))::INTEGER AS turn FROM r WHERE rk <= 120""")
def balanced_draw(t: Tables):
    targets = smp.class_targets(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "balanced", 120)
    return smp.draw(t.part, "p_brand", targets, [md5_int("p_partkey", seed=SEED), F.col("p_partkey")]).select("p_partkey", "turn")


@query("""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM k WHERE r IN (SELECT CAST(floor(i * (SELECT count(*) FROM orders) / 16) AS BIGINT) FROM range(16) t(i)) OR r = n - 1""")
def even_spread(t: Tables):
    return smp.even_spread(t.orders, "o_orderkey", 16).select("o_orderkey")


@query("""WITH c AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS k, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS m FROM c)
SELECT p_name, p_brand FROM w WHERE k = 1 OR (n >= 5 AND m = 1)""")
def claim_collision(t: Tables):
    c = t.part.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return rel.claims(c, "p_name", "p_brand", F.col("n") >= 5).select("p_name", "p_brand")


@query("""WITH f AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name END AS own FROM supplier)
SELECT s.s_suppkey, coalesce(f.own, n.n_name, r.r_name) AS value, CASE WHEN f.own IS NOT NULL THEN 'own' WHEN n.n_name IS NOT NULL THEN 'nation' WHEN r.r_name IS NOT NULL THEN 'region' END AS source
FROM supplier s LEFT JOIN f ON s.s_suppkey = f.s_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT n2.n_nationkey, r_name FROM nation n2 JOIN region ON n2.n_regionkey = r_regionkey) r ON s.s_nationkey = r.n_nationkey""")
def fallback_chain(t: Tables):
    own = t.supplier.where("s_acctbal > 5000").select("s_suppkey", F.col("s_name").alias("value"))
    nation = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("value"))
    region = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("value"))
    return rel.fallback(t.supplier.select("s_suppkey", "s_nationkey"), [("own", own, "s_suppkey"), ("nation", nation, "s_nationkey"), ("region", region, "s_nationkey")], "value").select("s_suppkey", "value", "source")


@query("""WITH p AS (SELECT p_name || ' ' || p_size AS synonym, p_type AS target FROM part), u AS (SELECT synonym, min(target) AS target FROM p GROUP BY 1 HAVING count(DISTINCT target) = 1)
SELECT synonym, target FROM u WHERE target IN (SELECT DISTINCT p_type FROM part WHERE p_size = 1) AND synonym NOT IN (SELECT DISTINCT p_type FROM part)""")
def unique_synonyms(t: Tables):
    pairs = t.part.select(F.concat_ws(" ", "p_name", "p_size").alias("synonym"), F.col("p_type").alias("target"))
    return rel.unique_synonyms(pairs, t.part.where("p_size = 1").select(F.col("p_type").alias("name")).distinct())


@query("""WITH m AS (SELECT CASE WHEN p_size < 10 THEN p_brand END AS old, CASE WHEN p_size >= 5 THEN p_brand END AS new FROM part),
n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, n - (SELECT count(*) FROM m WHERE old = p_brand) + (SELECT count(*) FROM m WHERE new = p_brand) AS n FROM n""")
def relabelled_counts(t: Tables):
    m = t.part.select(F.when(F.col("p_size") < 10, F.col("p_brand")).alias("old"), F.when(F.col("p_size") >= 5, F.col("p_brand")).alias("new"))
    return rel.relabelled_counts(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), m, "p_brand")


@query("""WITH s AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS b FROM lineitem)
SELECT CAST(sum(b) + count(*) FILTER (WHERE b IS NULL) * round(avg(b)) AS BIGINT) AS total FROM s""")
def imputed_total(t: Tables):
    return rel.imputed_total(t.lineitem.select(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("bigint")).alias("b")), "b")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'present' WHEN o_orderstatus = 'F' THEN 'gone' ELSE 'left' END AS state FROM orders""")
def work_partition(t: Tables):
    key = lambda df, c: df.select(F.col(c).alias("o_orderkey"))
    return rel.work_partition(t.orders.select("o_orderkey"), key(t.lineitem.where("l_quantity > 45"), "l_orderkey"), key(t.orders.where("o_orderstatus = 'F'"), "o_orderkey"), "o_orderkey")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS strikes FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') >= 5""")
def strike_counter(t: Tables):
    return rel.strikes(t.events.select("user_id", (F.col("event_type") == "error").alias("failed")), "user_id", 5)


@query("""WITH p AS (SELECT DISTINCT r_name || '/' || n_name AS path, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT path, count(*) AS n FROM customer JOIN p ON c_nationkey = n_nationkey GROUP BY 1)
SELECT node, sum(n)::BIGINT AS total FROM (SELECT unnest(string_split(path, '/')) AS node, n FROM c) GROUP BY node""")
def subtree_rollup(t: Tables):
    p = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"))
    c = t.customer.join(p, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return rel.subtree_counts(c, "path", "n")


@query("""WITH q AS (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_linestatus, max(q) AS most, (SELECT count(*) FROM orders) AS orders, (SELECT max(o_totalprice) FROM orders) AS dearest FROM q GROUP BY 1""")
def scalar_subqueries(t: Tables):
    q = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("q")).groupBy("l_linestatus").agg(F.max("q").alias("most"))
    one = t.orders.agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest"))  # one row
    return q.crossJoin(F.broadcast(one))


@query("""SELECT p_brand, first_type, link FROM (SELECT p_brand, arg_min(p_type, p_partkey) AS first_type, arg_min(p_name, p_partkey) FILTER (WHERE p_size % 4 = 0) AS link FROM part GROUP BY 1)""")
def first_seen_units(t: Tables):
    u = t.part.select("p_brand", "p_partkey", F.col("p_type").alias("first_type"), F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise("").alias("link"))
    return rel.first_seen_units(u, "p_brand", "p_partkey", "link").select("p_brand", "first_type", "link")


@query(f"""WITH w AS (SELECT p_brand, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1), d AS (SELECT *, greatest(0.0::DOUBLE, 8 - w) AS debt, row_number() OVER (ORDER BY w DESC, p_brand) AS rk FROM w)
SELECT count(*) AS n, sum(CASE WHEN rk = 1 THEN w - (SELECT sum(debt) FROM d) ELSE greatest(w, 8) END) AS total FROM d""")
def minimum_widths(t: Tables):
    w = t.part.groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("w"))
    return rel.minimum_widths(w, F.col("w"), 8.0).agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("total"))


@query("""SELECT c_name, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def keep_first_by_key(t: Tables):
    return rel.keep_first(t.customer, ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_name", "c_custkey")


@query()
def round_robin_sample(t: Tables):
    """Sequential across classes; tested against a plain loop."""
    return smp.round_robin(t.events.select("event_id", "event_type", "user_id"), "event_type", "user_id", "event_id", 3, 60)
