"""Vector queries: neighbours, votes, priors, ladder, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import vector as vec
from loam.functions.hashing import bucket, md5_int
from loam.operators import dedup as dd
from loam.operators import metrics as met
from loam.operators import sampling as smp
from loam.operators import scoring as sc

from .registry import Tables, h, query

_SPLIT = h("vec_id", seed="knn") + " % 5"
_NEAR = f"""q AS (SELECT vec_id AS id, label AS y, embedding::DOUBLE[] AS v FROM embeddings WHERE {_SPLIT} = 0),
b AS (SELECT vec_id AS rid, label AS cls, embedding::DOUBLE[] AS v FROM embeddings WHERE {_SPLIT} <> 0),
d AS (SELECT id, y, rid, cls, list_dot_product(q.v, b.v) AS s FROM q CROSS JOIN b),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, rid) AS rk FROM d) WHERE rk <= 10)"""
_VOTE = f"""{_NEAR}, w AS (SELECT *, exp((s - max(s) OVER (PARTITION BY id)) / 0.1) AS w FROM nn), c AS (SELECT id, cls, sum(w) AS w FROM w GROUP BY ALL),
p AS (SELECT id, cls, w / sum(w) OVER (PARTITION BY id) AS p FROM c), k AS (SELECT DISTINCT cls FROM b),
vote AS (SELECT q.id, k.cls, ln((coalesce(p.p, 0) + 1e-6 / (SELECT count(*) FROM k)) / (1 + 1e-6)) AS l FROM q CROSS JOIN k LEFT JOIN p ON q.id = p.id AND k.cls = p.cls)"""
_PRED = f"""{_VOTE}, e AS (SELECT *, exp(l) AS ps, cls // 3 AS genus FROM vote), sp AS (SELECT id, cls, ps FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(ps, 9) DESC, cls) AS rn FROM e) WHERE rn = 1),
gn AS (SELECT id, genus, gp FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(gp, 9) DESC, genus) AS rn FROM (SELECT id, genus, sum(ps) AS gp FROM e GROUP BY ALL)) WHERE rn = 1)"""


def _split(t: Tables):
    e = t.embeddings.withColumn("b", bucket("vec_id", n=5, seed="knn"))
    q = e.where("b = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").alias("v"))
    bank = e.where("b <> 0").select(F.col("vec_id").alias("rid"), F.col("label").alias("cls"), F.col("embedding").alias("v"))
    return q, bank


def _vote(t: Tables):
    q, bank = _split(t)
    return q, bank, sc.vote(sc.nearest(q, bank, 10), bank.select("cls").distinct(), 0.1)


def _p(v):
    return v.select("id", "cls", F.round(F.exp("l"), 9).alias("p"))


@query(f"WITH {_NEAR} SELECT id, rid, rk::INTEGER AS rk, round(s, 6) AS s FROM nn")
def nearest_neighbours(t: Tables):
    q, bank = _split(t)
    return sc.nearest(q, bank, 10).select("id", "rid", "rk", F.round("s", 6).alias("s"))


@query(f"WITH {_VOTE} SELECT id, cls, round(l, 6) AS l FROM vote")
def knn_vote(t: Tables):
    return _vote(t)[2].withColumn("l", F.round("l", 6))


@query(f"""WITH {_PRED} SELECT sp.id, CASE WHEN ps >= 0.9 THEN 'species' WHEN gp >= 0.6 THEN 'genus' ELSE 'unsure' END AS kind,
CASE WHEN ps >= 0.9 THEN cls::VARCHAR WHEN gp >= 0.6 THEN genus::VARCHAR END AS label FROM sp JOIN gn ON sp.id = gn.id""")
def answer_ladder(t: Tables):
    _, bank, v = _vote(t)
    genus = bank.select("cls").distinct().withColumn("genus", F.expr("cls div 3"))
    return sc.ladder(_p(v), genus, F.lit(0.9), 0.6).select("id", "kind", "label")


def _predictions(t: Tables):
    q, _, v = _vote(t)
    best = _p(v).groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("n"), "cls")).alias("m")).select("id", F.col("m.cls").alias("cls"), (-F.col("m.n")).alias("p"))
    return best.join(q.select("id", "y"), "id").withColumn("hit", F.col("cls") == F.col("y"))


@query(f"""WITH {_PRED}, r AS (SELECT q.y, CAST(sp.cls = q.y AS INT) AS hit FROM sp JOIN q ON sp.id = q.id)
SELECT round(avg(hit), 6) AS natural, round((SELECT avg(a) FROM (SELECT avg(hit) AS a FROM r GROUP BY y)), 6) AS species FROM r""")
def species_vs_natural_accuracy(t: Tables):
    return met.accuracy(_predictions(t), F.col("hit"), "y").select(F.round("natural", 6).alias("natural"), F.round("species", 6).alias("species"))


@query(f"""WITH {_PRED}, r AS (SELECT round(ps, 9) AS c, CAST(sp.cls = q.y AS INT) AS hit FROM sp JOIN q ON sp.id = q.id),
bins AS (SELECT least(floor(c * 15), 14) AS bin, count(*) AS n, sum(c) AS c, sum(hit) AS h FROM r GROUP BY 1) SELECT round(sum(abs(c - h)) / sum(n), 6) AS ece FROM bins""")
def calibration_error(t: Tables):
    return met.calibration_error(_predictions(t), F.col("p"), F.col("hit")).select(F.round("ece", 6).alias("ece"))


_CENTRED = f"""m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))"""


@query(f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT vec_id, round(n, 6) AS norm, round(list_dot_product(v, list_reverse(v)) / (n * n), 6) AS mirror, round(list_max(list_transform(v, lambda x: abs(x))) / 127, 9) AS scale,
list_sum(list_transform(v, lambda x: round_even(x / (list_max(list_transform(v, lambda y: abs(y))) / 127), 0)))::BIGINT AS quantised FROM n""")
def vector_functions(t: Tables):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = t.embeddings.select("vec_id", v.alias("v")).withColumn("q", vec.quantise8(F.col("v")))
    return e.select(
        "vec_id", F.round(vec.norm(F.col("v")), 6).alias("norm"), F.round(vec.cosine(F.col("v"), F.reverse("v")), 6).alias("mirror"), F.round("q.scale", 9).alias("scale"),
        F.aggregate("q.values", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("quantised"),
    )


@query(f"""WITH x AS (SELECT label AS cls, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE {_SPLIT} <> 0), s AS (SELECT cls, i, sum(x) AS x FROM x GROUP BY ALL),
n AS (SELECT cls, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) SELECT s.cls, i::INTEGER AS i, round(x / n, 6) AS x FROM s JOIN n ON s.cls = n.cls""")
def class_prototypes(t: Tables):
    _, bank = _split(t)
    none = bank.limit(0).select("cls", "v")
    return sc.prototypes(bank, 0.0, none).select("cls", F.posexplode("v").alias("i", "x")).select("cls", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH k AS (SELECT DISTINCT label AS cls FROM embeddings), n AS (SELECT label AS cls, count(*) AS n FROM embeddings WHERE label < 8 GROUP BY 1)
SELECT k.cls, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER () AS f FROM k LEFT JOIN n ON k.cls = n.cls""")
def class_frequency(t: Tables):
    return sc.class_frequency(t.embeddings.select(F.col("label").alias("cls")).distinct(), t.embeddings.where("label < 8").select(F.col("label").alias("cls")))


@query(f"""WITH {_VOTE}, g AS (SELECT id, cls, exp(l) AS p, cls < 5 AS local FROM vote), o AS (SELECT id, sum(CASE WHEN NOT local THEN p ELSE 0 END) AS p_out FROM g GROUP BY 1),
z AS (SELECT id, cls, p / sum(p) OVER (PARTITION BY id) AS p FROM g WHERE local), l AS (SELECT z.id, cls, ln(greatest(1 - p_out, 1e-12)) + ln(z.p) AS lp FROM z JOIN o ON z.id = o.id),
f AS (SELECT g.id, g.cls, ln(greatest(p, 1e-12)) AS lp FROM g JOIN (SELECT id, max(lp) AS best FROM l GROUP BY 1) m ON g.id = m.id WHERE NOT local AND ln(greatest(p, 1e-12)) > best + 1)
SELECT id, cls, round(lp, 4) AS lp FROM (SELECT * FROM l UNION ALL SELECT * FROM f)""")
def hybrid_scores(t: Tables):
    v = _vote(t)[2].select("id", "cls", F.exp("l").alias("p"), (F.col("cls") < 5).alias("local"))
    own = v.where("local").withColumn("ls", F.ln(F.col("p") / F.sum("p").over(Window.partitionBy("id")))).select("id", "cls", "ls")
    return sc.hybrid(v, own, 1.0).withColumn("lp", F.round("lp", 4))


@query(f"""WITH {_VOTE}, x AS (SELECT cls, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM b), u AS (SELECT cls, list(x ORDER BY i) AS v FROM (SELECT cls, i, sum(x) AS x FROM x GROUP BY ALL) GROUP BY 1),
h AS (SELECT id, u.cls, 10 * list_dot_product(q.v, u.v) / sqrt(list_dot_product(u.v, u.v)) AS z FROM q CROSS JOIN u), f AS (SELECT cls, ln((count(*) + 1) / sum(count(*) + 1) OVER ()) AS f FROM b GROUP BY 1),
s AS (SELECT id, cls, z - ln(sum(exp(z)) OVER (PARTITION BY id)) AS z FROM h), wz AS (SELECT s.id, s.cls, z + 0.5 * greatest(l, -12) AS z FROM s JOIN vote ON s.id = vote.id AND s.cls = vote.cls),
n AS (SELECT id, cls, z - ln(sum(exp(z)) OVER (PARTITION BY id)) AS z FROM wz), cz AS (SELECT id, n.cls, (z + 0.3 * f) / 1.2::DOUBLE AS z FROM n JOIN f ON n.cls = f.cls)
SELECT id, cls, round(z - ln(sum(exp(z)) OVER (PARTITION BY id)), 6) AS lp FROM cz""")
def combined_scores(t: Tables):
    """Head, vote and prior, renormalised."""
    q, bank, v = _vote(t)
    protos = sc.prototypes(bank, 0.0, bank.limit(0).select("cls", "v")).withColumn("bias", F.lit(0.0))
    head = sc.head_scores(q, protos)
    freq = sc.class_frequency(bank.select("cls").distinct(), bank.select("cls"))
    lp = sc.prior(t.spark.createDataFrame([], "id long, key int, k double"), q.select("id"), freq, 1.0)
    return sc.combined(head.withColumn("z", F.col("z") * 10), v, lp, 0.5, 0.3, 1.2).withColumn("lp", F.round("lp", 6))


@query(f"""WITH {_VOTE}, x AS (SELECT id, cls, l, t FROM vote, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE]) AS t)), s AS (SELECT *, l / t - ln(sum(exp(l / t)) OVER (PARTITION BY id, t)) AS lp FROM x),
n AS (SELECT t, avg(-lp) AS nll FROM s JOIN q ON s.id = q.id AND s.cls = q.y GROUP BY t) SELECT t, round(nll, 6) AS nll FROM n ORDER BY nll LIMIT 1""")
def best_temperature(t: Tables):
    q, _, v = _vote(t)
    z = v.join(q.select("id", "y"), "id").select("id", "cls", F.col("l").alias("z"), (F.col("cls") == F.col("y")).alias("truth"), "y")
    return met.best_temperature(z, [0.5, 1.0, 2.0, 4.0]).select("t", F.round("nll", 6).alias("nll"))


@query()
def risk_capped_ladder(t: Tables):
    """Thresholds by class-size bucket such that at most 7 in 100 stated answers are wrong."""
    _, bank = _split(t)
    n = bank.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    f = _predictions(t).join(n, "cls").select(F.when(F.col("n") < 42, "small").otherwise("large").alias("bucket"), "p", "hit")
    at, wrong = met.risk_capped(f, ["small", "large"], [i / 20 for i in range(20)], 0.07)
    return t.spark.createDataFrame([(k, v, wrong) for k, v in sorted(at.items())], "bucket string, threshold double, wrong double")


@query("""WITH s AS (SELECT label % 3 AS bucket, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1), w AS (SELECT label % 3 AS bucket, count(*) AS n FROM embeddings GROUP BY 1)
SELECT s.bucket, (w.n / (SELECT sum(n) FROM w)) / (s.n / (SELECT sum(n) FROM s)) AS weight FROM s JOIN w ON s.bucket = w.bucket""")
def target_mix(t: Tables):
    n = lambda d: d.groupBy((F.col("label") % 3).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return met.target_mix(n(t.embeddings.where("vec_id % 2 = 0")), n(t.embeddings))


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS rid, a.label = b.label AS copy, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_transform(a.embedding[1:5], lambda x: x > 0) = list_transform(b.embedding[1:5], lambda x: x > 0))
SELECT id, rid, cos >= 0.3 OR (rid % 2 = 0 AND cos >= 0.2) AS ok FROM p""")
def embedding_confirm(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    # candidates: vectors of one label with the same signs in five components
    signs = F.array_join(F.transform(F.slice("embedding", 1, 5), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    e = t.embeddings.select("vec_id", "label", signs.alias("signs"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.signs") == F.col("b.signs")) & (F.col("a.vec_id") < F.col("b.vec_id"))).select(F.col("a.vec_id").alias("id"), F.col("b.vec_id").alias("rid"), (F.col("b.vec_id") % 2 == 0).alias("hashed"))
    c = dd.confirmed(pairs, v, 0.2, 0.3)
    rounded = F.round("cos", 9)
    return c.select("id", "rid", ((F.col("hashed") & (rounded >= 0.2)) | (rounded >= 0.3)).alias("ok"))


_HASHES = f"""i AS (SELECT doc_id AS id, lang AS cls, {h("text", seed="p")} % 4096 AS p, {h("text", seed="d")} % 4096 AS d FROM documents)"""


def _hashes(t: Tables):
    """Two 12-bit hashes of each text stand in for image hashes: copies agree, others come near by chance."""
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("cls"), F.col("doc_id").alias("rank"), (md5_int("text", seed="p") % 4096).alias("p"), (md5_int("text", seed="d") % 4096).alias("d"))


@query(f"""WITH {_HASHES}, c AS (SELECT a.id, min(b.id) AS of FROM i a JOIN i b ON a.cls = b.cls AND b.id < a.id AND bit_count(xor(a.p, b.p)) <= 1 AND bit_count(xor(a.d, b.d)) <= 1 GROUP BY a.id) SELECT id, of FROM c""")
def earlier_copies(t: Tables):
    return dd.earlier_copies(_hashes(t), 1, 1, 12)


@query(f"""WITH {_HASHES}, x AS (SELECT a.id, b.id AS rid, bit_count(xor(a.p, b.p)) + bit_count(xor(a.d, b.d)) AS s FROM i a JOIN i b ON a.id % 4 = 0 AND b.id % 4 <> 0 AND bit_count(xor(a.p, b.p)) <= 1 AND bit_count(xor(a.d, b.d)) <= 2)
SELECT id, rid, s::INTEGER AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, rid) AS rn FROM x) WHERE rn = 1""")
def hash_matches(t: Tables):
    i = _hashes(t)
    return dd.best_match(dd.hash_pairs(i.where("id % 4 = 0").select("id", "p", "d"), i.where("id % 4 <> 0").select(F.col("id").alias("rid"), "p", "d"), 1, 2, width=12))


@query(f"""WITH {_HASHES}, x AS (SELECT a.id, b.id AS rid, a.cls <> b.cls AS crossed FROM i a JOIN i b ON a.id <> b.id AND bit_count(xor(a.p, b.p)) <= 1 AND bit_count(xor(a.d, b.d)) <= 1),
t AS (SELECT DISTINCT id FROM x WHERE crossed), l AS (SELECT DISTINCT x.id FROM x WHERE NOT crossed AND rid < x.id)
SELECT i.id, CASE WHEN t.id IS NOT NULL THEN 'twin' WHEN l.id IS NOT NULL THEN 'copy' END AS reason FROM i LEFT JOIN t ON i.id = t.id LEFT JOIN l ON i.id = l.id""")
def dedup_reasons(t: Tables):
    i = _hashes(t)
    pairs = dd.hash_pairs(i.select("id", "p", "d"), i.select(F.col("id").alias("rid"), "p", "d"), 1, 1, width=12).where("id <> rid").select("id", "rid")
    return dd.reasons(i.select("id"), [("twin", dd.twins(i, pairs)), ("copy", dd.earlier_copies(i, 1, 1, 12))])


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
n AS (SELECT a.id, a.grp, a.i, coalesce(list(b.i) FILTER (WHERE b.i IS NOT NULL), []) AS near FROM e a LEFT JOIN e b ON a.grp = b.grp AND b.i < a.i AND list_dot_product(a.v, b.v) >= 0.3 GROUP BY ALL),
r AS (SELECT grp, 0::BIGINT AS i, []::BIGINT[] AS kept, NULL::BIGINT AS id, FALSE AS gone FROM e GROUP BY grp
  UNION ALL SELECT n.grp, n.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, n.i) END, n.id, list_has_any(kept, near) FROM r JOIN n ON n.grp = r.grp AND n.i = r.i + 1)
SELECT id FROM r WHERE gone""")
def greedy_dedup(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("vec_id").alias("rank"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return dd.greedy_copies(e, 0.3)


@query()
def kmeans_banks(t: Tables):
    e = t.embeddings.select(F.col("label").alias("cls"), F.col("embedding").alias("v"))
    n = e.groupBy("cls").agg(sc.prototype_counts(F.count(F.lit(1))).alias("k"))
    return sc.kmeans_bank(e.join(n, "cls"), "k").select("cls", "i", "n")


@query("""WITH e AS (SELECT vec_id AS id, label AS cls, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT cls, i, sum(x) AS x FROM (SELECT cls, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY ALL), m AS (SELECT cls, list(x ORDER BY i) AS m FROM s GROUP BY cls),
c AS (SELECT id, e.cls, list_dot_product(v, m) / sqrt(list_dot_product(m, m)) AS cos FROM e JOIN m ON e.cls = m.cls)
SELECT id, cls, (rn - 1)::INTEGER AS near, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY cos DESC, id) AS rn FROM c) WHERE rn <= 20""")
def nearest_to_mean(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("embedding").alias("v"))
    return sc.nearest_to_mean(rows, 20).withColumn("cos", F.round("cos", 6))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, label AS cls, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
s AS (SELECT a.cls, a.id, a.i, list(list_dot_product(a.v, b.v) ORDER BY b.i) AS s FROM e a JOIN e b ON a.cls = b.cls GROUP BY ALL),
o AS (SELECT cls, i, row_number() OVER (PARTITION BY cls ORDER BY list_sum(s) DESC, i) AS rn FROM s),
r AS (SELECT s.cls, 0 AS pos, s.i, s.id, list_transform(s.s, lambda x, j: CASE WHEN j = s.i THEN 'inf'::DOUBLE ELSE x END) AS near FROM s JOIN o ON o.cls = s.cls AND o.i = s.i AND rn = 1
  UNION ALL SELECT s.cls, pos + 1, s.i, s.id, list_transform(near, lambda x, j: CASE WHEN j = s.i THEN 'inf'::DOUBLE ELSE greatest(x, s.s[j]) END) FROM r JOIN s ON s.cls = r.cls AND s.i = list_position(near, list_min(near)) WHERE list_min(near) < 'inf'::DOUBLE)
SELECT id, cls, pos FROM r""")
def farthest_first(t: Tables):
    return sc.farthest_first(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("embedding").alias("v")))


@query(f"""WITH {_PRED}, r AS (SELECT q.id, CAST(sp.cls = q.y AS INT) - CAST(q.id % 2 = 0 AS INT) AS d FROM sp JOIN q ON sp.id = q.id), g AS (SELECT list(g) AS g FROM (SELECT sum(exp(-1) / factorial(k::INT)) OVER (ORDER BY k) AS g FROM range(0, 8) t(k))),
rw AS (SELECT rep, d, len(list_filter(g, lambda x: ({h("id", "rep", seed="boot")} + 0.5) / 4294967296 >= x)) AS w FROM r, g, range(1, 201) t(rep)), m AS (SELECT rep, sum(w * d) / sum(w)::DOUBLE AS d FROM rw GROUP BY 1)
SELECT round(avg(d), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM m""")
def paired_bootstrap(t: Tables):
    p = _predictions(t).withColumn("other", F.col("id") % 2 == 0)
    return met.paired_bootstrap(p, "id", F.col("hit"), F.col("other")).select(*[F.round(c, 6).alias(c) for c in ("diff", "low", "high")])


@query(f"""SELECT k.i::INTEGER AS fold, count(*) AS n FROM (SELECT {h("user_id", seed="fold")} % 5 AS i FROM events) k GROUP BY 1""")
def folds(t: Tables):
    return t.events.groupBy(bucket("user_id", n=5, seed="fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT sum(n) AS s, sum(sqrt(n)) AS r FROM c) SELECT label, CAST(round_even(s * sqrt(n) / r, 0) AS BIGINT) AS target FROM c, t""")
def class_targets(t: Tables):
    return smp.class_targets(t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sqrt").select("label", "target")


@query("""WITH n AS (SELECT event_type, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, event_id, -(event_id % 10) / 10.0::DOUBLE AS cost, event_id % 100 = 0 AS cur FROM events WINDOW w AS (PARTITION BY event_type)),
s AS (SELECT *, cost + z AS s FROM n), b AS (SELECT event_type, event_id, s, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, event_id) AS rn FROM s), c AS (SELECT event_type, event_id, s, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, event_id) AS rn FROM s WHERE cur)
SELECT b.event_type, CASE WHEN b.s - c.s < 0.5 THEN c.event_id ELSE b.event_id END AS id, coalesce(b.s - c.s < 0.5, FALSE) AS kept FROM b LEFT JOIN c ON b.event_type = c.event_type AND c.rn = 1 WHERE b.rn = 1""")
def zscore_rank_with_margin(t: Tables):
    from loam.operators.catalog import zscore_choice

    e = t.events.withColumn("id", F.col("event_id"))
    return zscore_choice(e, "event_type", -(F.col("event_id") % 10) / 10.0, "value", F.col("event_id") % 100 == 0, 0.5)
