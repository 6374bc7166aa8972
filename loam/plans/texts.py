"""Queries over text: HTML, licences, heights, duplicates, labels, conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.functions.hashing import hamming
from loam.operators import dedup as dd
from loam.operators import graph
from loam.operators import relational as rel

from .registry import Tables, query


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(t: Tables):
    return t.pages.select("page_id", tx.html_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, starts_with(url, 'https://') AS secure, ends_with(url, '.html') AS html_page FROM pages""")
def url_parts(t: Tables):
    u = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"), u.startswith("https://").alias("secure"), u.endswith(".html").alias("html_page"))


@query(r"""
WITH l AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS t FROM documents),
c AS (SELECT doc_id, regexp_extract(t, '(?:cc[ -]|/licenses/|creative commons.*?)(by(?:[ -](?:nc|nd|sa)){0,2})\b', 1) AS cc, regexp_extract(t, '([1-4]\.[0-9])', 1) AS v, regexp_matches(t, 'cc ?-?0|public domain|/zero/') AS zero FROM l)
SELECT doc_id, CASE WHEN zero THEN 'cc0' WHEN v <> '' THEN 'cc-' || replace(cc, ' ', '-') || '-' || v ELSE 'cc-' || replace(cc, ' ', '-') END AS code, count(*) AS n FROM c WHERE zero OR cc <> '' GROUP BY ALL""")
def licence_normalise(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.select("doc_id", tx.licence_code(F.col("t")).alias("code")).where("code is not null").groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_size, p_size::DOUBLE * 0.01::DOUBLE AS low, (p_size + 10)::DOUBLE * 0.01::DOUBLE AS high FROM (SELECT DISTINCT p_size FROM part) WHERE p_size > 0""")
def height_parse(t: Tables):
    h = tx.height(F.concat(F.col("p_size"), F.lit("–"), F.col("p_size") + 10, F.lit(" cm tall")))
    return t.part.select("p_size").distinct().withColumn("h", h).where("h is not null").select("p_size", F.col("h.min").alias("low"), F.col("h.max").alias("high"))


@query(r"""SELECT DISTINCT p_name, trim(regexp_replace(lower(replace(strip_accents(p_name), '''', '')), '[^a-z0-9]+', ' ', 'g')) AS norm, split_part(p_name, ' ', 1) AS first,
regexp_replace('(ABC) ' || p_name, '^\([A-Z]{3}\)\s*', '') AS bare, trim(split_part(p_name || ' > ' || p_type, '>', 1)) AS top FROM part""")
def name_forms(t: Tables):
    n = F.col("p_name")
    return t.part.select(n, tx.normalise(n).alias("norm"), F.split_part(n, F.lit(" "), F.lit(1)).alias("first"), tx.code_prefix_stripped(F.concat(F.lit("(ABC) "), n)).alias("bare"), tx.top_of_hierarchy(F.concat_ws(" > ", n, "p_type")).alias("top")).distinct()


@query("""WITH k AS (SELECT DISTINCT (o_orderkey % 20000) / 1000.0::DOUBLE AS km FROM orders)
SELECT km, CASE WHEN km < 0.95 THEN greatest(50, CAST(floor(km * 20 + 0.5) AS BIGINT) * 50) || ' m'
WHEN km < 10 THEN CAST(floor(floor(km * 10 + 0.5) / 10) AS BIGINT) || '.' || CAST(floor(km * 10 + 0.5) AS BIGINT) % 10 || ' km' ELSE CAST(floor(km + 0.5) AS BIGINT) || ' km' END AS text FROM k""")
def distance_texts(t: Tables):
    return t.orders.select((F.col("o_orderkey") % 20000 / 1000.0).alias("km")).distinct().withColumn("text", tx.distance_text(F.col("km")))


@query("""SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, avg(quality) AS quality, avg(toxic) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def label_join_quality(t: Tables):
    j = t.documents.select("doc_id", "source").join(t.labels.withColumn("l", F.lit(1)), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("l").alias("labelled"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


@query("""WITH g AS (SELECT sha256(text) AS h, source, lang, doc_id FROM documents), b AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT source) > 1)
SELECT doc_id FROM g WHERE h NOT IN (SELECT h FROM b)""")
def whole_component_drop(t: Tables):
    return dd.drop_mixed_groups(t.documents.select("doc_id", "text", "source"), "text", "source").select("doc_id")


@query("""WITH s AS (SELECT text, count(DISTINCT lang) > 1 AS several FROM documents GROUP BY text), m AS (SELECT d.*, several FROM documents d JOIN s ON d.text = s.text),
b AS (SELECT source FROM (SELECT DISTINCT source, text, several FROM m) GROUP BY source HAVING avg(several::INT) > 0.01)
SELECT doc_id, source FROM m WHERE NOT several AND source NOT IN (SELECT source FROM b)""")
def provider_drop(t: Tables):
    d = t.documents.select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"))
    return rel.multi_label(d, "digest", "lang", "source", 0.01).select("doc_id", "source")


@query("""SELECT digest, n, labels FROM (SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS labels FROM documents GROUP BY 1) WHERE n > 1""")
def copies_by_source(t: Tables):
    return dd.exact_groups(t.documents, "text", "source").where("n > 1")


@query("""SELECT a.doc_id AS id, b.doc_id AS rid FROM documents a JOIN documents b ON a.text = b.text AND (a.lang <> b.lang OR a.source <> b.source) AND a.doc_id < b.doc_id""")
def cross_class_twins(t: Tables):
    d = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("g"))
    a, b = d.alias("a"), d.alias("b")
    differ = (F.col("a.lang") != F.col("b.lang")) | (F.col("a.source") != F.col("b.source"))
    return a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.doc_id") < F.col("b.doc_id"))).where(differ).select(F.col("a.doc_id").alias("id"), F.col("b.doc_id").alias("rid"))


_BITS = ", ".join(f"sum((p{b // 32} >> {b % 32}) & 1) * 2 > count(*) AS b{b}" for b in range(64))
_PACK = "[" + ", ".join(f"b{b}::INT" for b in range(64)) + "]"


@query(rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents),
p AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS p0, ('0x' || substr(md5(w), 9, 8))::BIGINT AS p1 FROM w WHERE w <> ''),
h AS (SELECT doc_id, {_BITS} FROM p GROUP BY doc_id), k AS (SELECT doc_id, {_PACK} AS h FROM h), r AS (SELECT h, min(doc_id) AS id FROM k GROUP BY h)
SELECT a.id, b.id AS rid, list_sum(list_transform(list_zip(a.h, b.h), lambda x: (x[1] <> x[2])::INT))::INTEGER AS d FROM r a JOIN r b ON a.id < b.id
WHERE list_sum(list_transform(list_zip(a.h, b.h), lambda x: (x[1] <> x[2])::INT)) <= 6""")
def hamming_near_dups(t: Tables):
    """Links between different hashes, each for its first document; by seven bands, then all bits."""
    hashed = dd.simhash(t.documents, "doc_id", F.split(F.lower("text"), r"\s+")).groupBy("h").agg(F.min("doc_id").alias("id"))
    k = hashed.withColumn("k", F.explode(dd.bands("h", 6)))
    a, b = k.alias("a"), k.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("rid"), hamming(F.col("a.h"), F.col("b.h")).alias("d"))
    return pairs.where("d <= 6").distinct()


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT conv_id, turn, role, row_number() OVER w + CASE WHEN role = 'user' THEN 0 ELSE 100 END AS place, length(text) - coalesce(lag(length(text)) OVER w, 0) AS delta,
sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_windows(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return t.conversations.select(
        "conv_id", "turn", "role", (F.row_number().over(w) + F.when(F.col("role") == "user", 0).otherwise(100)).cast("bigint").alias("place"),
        (n - F.coalesce(F.lag(n).over(w), F.lit(0))).cast("bigint").alias("delta"), F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )


_COMPONENTS = """m AS (SELECT l_orderkey, min(l_partkey) AS a FROM lineitem GROUP BY 1),
e AS (SELECT DISTINCT a, l_partkey AS b FROM lineitem JOIN m USING (l_orderkey) WHERE a <> l_partkey),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM s GROUP BY a
  UNION SELECT s.b, min(r.c) FROM r JOIN s ON r.node = s.a JOIN recurring.r AS k ON k.node = s.b WHERE r.c < k.c GROUP BY s.b)"""


@query(f"""WITH RECURSIVE {_COMPONENTS} SELECT node, c AS component FROM r""")
def connected_components(t: Tables):
    return graph.connected_components(_edges(t))


def _edges(t: Tables):
    """Parts of one order: each linked to the smallest, which connects the same as all pairs would."""
    l = t.lineitem.select("l_orderkey", "l_partkey")
    least = l.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    return l.join(least, "l_orderkey").where("a <> l_partkey").select("a", F.col("l_partkey").alias("b")).distinct()


@query(f"""WITH RECURSIVE {_COMPONENTS},
k AS (SELECT node, c AS component FROM r), z AS (SELECT k.*, p_size AS n FROM k JOIN part ON node = p_partkey),
o AS (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY n DESC, node) AS rn FROM z)
SELECT z.node, o.node AS into FROM z JOIN o ON z.component = o.component AND rn = 1""")
def class_merge(t: Tables):
    return graph.merge_classes(_edges(t), t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("n")))


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def eval_contamination(t: Tables):
    """Whole items in documents: joined on each item's longest word, then compared."""
    spaced = lambda c: F.array_distinct(F.split(c, r"[^\p{L}]+"))
    longest = F.element_at(F.array_sort(F.transform(F.slice(F.split("text", r"[^\p{L}]+"), 2, F.greatest(F.size(F.split("text", r"[^\p{L}]+")) - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    items = t.benchmark.select("item_id", F.col("text").alias("item"), longest.alias("w"))
    words = t.documents.select("doc_id", F.explode(spaced(F.col("text"))).alias("w"))
    pairs = words.join(items, "w").select("item_id", "item", "doc_id")  # the texts come to the pairs, not to the words
    return pairs.join(t.documents.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id").distinct()


@query(r"""WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, text, i, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^[-*•]\s') THEN 'bullet' WHEN length(s) < 50 AND s[-1] IN ('.', '!', '?') THEN 'end' ELSE 'text' END AS k FROM (SELECT doc_id, text, i, trim(l, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS s FROM l)),
p AS (SELECT doc_id, text, k, coalesce(lag(k) OVER (PARTITION BY doc_id, text ORDER BY i), 'blank') AS p FROM k)
SELECT doc_id, CAST(count(*) FILTER (WHERE k = 'bullet' OR k <> 'blank' AND p IN ('blank', 'end')) AS INTEGER) AS n FROM p GROUP BY doc_id, text""")
def reflowed_paragraphs(t: Tables):
    return t.documents.select("doc_id", F.size(tx.paragraphs("text")).alias("n"))


@query("""SELECT DISTINCT p_name, list_aggregate(list_transform(string_split(lower(trim(p_name)), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM part""")
def title_names(t: Tables):
    return t.part.select("p_name").distinct().withColumn("title", tx.smart_title("p_name"))


@query()
def similar_names(t: Tables):
    """Pairs of part names that share a word, by Ratcliff-Obershelp."""
    n = t.part.select("p_name").distinct()
    w = n.withColumn("w", F.explode(F.split("p_name", " ")))
    a, b = w.alias("a"), w.alias("b")
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.p_name") < F.col("b.p_name"))).select(F.col("a.p_name").alias("x"), F.col("b.p_name").alias("y")).distinct()
    return pairs.withColumn("s", tx.similarity("x", "y")).where("s >= 0.6")
