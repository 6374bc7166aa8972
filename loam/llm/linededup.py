"""Line dedup by range-partitioned line hashes, as keep bitmaps (operator 9).

DataFrame operations only. Each line gives a row (hash of its key, document,
position). The rows are range-partitioned on all of these, so that a line which a
third of all documents holds spreads over many partitions, and are sorted within
each; runs of equal hashes then stream into one partial aggregate a partition (the
first occurrence, the number of documents), and only these meet. Verdicts go back
as bitmaps by document; the text is not shuffled to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, lower_ascii

#: Lines held by one number of a bitmap.
BITS = 60


def lines_of(text: Column) -> Column:
    """Lines of a text, split at \\n; null and empty texts have one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _keyed(docs: DataFrame) -> DataFrame:
    """_id, _th (hash of the text), n_lines and the lines' hash pairs by position; blank lines have none."""
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_th"), lines_of(text).alias("_lines"))
    rows = base.select("_id", "_th", F.posexplode("_lines").alias("pos", "line")).select("_id", "_th", "pos", line_key(F.col("line")).alias("key"))
    return rows.where(F.length("key") >= 1).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("\u0001"), "key").alias("h2"), "_id", "_th", "pos")


def drop_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """_id, _th, _n (lines dropped), _words: for each document that loses lines, a bitmap of the
    dropped ones: line p is bit p % 60 of _words[p div 60] (missing: 0).

    A line goes if documents with min_docs different ids hold its key (a null id counts
    as one id); with keep_first its first occurrence by (doc_id, position) stays.
    With min_docs = 1 and keep_first, repeats inside one document go too."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines, lines_at = scratch.write(_keyed(docs))  # hashed once; read twice
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, "h1", "h2", "_id", "_th", "pos").sortWithinPartitions("h1", "h2", "_id", "_th", "pos")
    # a key and document once, then a count of documents: both start inside the sorted partitions
    by_doc = dealt.groupBy("h1", "h2", "_id").agg(F.min(F.struct("_th", "pos")).alias("at"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "at")).alias("first")
    keys = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"), first)
    bad = keys.where((F.col("n_docs") >= min_docs) & (F.col("n") >= 2 if keep_first else F.lit(True)))
    bad = bad.select("h1", "h2", F.col("first._id").alias("f_id"), F.col("first.at._th").alias("f_th"), F.col("first.at.pos").alias("f_pos"))
    bad, bad_at = scratch.write(bad)  # a table, so that the join can split the rows of a frequent line
    hits = lines.join(bad, ["h1", "h2"])
    if keep_first:
        hits = hits.where(~(F.col("_id").eqNullSafe(F.col("f_id")) & (F.col("_th") == F.col("f_th")) & (F.col("pos") == F.col("f_pos"))))
    hits = hits.select("_id", "_th", "pos").distinct()  # rows of a table that repeat are one document here
    at = hits.groupBy("_id", "_th", F.expr(f"pos div {BITS}").cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, pos % {BITS}))").alias("bits"), F.count(F.lit(1)).alias("n"))
    packed = at.groupBy("_id", "_th").agg(F.sum("n").alias("_n"), F.max("w").alias("last"), F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    words = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    out = scratch.keep(packed.select("_id", "_th", "_n", words.alias("_words")))
    scratch.drop(lines_at)
    scratch.drop(bad_at)
    return out


def with_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with _n_lines, _n_dropped and _kept, the text of the lines that stay.

    The bitmaps grow with the documents and are larger in memory than their compressed file
    says, so they are never broadcast by estimate: the plan is the same at every size."""
    text = F.col("text").cast("string")
    base = docs.withColumns({"_lid": F.col("doc_id").cast("long"), "_lth": F.xxhash64(text)})
    joined = base.join(bitmaps.hint("merge"), F.col("_lid").eqNullSafe(F.col("_id")) & (F.col("_lth") == F.col("_th")), "left")
    lines = lines_of(text)
    bit = "shiftright(coalesce(try_element_at(_words, cast(i div {b} as int) + 1), 0L), cast(i % {b} as int)) & 1L".format(b=BITS)
    kept = F.when(F.col("_words").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.expr(f"array_join(filter(split(coalesce(cast(text as string), ''), '\\n', -1), (l, i) -> ({bit}) = 0L), '\\n')")
    )
    out = joined.withColumns({"_n_lines": F.size(lines).cast("long"), "_n_dropped": F.coalesce("_n", F.lit(0)).cast("long"), "_kept": kept})
    return out.drop("_lid", "_lth", "_id", "_th", "_n", "_words")


def line_dedup(docs: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, kept (the text left).

    docs needs doc_id and text. Null and empty texts have one empty line, which stays;
    blank lines always stay. Rows with the same doc_id and text are one document."""
    narrow = docs.select("doc_id", "text")
    return with_kept(narrow, drop_bitmaps(narrow, min_docs, keep_first)).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_kept").alias("kept"))
