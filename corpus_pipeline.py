"""A pipeline from raw documents to an ordered training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontam, langid, linededup, mixing, neardup
from loam.llm.common import DOCUMENT_COLUMNS, Scratch, table

#: A document whose best language holds less than this share of its letters is of no language.
LEAST_SHARE = 0.5
#: Lines that so many documents hold stay in the first of them only.
LINE_DOCS = 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them) or without a main language go."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    named = langid.predict(docs, langid.fit(docs))
    return named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that LINE_DOCS documents or more hold stay in the first of them; documents that
    lose lines and have nothing but white space left go. n_chars is that of the new text."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    out = linededup.with_kept(docs, linededup.drop_bitmaps(docs, LINE_DOCS, keep_first=True))
    out = out.where((F.col("_n_dropped") == 0) | (F.length(linededup.line_key(F.translate("_kept", "\n", " "))) > 0))
    changed = F.col("_n_dropped") > 0
    new = {"text": F.when(changed, F.col("_kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.withColumns(new).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 4 over 5-word shingles, links verified at a similarity
    of 0.8) the document with the smallest id stays; null and empty texts are one group."""
    return neardup.near_dedup(docs.select(*DOCUMENT_COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean_documents(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their first passes, with size, source_size, target, taken, repeats,
    position and positions, one for each pass."""
    return mixing.mix(docs.select(*DOCUMENT_COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]
#: Language models and SimHash components are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = scratch.write(stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
