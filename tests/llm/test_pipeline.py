import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from loam.llm import decontam, langid, linededup

from .conftest import edge_rows, prose
from .test_decontam import brute as leaks
from .test_linededup import brute as lines
from .test_neardup import brute_kept


def folder(spark, tmp_path, rows, items):
    import random

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(3)
    items = [(i, prose(rng, 25)) for i in range(10)]
    rows = [r for r in edge_rows() if r[0] is not None and r[0] != 4] + [(4, *edge_rows()[3][1:])]
    rows += [(200 + i, prose(rng, 60) + " " + items[i][1] + " " + prose(rng, 20), "en", "q", 3) for i in range(5)]
    base = prose(rng, 200)
    rows += [(300 + i, base + f" end{i}", "en", "q", 3) for i in range(4)]
    sf = folder(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # language
    model = langid.fit(docs)
    keep = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= cp.LEAST_SHARE}
    now = {r[0]: r[1] for r in rows if r[0] in keep}
    assert all(re.search(r"[^\W\d_]", t) for t in now.values()) and {1, 2, 3} & keep == set()
    # lines
    after = {}
    for i, n, dropped, kept in lines(sorted(now.items()), cp.LINE_DOCS, True):
        if not dropped or kept.strip(" \t\n\x0b\x0c\r"):
            after[i] = kept if dropped else now[i]
    # near duplicates
    stay = brute_kept(list(after.items()))
    after = {i: t for i, t in after.items() if i in stay}
    # benchmark
    bad = {i for i, _ in leaks(list(after.items()), items)}
    after = {i: t for i, t in after.items() if i not in bad}
    assert len(bad) == 5
    got = cp.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == after
    assert all(r.n_chars == len(r.text) or r.text == dict((x[0], x[1]) for x in rows)[r.doc_id] for r in got)


def test_each_stage_on_edges_and_on_nothing(spark, tmp_path):
    sf = folder(spark, tmp_path, edge_rows(), [(1, "a b c d e f g")])
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("root", F.lit(1)).withColumn("words", F.lit("x"))
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert out.count() <= len(edge_rows())
        if name != cp.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert cp.STAGES[1][1](spark, docs, sf).count() == 28 and decontam and linededup
