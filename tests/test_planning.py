from pyspark.sql import functions as F

from loam.functions import style as sty
from loam.operators import layout
from loam.operators import planning as pl
from loam.operators import sampling as smp
from loam.operators import scoring as sc


def test_style(spark):
    df = spark.createDataFrame([("size<120@15",), ("blank@12",), ("blank",), ("size<x@1",)], "s string")
    assert [tuple(r.p) if r.p else None for r in df.select(sty.prune_rule(F.col("s")).alias("p")).collect()] == [("size", 120, 15), ("blank", None, 12), ("blank", None, None), None]
    heads = spark.createDataFrame([(b"\xff\xd8\xff\xe0",), (b"PMTiles\x03",), (b"\x1f\x8b\x08",), (b"<html",)], "b binary")
    assert [r.k for r in heads.select(sty.content_kind(F.col("b")).alias("k")).collect()] == ["jpeg", "pmtiles", "gzip", None]
    urls = spark.createDataFrame([("https://a.example.com/x",), ("https://example.com.evil.org/",), ("http://example.com/",), (None,)], "u string")
    assert [r.a for r in urls.select(sty.allowed_host(F.col("u"), ["example.com"]).alias("a")).collect()] == [True, False, False, False]
    m = spark.createDataFrame([(7.0,), (23.0,), (0.4,), (1000.0,)], "m double")
    assert [round(r.b, 6) for r in m.select(sty.scale_bar(F.col("m")).alias("b")).collect()] == [5.0, 20.0, 0.2, 1000.0]


def test_layout():
    page = "Name: Blue Gum\nNotes\ntall tree\nnear the creek\n\nafter\nHeight"
    assert layout.labelled(page, ["Name", "Notes", "Height"]) == [("Name", "Blue Gum"), ("Notes", "tall tree near the creek"), ("Height", "after")]
    assert layout.joined_lines(["Site: on the", "northern slope (above", "Creek)", "Soil: clay"]) == ["Site: on the northern slope (above Creek)", "Soil: clay"]
    assert layout.name_line("Eucalyptus globulus - Blue Gum") == ("Eucalyptus globulus", "Blue Gum")
    assert layout.name_line("Blue Gum (Eucalyptus globulus)") == ("Eucalyptus globulus", "Blue Gum")
    assert layout.name_line("an unknown tree") == (None, "an unknown tree")


def test_chain_and_ranks(spark):
    spark.sparkContext.setCheckpointDir("/tmp/loam-tests")
    rec = spark.createDataFrame([(1, 5), (5, 9), (9, None), (20, 21), (21, 99)], "at long, next long")
    assert sorted((r.start, r["at"], r.step) for r in pl.chain(rec).collect()) == [(1, 1, 0), (1, 5, 1), (1, 9, 2), (20, 20, 0), (20, 21, 1)]
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    got = smp.global_rank(keys, "k", 16).collect()
    assert all(r["rank"] * 3 == r.k and r.n == 1000 for r in got)


def test_smoothing_keeps_the_sum_and_priors_sum_to_one(spark):
    g = spark.createDataFrame([(0, 0, 10), (5, 5, 2)], "row long, col long, n long")
    assert abs(pl.smoothed(g, 1.0).agg(F.sum("v")).first()[0] - 12) < 1e-9
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, None, None)], "id long, x double, y double")
    grid = spark.createDataFrame([(0, 0, 1, 3), (0, 1, 2, 1)], "row long, col long, key int, n long")
    codes = spark.createDataFrame([(0, 0, 0)], "row long, col long, code int")
    f = sc.class_frequency(spark.createDataFrame([(1,), (2,), (3,)], "cls int"), spark.createDataFrame([(1,), (1,)], "cls int"))
    out = sc.adaptive_prior(points, grid, codes, [(0.3, 0.5), (0.6, 1.0)], f, 0.5)
    sums = out.groupBy("id").agg(F.sum(F.exp("lp")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == 2 and all(abs(r.s - 1) < 1e-9 and r.n == 3 for r in sums)
