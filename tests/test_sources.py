import hashlib

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loam import sources as src
from loam import streaming as st
from loam.operators import runs as run
from loam.sources import codecs as co


def test_tsv_with_rejects(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tname\n1\ta "quoted\n2\tb\nx\tc\n')
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    good, bad = src.read_tsv(spark, str(tmp_path / "t.tsv"), schema)
    assert sorted(map(tuple, good.collect())) == [(1, 'a "quoted'), (2, "b")]
    assert [r._corrupt for r in bad.collect()] == ["x\tc"]


def test_staged_upserted_and_replaced(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for fresh in (False, False, True):
        assert src.staged(make, spark, f"{tmp_path}/s", fresh).count() == 3
    assert len(calls) == 2
    src.replace_table(spark.range(5), f"{tmp_path}/r")
    src.replace_table(spark.range(7), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 7
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, src.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_journal_pages_and_documents(spark):
    d = lambda b: hashlib.sha256(b).hexdigest()
    rec = [("j", 1, b"a", d(b"a")), ("j", 2, b"b", d(b"b")), ("j", 3, b"x", d(b"y")), ("j", 4, b"c", d(b"c"))]
    df = spark.createDataFrame(rec, "journal string, seq int, blob binary, digest string")
    assert [r.seq for r in src.valid_prefix(df, "journal", "seq").orderBy("seq").collect()] == [1, 2]
    pages = spark.createDataFrame([(0, 100), (1, 100), (2, 40)], "page int, n int")
    assert src.pages_complete(pages, "page", "n", 100, 200).first().ok is True
    assert src.pages_complete(pages.where("page <> 1"), "page", "n", 100, 10).first().ok is False
    doc = src.json_document(spark.createDataFrame([("g", 2, "b"), ("g", 1, "a")], "grp string, pos int, v string"), ["pos"], ["grp"]).first().json
    assert doc.index('"a"') < doc.index('"b"')
    lines = spark.createDataFrame([("f", 1, "1.2 Grassy heath"), ("f", 2, "text 3")], "file string, line int, value string")
    assert src.headings(lines).first().title == "Grassy heath"


def test_codecs(spark):
    df = spark.createDataFrame([([(2, 3, 4), (200, 1, 1), (300, 70000, 2)],)], "r array<struct<start: long, length: long, level: long>>")
    back = df.select(co.decode_runs(co.encode_runs("r")).alias("b")).first().b
    assert [tuple(x) for x in back] == [(2, 3, 4), (200, 1, 1), (300, 70000, 2)]
    assert co.varints(co.put_varint(300) + b"\x80") == [300]
    bits = spark.createDataFrame([([0, 9, 17],)], "c array<int>").select(co.bits(co.bitset("c")).alias("b")).first().b
    assert bits == [0, 9, 17]
    import struct

    raw = struct.pack("<II2I3I", 1, 2, 5, 9, 0, 1, 3) + struct.pack("<6H", 7, 2, 8, 1, 9, 4)
    got = spark.createDataFrame([(raw,)], "b binary").select(co.decode_count_grid("b").alias("g")).first().g
    assert [(c.cell, [tuple(p) for p in c.pairs]) for c in got] == [(5, [(7, 2)]), (9, [(8, 1), (9, 4)])]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", i, i % 5 in (1, 2, 3)) for i in range(20)] + [("b", i, i < 7) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, seq long, hit boolean")
    for n, part in enumerate((df.where("seq < 8"), df.where("seq >= 8"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = st.gone_streaks(stream, "k", "hit", 3).writeStream.format("memory").queryName("streaks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["k"], r["at"]) for r in spark.sql("select * from streaks").collect())
    batch = run.streaks(df, "k", [F.col("seq")], F.col("hit"), 3).collect()
    assert got == sorted((r.k, r["first"] - 1 + 2) for r in batch)
    out = f"{tmp_path}/out"
    q = stream.writeStream.foreachBatch(st.append_new(out, "seq")).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).select("seq").distinct().count() == spark.read.parquet(out).count() == 20
