import math
import random

from pyspark.sql import functions as F

from loam.llm import mixing

from .conftest import edge_rows


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, given = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            give = left * w[s] / total
            take = min(give, 2 * sizes[s] - target[s])
            target[s] += take
            given += take
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
        left -= given
        if given < 1e-12:
            break
    return target


def check(rows, df):
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    target = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r["size"] == words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is not None) == (r["taken"] > 0) and 0 <= (r["position"] or 0) <= 1
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert taken[s] == math.floor(t + 1e-9) or abs(taken[s] - t) <= 1
    order = [r["position"] for r in out if r["position"] is not None]
    assert order == sorted(order)
    return out


def test_edges(edge, none):
    first = check(edge_rows(), edge)
    again = mixing.mix(edge.repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0


def test_random_sources(spark):
    rng = random.Random(4)
    for _ in range(3):
        k = rng.choice([1, 2, 7])
        rows = [(i, "w " * rng.choice([0, 1, 3, 50]), "en", rng.choice([None, *"abcdefg"][: k + 1]), 1) for i in range(80)]
        check(rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_due_inverts_the_demand(spark):
    c = spark.range(0, 101).select((F.col("id") / 100.0).alias("t")).crossJoin(spark.createDataFrame([(-0.5,), (0.0,), (0.5,)], "s double"))
    demand = 1000.0 * (F.col("t") + F.col("s") * (F.col("t") * F.col("t") - F.col("t")))
    worst = c.select(F.abs(mixing.due(demand, F.lit(1000.0), F.col("s")) - F.col("t")).alias("e")).agg(F.max("e")).first()[0]
    assert worst < 1e-9


def test_every_pass_has_a_position(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert any(r.repeats == 2 for r in out)
    for r in out:
        assert len(r.positions) == r.repeats and r.positions == sorted(r.positions) and (r.positions or [None])[0] == r.position
    for source in "abc":  # words due by the end of the first pass and after it
        mine = [r for r in out if r.source == source]
        due = sorted((x, r.size) for r in mine for x in r.positions)
        slope = mixing.SLOPES["abc".index(source) % len(mixing.SLOPES)]
        upto = 0
        for x, n in due:  # the share of the target due at x: the rate 1 - slope + 2 * slope * x, integrated
            assert abs((1 - slope) * x + slope * x * x - upto / mine[0].target) < 1e-6
            upto += n


def test_repeated_rows_clashing_columns_and_many_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 7)
    rows = [(i % 40, "w " * (i % 5), "en", [None, "a", "b"][i % 3], 1) for i in range(120)] + [(7, "w w w", "en", "a", 1)] * 5 + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(rows, df)
    clash = df
    for c in ("target", "slope", "source_size", "size", "position", "_slot_", "weight", "cap", "level"):
        clash = clash.withColumn(c, F.lit(1))
    check(rows, clash)
