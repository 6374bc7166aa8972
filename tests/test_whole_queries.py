"""Queries without SQL read all of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from loam.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_adaptive_prior_scores_every_point(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    assert {r.id for r in queries()["adaptive_prior"](spark, DATA).select("id").distinct().collect()} == ids


def test_labelled_sections_reads_every_turn_whole(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = queries()["labelled_sections"](spark, DATA).collect()
    assert {r.page for r in got} == {f"{r.conv_id}/{r.turn}" for r in turns.select("conv_id", "turn").collect()}
    longest = turns.agg(F.max(F.length(F.split("text", "\n")[0]))).first()[0]
    assert max(len(r.value or "") for r in got if r.label == "Notes") >= min(longest, 51) > 50


def test_similar_names_against_all_pairs(spark):
    from difflib import SequenceMatcher

    names = sorted({r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_name").collect()})
    want = set()
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            ratio = SequenceMatcher(None, x, y, autojunk=False).ratio()
            if set(x.split()) & set(y.split()) and ratio >= 0.6:
                want.add((x, y, round(ratio, 9)))
    assert {(r.x, r.y, round(r.s, 9)) for r in queries()["similar_names"](spark, DATA).collect()} == want and want


def test_dissolved_cells_have_the_corners_of_their_cells(spark):
    """Around a grid point, one or three cells of a code make a corner, two that meet diagonally make two."""
    cells = {}
    for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_orderstatus").collect():
        row, col = r.o_orderkey * 31 % 97 // 3, r.o_orderkey * 17 % 89 // 3
        if r.o_orderkey % 11 and (row * 7 + col * 5) % 3:
            cells.setdefault(r.o_orderstatus, set()).add((row, col))
    got = {}
    for r in queries()["dissolved_cells"](spark, DATA).collect():
        got[r.code] = got.get(r.code, 0) + r.corners - 1  # a ring's first point ends it too
    for code, own in cells.items():
        corners = 0
        for row, col in {(a + i, b + j) for a, b in own for i in (0, 1) for j in (0, 1)}:
            nw, ne, sw, se = ((row + i, col + j) in own for i, j in ((-1, -1), (-1, 0), (0, -1), (0, 0)))
            corners += {1: 1, 3: 1, 2: 2 if nw == se else 0}.get(nw + ne + sw + se, 0)
        assert got[code] == corners
    assert set(got) == set(cells)


def test_round_robin_sample_against_a_loop(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type", "user_id").orderBy("event_id").collect()
    queues, used, taken = {}, {}, {}
    for r in rows:
        queues.setdefault(r.event_type, []).append(r)
    want, open_ = set(), sorted(queues)
    while open_:
        for kind in list(open_):
            pick = next((r for r in queues[kind] if used.get(r.user_id, 0) < 3), None)
            if pick is None:
                open_.remove(kind)
                continue
            queues[kind] = queues[kind][queues[kind].index(pick) + 1 :]
            used[pick.user_id] = used.get(pick.user_id, 0) + 1
            want.add(pick.event_id)
            taken[kind] = taken.get(kind, 0) + 1
            if taken[kind] >= 60:
                open_.remove(kind)
    assert {r.event_id for r in queries()["round_robin_sample"](spark, DATA).collect()} == want


def test_kmeans_banks_partition_each_class(spark):
    n = {r.label: r["count"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").groupBy("label").count().collect()}
    got = {}
    for r in queries()["kmeans_banks"](spark, DATA).collect():
        got.setdefault(r.cls, []).append((r.i, r.n))
    for label, count in n.items():
        k = 1 if count < 20 else 2 if count < 100 else 4 if count < 500 else 8
        assert sorted(i for i, _ in got[label]) == list(range(k)) and sum(m for _, m in got[label]) == count


def test_risk_capped_ladder_keeps_the_cap(spark):
    from loam.plans import scores
    from loam.plans.registry import Tables

    out = queries()["risk_capped_ladder"](spark, DATA).collect()
    at = {r.bucket: r.threshold for r in out}
    t = Tables(spark, DATA)
    n = {r.cls: r.n for r in scores._split(t)[1].groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    stated = [p for p in scores._predictions(t).collect() if p.p >= at["small" if n[p.cls] < 42 else "large"]]
    wrong = sum(not p.hit for p in stated) / max(1, len(stated))
    assert wrong == pytest.approx(out[0].wrong) and wrong <= 0.07
