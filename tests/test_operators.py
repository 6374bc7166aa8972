import random

import numpy as np
from pyspark.sql import functions as F

from loam.operators import catalog as cat
from loam.operators import dedup as dd
from loam.operators import graph
from loam.operators import metrics as met
from loam.operators import names as nm
from loam.operators import raster as ras
from loam.operators import relational as rel
from loam.operators import runs as run
from loam.operators import sampling as smp
from loam.operators import scoring as sc
from loam.operators import search as se
from loam.operators import spatial as sp


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_greedy_copies_stop_dropping_once_dropped(spark):
    v = {1: [1.0, 0.0], 2: [0.8, 0.6], 3: [0.28, 0.96]}  # 1-2 and 2-3 are near, 1-3 is not
    df = spark.createDataFrame([(i, 0, i, x) for i, x in v.items()], "id long, grp int, rank int, v array<double>")
    assert rows(dd.greedy_copies(df, 0.7), "id") == [(2,)]


def test_earlier_copies_drop_even_if_dropped(spark):
    df = spark.createDataFrame([(1, 0, 1, 0b0, 0), (2, 0, 2, 0b1, 0), (3, 0, 3, 0b11, 0), (4, 1, 4, 0b11, 0), (5, 0, 5, -1, 0)], "id long, cls int, rank int, p long, d long")
    assert rows(dd.earlier_copies(df, 1, 0), "id") == [(2, 1), (3, 2)]


def test_round_robin_against_a_loop(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("abc"), rng.randrange(5)) for i in range(80)]
    df = spark.createDataFrame(data, "id long, cls string, person int")
    got = {r.id for r in smp.round_robin(df, "cls", "person", "id", 3, 6).collect()}
    queues = {c: [r for r in data if r[1] == c] for c in "abc"}
    used, n, want = {}, dict.fromkeys("abc", 0), set()
    while queues:
        for c in sorted(queues):
            while queues[c]:
                i, _, p = queues[c].pop(0)
                if used.get(p, 0) < 3:
                    used[p] = used.get(p, 0) + 1
                    n[c] += 1
                    want.add(i)
                    break
            if not queues[c] or n[c] >= 6:
                del queues[c]
    assert got == want


def test_core_box_and_outline(spark):
    cells = [("A", r, c, 1.0) for r in range(3) for c in range(3)] + [("A", 9, 9, 1.0)]
    df = spark.createDataFrame(cells, "code string, row long, col long, weight double")
    assert rows(sp.core_box(df, 0.9), "code") == [("A", 0, 0, 2, 2)]
    ring = [c for c in cells if c[1:3] not in ((1, 1), (9, 9))]
    got = sp.dissolve(spark.createDataFrame(ring, df.schema).drop("weight")).collect()
    assert sorted(len(r.points) for r in got) == [5, 5]
    assert {tuple(p) for r in got for p in r.points} == {(0, 0), (3, 0), (3, 3), (0, 3), (1, 1), (2, 1), (2, 2), (1, 2)}


def test_points_in_polygons_with_holes_and_edges(spark):
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    polys = spark.createDataFrame([(1, [square(0, 10), square(4, 6)]), (2, [square(5, 20)])], "poly long, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 5.5, 5.5), (4, 30.0, 1.0), (5, 0.0, 5.0), (6, 15.0, 15.0)], "id long, x double, y double")
    assert rows(sp.point_in_polygon(points, polys, 3.0), "id") == [(1, 1), (2, 2), (3, 2), (5, 1), (6, 2)]


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(-43, -42), rng.uniform(146, 147)) for i in range(60)]
    df = spark.createDataFrame(a, "id long, lat double, lon double")
    right = df.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    km = lambda p, q: ((((q[2] - p[2]) * np.cos(np.radians((p[1] + q[1]) / 2)) * 111.32) ** 2) + ((q[1] - p[1]) * 110.57) ** 2) ** 0.5
    assert {(r.id, r.rid) for r in sp.radius_join(df, right, 15.0).collect()} == {(p[0], q[0]) for p in a for q in a if km(p, q) <= 15}
    assert sp.none_within(df, right, 1.0).count() == 0


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alike_polygons_and_places_are_tested_once(spark):
    ring = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0))]]
    polys = spark.createDataFrame([(k, ring) for k in (7, 3, 5)], "poly long, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 3.0, 3.0)], "id long, x double, y double")
    got = sp.point_in_polygon(points, polys, 1.0)
    assert rows(got, "id") == [(1, 3), (2, 3)]
    assert "Aggregate [rings" in optimized(got) and "Aggregate [x" in optimized(got)


def test_distances_are_those_of_distinct_places(spark):
    left = spark.createDataFrame([(1, -42.0, 147.0), (2, -42.0, 147.0), (3, -43.0, 147.0), (4, None, 147.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(8, -42.01, 147.0), (9, -42.01, 147.0), (9, -42.01, 147.0)], "rid long, rlat double, rlon double")
    got = sp.radius_join(left, right, 5.0)
    assert got.columns == ["id", "lat", "lon", "rid", "rlat", "rlon", "km"]
    assert sorted((r.id, r.rid) for r in got.collect()) == [(1, 8), (1, 9), (1, 9), (2, 8), (2, 9), (2, 9)]
    assert "Aggregate [lat" in optimized(got) and "Aggregate [rlat" in optimized(got)


def test_components_and_merges(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)], "a long, b long")
    got = dict(rows(graph.connected_components(e), "node"))
    assert set(got.values()) == {1, 100} and got[40] == 1
    merged = dict(rows(graph.merge_classes(e, spark.createDataFrame([(i, i % 7) for i in [*range(1, 41), 100, 101, 102]], "node long, n long")), "node"))
    assert merged[1] == 6 and merged[100] == 102
    stats = graph.component_stats(spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0), (2, 1, 3.0, 4.0, 4.0)], "node long, component long, area double, x double, y double"), "area", "x", "y").first()
    assert (stats.area, stats.cx, stats.largest) == (4.0, 3.0, 2)


def test_kmeans_farthest_and_condensed(spark):
    rng = np.random.default_rng(0)
    pts = [(i, i % 2, (np.eye(4)[(i % 2) * 2 + i // 2 % 2] + rng.normal(0, 0.05, 4)).tolist()) for i in range(80)]
    df = spark.createDataFrame(pts, "id long, cls int, v array<double>").withColumn("k", F.lit(2))
    bank = sc.kmeans_bank(df, "k").collect()
    assert sorted((r.cls, r.n) for r in bank) == [(0, 20), (0, 20), (1, 20), (1, 20)]
    pos = sc.farthest_first(df).collect()
    assert sorted(r.pos for r in pos if r.cls == 0) == list(range(40))
    assert 2 <= sc.condensed(df.select("id", "cls", "v")).count() <= 8


def test_scores_add_up(spark):
    head = spark.createDataFrame([(1, c, z) for c, z in enumerate((1.0, 2.0, 0.5))], "id long, cls int, z double")
    knn = head.select("id", "cls", F.lit(-1.0).alias("l"))
    lp = head.select("id", "cls", F.lit(-1.0).alias("lp"))
    out = sc.combined(head, knn, lp, 0.5, 0.5, 1.0).collect()
    assert abs(sum(np.exp(r.lp) for r in out) - 1) < 1e-9
    masked = sc.only_top(knn.withColumn("l", F.lit(0.0)), "l", head, 1, -12.0)
    assert sorted(r.l for r in masked.collect()) == [-12.0, -12.0, 0.0]
    one = spark.createDataFrame([(-1.0, -2.0)], "g double, l double").select(sc.out_of_set(F.col("g"), F.col("l"), 1.0).alias("p")).first().p
    assert abs(one - 0.5) < 1e-12


def test_risk_cap_and_descent(spark):
    f = spark.createDataFrame([("a", p / 100, p > 40) for p in range(100)] + [("b", p / 100, p > 5) for p in range(100)], "bucket string, p double, hit boolean")
    at, wrong = met.risk_capped(f, ["a", "b"], [i / 20 for i in range(20)], 0.05)
    assert wrong <= 0.05 and at["a"] > at["b"]
    best, top = met.coordinate_descent(lambda p: -((p["x"] - 2) ** 2) - (p["y"] - p["x"]) ** 2, {"x": 0, "y": 0}, {"x": [0, 1, 2, 3], "y": [0, 1, 2, 3]})
    assert top >= -2 and best["x"] in (1, 2)
    u = met.utility(spark.createDataFrame([("p", "species", True), ("p", "genus", True), ("p", "unsure", False), ("p", "species", False)], "part string, kind string, ok boolean"), "part", "kind", F.col("ok")).first()
    assert (u.utility, u.unsure, u.wrong) == (0.125, 0.25, 0.25)


def test_names_and_claims(spark):
    accepted = spark.createDataFrame([("Acacia sylvatica",), ("Acacia alba",), ("Poa rosea",), ("Poa brownii",), ("Poa smithiae",), ("Poa tasmanica",)], "name string")
    names = spark.createDataFrame([("Acacia sylvaticus",), ("Poa browni",), ("Poa smithae",), ("Poa tasmanensis",), ("Acacia alba",), ("Poa nova",), ("Poa manual",)], "name string")
    hand = spark.createDataFrame([("Poa manual", "Poa rosea")], "name string, target string")
    got = {r.name: (r.target, r.relation) for r in nm.decided(names, nm.candidates(names, accepted), hand).collect()}
    assert got == {
        "Acacia sylvaticus": ("Acacia sylvatica", "variant"), "Poa browni": ("Poa brownii", "variant"), "Poa smithae": ("Poa smithiae", "variant"), "Poa tasmanensis": (None, "none"),
        "Acacia alba": ("Acacia alba", "exact"), "Poa nova": (None, "none"), "Poa manual": ("Poa rosea", "hand"),
    }
    taxa = spark.createDataFrame([(1, "A b", None), (2, "A c", 1), (3, "A d", 1), (4, "E f", 4)], "id long, name string, accepted_id long")
    assert rows(nm.accepted_table(taxa), "id") == [(1, "A b", ["A c", "A d"]), (4, "E f", [])]
    swaps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string")
    spark.sparkContext.setCheckpointDir("/tmp/loam-tests")
    assert rows(rel.follow_swaps(swaps), "old") == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")]


def test_catalogue_pieces(spark):
    cards = spark.createDataFrame([(1, "k1", "p1", 0), (2, "k1", "p2", 1), (3, "k2", "p1", 3), (4, "k3", "p3", 2)], "pos int, key string, profile string, photos int")
    assert [r.key for r in cat.faces(cards, 5).collect()] == ["k3", "k1"]
    hits = spark.createDataFrame([(1, "area", 0.0, 1), (1, "dot", 5.0, 2), (1, "dot", 3.0, 3)], "tap int, kind string, dist double, id int")
    assert cat.first_hit(hits, ["dot", "area"]).first().id == 3
    reg = spark.createDataFrame([(1, "Poa alba", None, 2.0)], "ref int, botanical string, common string, height double")
    sheet = spark.createDataFrame([(1, "Acacia alba", "Wattle", 3.0), (2, "Poa x", "Grass", None)], "ref int, botanical string, common string, height double")
    facts, bad = cat.merged_facts(reg, sheet)
    assert rows(facts, "ref") == [(1, "Poa alba", None, 2.0), (2, "Poa x", "Grass", None)] and bad.count() == 1
    df = spark.createDataFrame([("tree", 10.0), ("small tree", 2.0), ("shrub", 0.4), (None, None), ("tree fern", 3.0)], "f string, h double")
    assert [r.s for r in df.select(cat.silhouette(F.col("f"), F.col("h")).alias("s")).collect()] == ["tree", "shrub", "low shrub", "other", "fern"]
    order = spark.createDataFrame([("10",), ("9",), ("A2",)], "r string").orderBy(*cat.ref_key(F.col("r")))
    assert [r.r for r in order.collect()] == ["9", "10", "A2"]
    s = spark.createDataFrame([(["rare", "Vulnerable here"],), (["nothing"],)], "n array<string>").select(cat.status(F.col("n")).alias("s")).collect()
    assert [r.s for r in s] == ["vulnerable", None]


def test_search_rules(spark):
    names = spark.createDataFrame(
        [(1, "Elizabeth Street", "Hobart", "road"), (2, "Elizabeth Town", "Meander", "place"), (3, "Elizabeth Street", "Hobart", "property"), (4, "Seven Mile Beach", "Clarence", "place"), (5, "Mount Wellington", "Hobart", "place"), (6, "Salamanca", "Hobart", "property")],
        "row_id long, name string, context string, kind string",
    )
    q = spark.createDataFrame([(1, "elizabeth st"), (2, "elizabeth"), (3, "7 mile beach"), (4, "mt wellington"), (5, "ellington"), (6, "x"), (7, "elizabeth hobart"), (8, "salamanca")], "query_id long, text string")
    got = {}
    for r in se.search(q, names).collect():
        got.setdefault(r.query_id, []).append((r.rk, r.row_id, float(r.score)))
    got = {k: [(i, s) for _, i, s in sorted(v)] for k, v in got.items()}
    assert got[1][0] == (1, 3 + 1 + 2 + 1) and 3 not in [i for i, _ in got[1]]
    assert got[2][0][0] == 2  # the place before the road of its name
    assert got[3][0][0] == 4 and got[4][0] == (5, 10.0) and got[5] == [(5, 0.5)] and 6 not in got
    assert [i for i, _ in got[7]] == [1] and got[8] == [(6, 4.5)]
    numbers = spark.createDataFrame([(1, 0, "10"), (1, 1, "12A"), (1, 2, "14"), (2, 0, "8")], "row_id long, pos int, number string")
    p = se.parsed(spark.createDataFrame([(1, "12 elizabeth st"), (2, "12a elizabeth st")], "query_id long, text string"))
    streets = names.where("row_id = 1")
    scores = se.token_scores(se.variants(p), se.token_index(streets), streets)
    assert [(r.number, r.exact) for r in se.address_hits(p, scores, numbers).orderBy("query_id").collect()] == [("12A", False), ("12A", True)]


def test_search_with_streets_and_addresses(spark):
    names = spark.createDataFrame(
        [(1, "Elizabeth Street", "Hobart", "road"), (2, "Salamanca", "Hobart", "property"), (3, "Old Salamancas", "Hobart", "place"), (4, "Pier Road", "Sorell", "property")],
        "row_id long, name string, context string, kind string",
    )
    streets = spark.createDataFrame([(1, "Elizabeth Street", "Hobart"), (2, "Elizabeth Street", "North Hobart"), (3, "Pier Road", "Sorell")], "row_id long, name string, context string")
    numbers = spark.createDataFrame([(1, 0, "10", 147.1, -42.1), (1, 1, "14", 147.2, -42.2), (2, 0, "12", 147.3, -42.3), (3, 0, "2", 147.4, -42.4), (3, 1, "4", 147.5, -42.6)], "row_id long, pos int, number string, x double, y double")
    q = spark.createDataFrame([(1, "elizabeth st"), (2, "elizabeth st north hobart"), (3, "12 elizabeth st"), (4, "pier road"), (5, "salamanca")], "query_id long, text string")
    got = {}
    for r in se.search(q, names, streets=streets, numbers=numbers).orderBy("query_id", "rk").collect():
        got.setdefault(r.query_id, []).append(r)
    assert [(r.source, r.row_id) for r in got[1]] == [("entry", 1)]  # the register's road; no twin, no other suburb
    assert [(r.source, r.row_id, r.meta) for r in got[2]] == [("street", 2, "Road · North Hobart")]
    # 3 + 1 + 2 for the words, 4 for the number, and 1 for an exact one or 2 / 100 less
    assert [(r.source, r.name, r.meta, float(r.score)) for r in got[3]] == [
        ("address", "12 Elizabeth Street", "Address · North Hobart", 11.0),
                ("address", "12 Elizabeth Street", "Address · Hobart · nearest: 10", 9.98),
        ("entry", "Elizabeth Street", None, 7.0),
    ]
    # a street is official and shown: its twin among the properties goes
    assert [(r.source, r.row_id, tuple(r.bounds)) for r in got[4]] == [("street", 3, (147.4, -42.6, 147.5, -42.4))]
    # "Old Salamancas" is hit by prefix and official, so the property is 2 lower
    assert [(r.row_id, float(r.score)) for r in got[5]] == [(2, 3 + 1 + 1 - 0.5 - 2), (3, 2.0)]


def test_a_substring_is_not_official(spark):
    names = spark.createDataFrame([(1, "Wells", "Hobart", "property"), (2, "Maxwells Hill", "Hobart", "place")], "row_id long, name string, context string, kind string")
    q = spark.createDataFrame([(1, "wells")], "query_id long, text string")
    assert [(r.row_id, float(r.score)) for r in se.search(q, names).orderBy("rk").collect()] == [(1, 4.5), (2, 0.5)]


def test_runs_round_trip(spark):
    df = spark.createDataFrame([("a", i, lv) for i, lv in ((1, 2), (2, 2), (4, 2), (5, 1), (6, 1))], "code string, i long, level int")
    r = run.runs(df, "code", "i", "level")
    assert sorted((x.start, x.length, x.level) for x in r.collect()) == [(1, 2, 2), (4, 1, 2), (5, 2, 1)]
    assert sorted((x["index"], x.level) for x in run.unrun(r).collect()) == [(1, 2), (2, 2), (4, 2), (5, 1), (6, 1)]
    assert smp.quota_scale([(100, 3), (4, 10)], 60) > 0


def test_tile_lookup_meets_only_runs_of_its_block(spark):
    runs = [(5, 1, "a"), (6, 70, "b"), (1048570, 20, "c"), (3000000, 1, "d")]
    directory = spark.createDataFrame(runs, "tile_id long, run_length long, digest string")
    ids = [4, 5, 5, 6, 75, 76, 1048569, 1048575, 1048576, 1048589, 1048590, 3000000]
    got = ras.tile_lookup(directory, spark.createDataFrame([(i,) for i in ids], "tile_id long"))
    assert sorted((r.tile_id, r.digest) for r in got.collect()) == [(i, d) for i in ids for f, n, d in runs if f <= i < f + n]
    assert "div 1048576" not in optimized(got)


def test_search_by_groups_of_names_that_read_alike(spark):
    rows_ = [(i, "Blue Gum", None, "place") for i in range(1, 41)] + [(50, "Blue Gum", "Track", "place"), (60, "Big Bluegum", "x", "road")]
    names = spark.createDataFrame(rows_, "row_id long, name string, context string, kind string")
    q = spark.createDataFrame([(1, "blue gum"), (2, "uegu"), (3, "lue")], "query_id long, text string")
    groups, members = se.grouped(names)
    assert sorted((r.row_id, r.n_rows) for r in groups.collect()) == [(1, 40), (50, 1), (60, 1)]
    assert sorted((r.group, r.row_id) for r in members.collect()) == [(1, i) for i in range(1, 41)] + [(50, 50), (60, 60)]
    p = se.parsed(q)
    hits = se.every_row(se.token_scores(se.variants(p), se.token_index(groups), groups), members)
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, se.token_scores(se.variants(p), se.token_index(names), names).collect()))
    got = {}
    for r in se.search(q, names, limit=30).collect():
        got.setdefault(r.query_id, []).append((r.rk, r.row_id))
    assert sorted(got[1]) == [(i, i) for i in range(1, 31)]
    assert got[2] == [(1, 60)] and sorted(got[3]) == [(1, 60)] + [(i + 1, i) for i in range(1, 30)]
