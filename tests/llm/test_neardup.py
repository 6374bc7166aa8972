import random
from itertools import combinations

import corpus_pipeline as cp
import numpy as np

from loam.llm import neardup as m

from .conftest import edge_rows, prose


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    """Ids that stay of rows with different ids: the smallest of each component of the links."""
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, brute_shingles(t)) for i, t in rows]
    for (i, a), (j, b) in combinations(sets, 2):
        if brute_jaccard(a, b) >= 0.8:
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i for i in root if root[i] == i}


def altered(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = "zq" + rng.choice("abcdefgh") * rng.randrange(1, 4)
    return " ".join(w)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 120)
    rows = list(enumerate([altered(rng, base, rng.randrange(1, 14)) for _ in range(150)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert 3 < len(want) < 140
    for texts, size in ((256, 8 << 20), (7, 8 << 20), (256, 5000)):
        monkeypatch.setattr(m, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(m, "BLOCK_BYTES", size)
        assert {r.doc_id for r in m.near_dedup(df).collect()} == want


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 300))).astype(np.uint64) for _ in range(20)]
    for columns in (1 << 15, 64):
        monkeypatch.setattr(m, "COLUMNS", columns)
        got = m.shared_counts(sets)
        assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_fingerprints_of_shingles():
    rng = np.random.default_rng(4)
    hashes, sizes = rng.integers(0, 1 << 63, 900, dtype=np.uint64), [0, 1, 2, 300, 0, 597]
    got = m.fingerprints_of(hashes, np.cumsum(sizes))
    at = 0
    for n, fp in zip(sizes, got.tolist(), strict=True):
        mine = hashes[at : at + n].tolist()
        assert fp == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in mine) * 2 > n)
        at += n


def test_planted_near_copies(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(60):  # pairs on both sides of 0.8, with several changed words
        n = rng.choice([12, 60, 200, 400])
        base = prose(rng, n)
        rows += [base, altered(rng, base, rng.randrange(1, max(2, n // 25)))]
    base = prose(rng, 300)
    rows += [altered(rng, base, 3) for _ in range(40)]  # a large group
    rows += [r[1] for r in edge_rows() if r[0] is not None]
    rows += ["one two three", "One  TWO three\n", "one two four", "", " ", None]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    sims = [brute_jaccard(brute_shingles(a), brute_shingles(b)) for (_, a), (_, b) in combinations(rows, 2)]
    assert sum(0.8 <= s < 1 for s in sims) > 40 and sum(0.6 <= s < 0.8 for s in sims) > 10
    df = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [r.doc_id for r in cp.near_dedup(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_shingles_across_texts():
    texts = ["A b c d e f", "", "x", "a B c d e", "a b c"]
    raw = "".join(texts).encode()
    h, upto = m.Shingles().split(np.frombuffer(raw, np.uint8), np.cumsum([len(t) for t in texts]))
    assert np.diff(upto, prepend=0).tolist() == [2, 0, 1, 1, 1]
    assert h[0] == h[3] and len(set(h.tolist())) == 4


def test_edges_of_near_dedup(edge, none):
    got = m.near_dedup(edge).collect()
    assert m.near_dedup(none).count() == 0
    assert {4, 7, 8, 9, 10, 11} <= {r.doc_id for r in got} and not {5, 6} & {r.doc_id for r in got}
    assert sum(not (r.text or "").strip() for r in got) == 1


def test_no_table_that_grows_is_broadcast(spark, edge, monkeypatch):
    plans, write = [], m.Scratch.write
    monkeypatch.setattr(m.Scratch, "write", lambda self, df: plans.append(df) or write(self, df))
    plans.append(m.near_dedup(edge))
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
