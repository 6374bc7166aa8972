import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loam.llm import simhash as s
from loam.llm.components import components
from loam.llm.common import Scratch

from .conftest import edge_rows


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """rows: id, fingerprint. The smallest id that links reach, by fingerprint."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    best = {}
    for i, f in rows:
        r = find(f)
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return {f: best.get(find(f)) for f in prints}


def test_texts(spark, edge, none):
    rows = edge_rows()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    comp = brute_components(prints)
    want = sorted(((i, f, comp[f]) for i, f in prints), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in s.simhash_groups(edge).collect()), key=str)
    assert got == want
    assert s.simhash_groups(none).count() == 0


def test_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    prints = set()
    for _ in range(150):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):  # chains of near ones
            prints.add(f)
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)}  # one dense group
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    want = brute_components(rows)
    for size in (4096, 16):
        monkeypatch.setattr(s, "BUCKET_ROWS", size)
        scratch = Scratch(spark, "test")
        got = {r.node % (1 << 64): r.root for r in components(scratch.keep(s.link_fingerprints(df)), scratch).collect()}
        groups = {}
        for _, f in rows:
            groups.setdefault(got.get(f, f), []).append(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, _by(want)))


def _by(labels):
    out = {}
    for f, c in labels.items():
        out.setdefault(c, []).append(f)
    return out.values()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    g = f.copy()
    for _ in range(3):
        g ^= np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)
    (ra, ka), (rb, kb) = s.keys_of(f), s.keys_of(g)
    assert set(range(len(f))) == {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))}


def test_components_of_a_long_path_and_a_star(spark):
    scratch = Scratch(spark, "test")
    e = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b")))
    got = {}
    for r in components(e, scratch).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [400, 400]
    assert components(e.limit(0), scratch).count() == 0


def test_long_texts_in_parts():
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(70_000))
    assert s.fingerprint(text.encode()) == brute_fingerprint(text)


def test_no_table_that_grows_is_broadcast(spark, edge, monkeypatch):
    plans, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: plans.append(df) or write(self, df))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    plans.append(s.simhash_groups(edge))
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
