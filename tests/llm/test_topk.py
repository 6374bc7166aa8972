import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loam.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long"


def brute(rows, k, step):
    vs = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        q = [math.floor(64 * float(np.float32(x))) for x in v]
        vs[i] = min(vs.get(i, q), q)
    out = []
    for i, q in vs.items():
        if i % step == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, w)), j) for j, w in vs.items() if j != i))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def found(df, k, step):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % step == 0, k=k).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 4]], 0, 0, 0) for i in range(700)]
    rows += [(700 + i, rows[0][1], 0, 0, 0) for i in range(30)]  # ties
    rows += [(2000, None, 0, 0, 0), (2010, [None] * 16, 0, 0, 0), (2020, [float("nan")] * 16, 0, 0, 0), (2030, [float("inf")] * 16, 0, 0, 0), (None, [0.1] * 16, 0, 0, 0), (20, rows[20][1], 1, 1, 1)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 40)
    assert found(spark.createDataFrame(rows, SCHEMA), 20, 10) == brute(rows, 20, 10)


def test_few_rows_unequal_lengths_and_large_values(spark):
    rows = [(0, [1.0, 2.0], 0, 0, 0), (10, [], 0, 0, 0), (11, [3.0], 0, 0, 0), (12, [1e6, -1e6], 0, 0, 0), (20, [1e6, 5.0], 0, 0, 0)]
    padded = [(i, v + [0.0] * (2 - len(v)), *x) for i, v, *x in rows]
    assert found(spark.createDataFrame(rows, SCHEMA), 20, 10) == brute(padded, 20, 10)
    assert found(spark.createDataFrame(rows[:1], SCHEMA), 20, 10) == []
    assert found(spark.createDataFrame([], SCHEMA), 20, 10) == []


def packed(m):
    """The segments of one index block."""
    t = pa.table({"vec_id": pa.array(range(len(m)), pa.int64()), "v": pa.array(m.tolist(), pa.list_(pa.int64()))})
    block = topk._packed("index")((pa.scalar(0),), t).to_pylist()[0]
    return [np.frombuffer(x, np.int32) for x in block["segments"]]


def test_segments_hold_each_posting_once_by_descending_impact():
    m = np.random.default_rng(3).integers(-40, 40, (50, 8))
    segments = packed(m)
    seen = np.concatenate(segments)
    assert len(set(seen.tolist())) == len(seen)
    sizes = [np.abs(m).ravel()[x] for x in segments]
    assert all(a.min() > b.max() for a, b in zip(sizes, sizes[1:]) if len(a) and len(b))
    unseen = np.setdiff1d(np.arange(m.size), seen)
    assert np.abs(m).ravel()[unseen].max(initial=0) < max(1, np.sqrt((m**2.0).mean()) / 8)


def test_stops_on_proof_and_stays_exact():
    rng = np.random.default_rng(4)
    m = np.rint(rng.normal(0, 8, (3000, 32))).astype(np.int64)
    m[:40] *= 6  # long vectors, which hold the best scores
    q, q_ids = m[100:140], np.arange(100, 140)
    trace: list[int] = []
    got = topk.search_block(q_ids, q, np.arange(len(m)), m, packed(m), 5, trace)
    assert trace and max(trace) < len(topk.LEVELS)
    score = q @ m.T
    want = []
    for n, i in enumerate(q_ids):
        order = sorted((-int(x), j) for j, x in enumerate(score[n]) if j != i)[:5]
        want += [(int(i), j, -x) for x, j in order]
    assert [tuple(map(int, r)) for r in zip(*got)] == want
