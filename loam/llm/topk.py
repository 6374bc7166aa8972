"""Exact top-k by inner product over an impact-ordered index (operator 1).

Vectors become integers, floor(scale * x). The index holds, for each block of
vectors, posting segments: the postings (vector, dimension, sign) whose absolute
value, the impact, falls in one quantised level. A block of queries processes a
block's segments by descending impact, score at a time. What a vector's unseen
postings can still add is at most |q| times the length of its unseen part, so a
pair is settled as soon as its upper bound lies below the k-th best lower bound;
scoring stops once few enough pairs are open, or postings are. The open ones are
then rescored exactly from the whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column

#: Rows of an index block and of a query block at most; query blocks are cut smaller (down to
#: LEAST_ROWS) until there are TASKS pairs of blocks; pairs of rows scored at once.
BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS, TASKS, SCORED_AT_ONCE = 32768, 8192, 128, 16, 1 << 21
#: Impacts from these up, in units of a block's root mean square, make a level; what lies below the last counts as unseen.
LEVELS = (1.0, 0.5, 0.25, 0.125)
_EXACT_IN_FLOAT64 = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (array<long>). Rows without id, null vectors and vectors that hold a
    null, NaN or infinity are left out; rows that share an id count once, as the
    smallest vector."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull()).where(fine).select("vec_id", x.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(v: pa.Array) -> np.ndarray:
    """Rows of integers, shorter vectors filled with zeros."""
    flat, lengths = np.asarray(v.flatten()), np.asarray(pa.compute.list_value_length(v))
    out = np.zeros((len(v), int(lengths.max(initial=0))), np.int64)
    if lengths.size and (lengths == out.shape[1]).all():
        return flat.reshape(out.shape)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _packed(kind: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        """One row for a block: ids, the vectors and, for an index block, the segments."""
        t = t.sort_by("vec_id").combine_chunks()
        m, ids = _matrix(t["v"].chunk(0)), t["vec_id"].to_numpy()
        peak = int(np.abs(m).max(initial=0))
        m = m.astype(np.int8 if peak < 128 else np.int16 if peak < 32768 else np.int64)
        segments = []
        if kind == "index":  # a posting is its place among the block's components; the value stands there
            size, above = np.abs(m.astype(np.int64)).ravel(), math.inf
            root = math.sqrt(float((size.astype(np.float64) ** 2).mean())) if size.size else 0.0
            for level in (max(1.0, share * root) for share in LEVELS):
                segments.append(np.flatnonzero((size >= level) & (size < above)).astype(np.int32).tobytes())
                above = level
        cols = {"block": [key[0].as_py()], "ids": [ids.tobytes()], "dims": [m.shape[1]], "width": [m.dtype.itemsize], "rows": [m.tobytes()]}
        if kind == "index":
            cols["segments"] = [segments]
        return pa.table({n: pa.array(c, pa.list_(pa.binary()) if n == "segments" else None) for n, c in cols.items()})

    return run


_PACKED = "block long, ids binary, dims long, width long, rows binary"


def _unpack(r: dict, p: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r[p + "ids"], np.int64)
    kind = {1: np.int8, 2: np.int16, 8: np.int64}[r[p + "width"]]
    return ids, np.frombuffer(r[p + "rows"], kind).reshape(len(ids), r[p + "dims"]).astype(np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, segments: list[np.ndarray], k: int, trace: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block for each query: query_id, vec_id, score. Exact. trace gets the
    number of segments that each group of queries processed."""
    dims = max(q.shape[1], m.shape[1])
    places = [np.divmod(s, max(1, m.shape[1])) for s in segments]
    q, m = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, m))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(dims, 1) < _EXACT_IN_FLOAT64
    kind = np.float32 if exact and float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(dims, 1) < 1 << 24 else np.float64
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = {int(i): n for n, i in enumerate(ids)}
    left, parts = (m.astype(np.float64) ** 2).sum(1), []
    for row, dim in places:  # a segment as rows, and the length of what it leaves unseen
        part, value = np.zeros(m.shape, kind), m[row, dim]
        part[row, dim] = value
        left = left - np.bincount(row, value.astype(np.float64) ** 2, len(m))
        parts.append((part.T, np.sqrt(np.maximum(left, 0)) * (1 + 1e-6)))
    step = max(1, SCORED_AT_ONCE // max(len(m), 1))
    for at in range(0, len(q), step):
        qs, qi = q[at : at + step], q_ids[at : at + step]
        qf, length = qs.astype(kind), np.sqrt((qs.astype(np.float64) ** 2).sum(1))
        mine = [(n, own[int(i)]) for n, i in enumerate(qi) if int(i) in own]
        score = np.zeros((len(qs), len(m)), kind)
        for x, y in mine:
            score[x, y] = -np.inf
        open_ = np.ones(score.shape, bool)
        if exact and len(m) > k + 1:
            n = 0
            for n, (part, unseen) in enumerate(parts):
                score += qf @ part
                if n == 0 and len(parts) > 1:
                    continue  # the bound of the first level alone is too loose to settle much
                slack = length[:, None] * unseen[None, :] * (1 + 1e-6)
                low = np.partition(score - slack, len(m) - k, axis=1)[:, len(m) - k]
                open_ = score + slack >= low[:, None]  # proof: the others cannot reach the k best
                if n + 1 < len(parts) and open_.sum() <= 8 * k * len(qs):
                    break
            if trace is not None:
                trace.append(n + 1)
        for x, y in mine:
            open_[x, y] = False
        r, c = np.nonzero(open_)
        for lo in range(0, len(r), 1 << 17):
            rr, cc = r[lo : lo + (1 << 17)], c[lo : lo + (1 << 17)]
            out.append((rr + at, cc, np.einsum("ij,ij->i", qs[rr], m[cc])))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    r, c, s = (np.concatenate([o[i] for o in out]) for i in range(3))
    order = np.lexsort((ids[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.searchsorted(r, r, "left")
    best = np.arange(len(r)) - first < k
    return q_ids[r[best]], ids[c[best]], s[best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                (q_ids, q), (ids, m) = _unpack(r, "q_"), _unpack(r, "")
                segments = [np.frombuffer(x, np.int32) for x in r["segments"]]
                found = search_block(q_ids, q, ids, m, segments, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: F.Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that `queries` (a condition on
    vec_id) picks, the k other rows with the highest integer inner product, ties to the
    smaller vec_id; fewer rows if there are fewer.

    vectors needs vec_id and embedding; see quantised() for nulls and repeated ids.
    Vectors of unequal length count as filled up with zeros. Every query block meets
    every index block once, in a task of its own, with bounded memory."""
    scratch = Scratch(vectors.sparkSession, "topk")
    v = scratch.keep(quantised(vectors, scale))
    blocks = max(1, math.ceil(v.count() / BLOCK_ROWS))
    q = v.where(queries)
    n = q.count()
    q_blocks = max(1, math.ceil(n / QUERY_ROWS), min(math.ceil(TASKS / blocks), n // LEAST_ROWS))
    index = scratch.keep(v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(_packed("index"), _PACKED + ", segments array<binary>"))
    asked = scratch.keep(q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))).groupBy("block").applyInArrow(_packed("query"), _PACKED))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    pairs = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>"))).join(asked, "q_block")
    pairs = pairs.repartition(max(1, blocks * q_blocks), "block", "q_block") if blocks * q_blocks > 1 else pairs
    found = pairs.drop("block", "q_block", "q_block").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
