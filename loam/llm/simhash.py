"""Near-duplicate documents by SimHash, with Golay-code fuzzy keys (operator 4).

A 64-bit fingerprint falls into segments A (23 bits), B (23 bits) and C (18 bits).
The perfect binary Golay code (23, 12) gives each 23-bit segment one nearest
codeword; segments at distance 3 from it also take the five codewords at distance
4. Two segments that differ in two bits or fewer share at least one such codeword.
With at most three differing bits, spread (a, b, c) over A, B and C, pigeonhole
leaves one of these keys equal:

    a = 0, b <= 2           A and a codeword of B
    b = 0, a <= 2           B and a codeword of A
    c = 0, a <= 2           C and a codeword of A
    b = c = 0               B and C
    a = b = c = 1           one half each of A, B and C (eight keys)

so no link is lost. Candidates that share a key are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, signed
from .components import components

RADIUS = 3
#: Rows of a bucket that one task compares; larger buckets are cut into pairs of chunks.
BUCKET_ROWS = 4096
_GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1, of the binary Golay code


def fingerprint(text: bytes | None) -> int:
    """SimHash of one text: bits set in over half of the XXH64 (seed 42) of its 3-word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes: A-Z, and 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < 4:
        return int(xxh64_intdigest(joined, 42))
    lengths = np.fromiter(map(len, words), np.int64, n)
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    votes = np.zeros(64, np.int64)
    for at in range(0, n - 2, 1 << 16):
        a, b = starts[at : min(at + (1 << 16), n - 2)].tolist(), stops[at + 2 : at + 2 + (1 << 16)].tolist()
        h = np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # a byte for each bit
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # of 255 bytes at most: none overflows
        votes += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n - 2, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (XXH64 of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "th"), pa.array(signed(fp))], ["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _remainder(w: int) -> int:
    for i in range(22, 10, -1):
        if w >> i & 1:
            w ^= _GENERATOR << (i - 11)
    return w


@cache
def _golay() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Syndromes of each byte of a word; errors by syndrome: the nearest, and those of weight 4 (or -1)."""
    unit = [_remainder(1 << i) for i in range(23)]
    parts = []
    for byte in range(3):
        t = np.zeros(256, np.int32)
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and byte * 8 + i < 23:
                    t[v] ^= unit[byte * 8 + i]
        parts.append(t)
    near, four = np.zeros(2048, np.int32), np.full((2048, 5), -1, np.int32)
    weight, seen = np.full(2048, -1), np.zeros(2048, int)
    for k in range(5):
        for bits in combinations(range(23), k):
            s = 0
            for i in bits:
                s ^= unit[i]
            e = sum(1 << i for i in bits)
            if k < 4:
                near[s], weight[s] = e, k
            elif weight[s] == 3:
                four[s, seen[s]] = e
                seen[s] += 1
    return parts, near, four


def codewords(w: np.ndarray) -> np.ndarray:
    """Indices of the codewords near each 23-bit word: the nearest, then up to five at distance 4 (-1: none)."""
    parts, near, four = _golay()
    s = parts[0][w & 255] ^ parts[1][w >> 8 & 255] ^ parts[2][w >> 16]
    errors = np.concatenate([near[s][:, None], four[s]], axis=1)
    return np.where(errors < 0, -1, (w[:, None] ^ errors) >> 11)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fp (uint64): the row and the key of each key of each fingerprint."""
    x = fp.astype(np.uint64)
    a, b, c = ((x >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in ((0, 23), (23, 23), (46, 18)))
    a, b, c = (v.astype(np.int64) for v in (a, b, c))
    rows, keys, every = [], [], np.arange(len(x))

    def put(tag: int, exact: np.ndarray, indices: np.ndarray | None = None) -> None:
        if indices is None:
            rows.append(every)
            keys.append((tag << 58) | exact)
        else:
            r, k = np.nonzero(indices >= 0)
            rows.append(r)
            keys.append((tag << 58) | (exact[r] << 12) | indices[r, k])

    near_a, near_b = codewords(a), codewords(b)
    put(1, a, near_b)
    put(2, b, near_a)
    put(3, c, near_a)
    put(4, (b << 18) | c)
    tag = 5
    for i in (a & 0xFFF, a >> 12):
        for j in (b & 0xFFF, b >> 12):
            for k in (c & 0x1FF, c >> 9):
                put(tag, (i << 24) | (j << 12) | k)
                tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = column(batch, "fp").to_numpy()
        rows, keys = keys_of(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def _spanning(f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links within one bucket."""
    rest = f
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= RADIUS
            if near.any():
                found = rest[near]
                yield np.full(len(found), x), found
                todo.extend(found)
                rest = rest[~near]


SMALL = 24


def links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """group, sorted: the bucket of each row. Links enough to connect what is connected in each bucket."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= SMALL, sizes)
    g, f = group[small], fp[small]
    out = []
    for d in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=0)))):
        hit = (g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= RADIUS)
        out.append((f[:-d][hit], f[d:][hit]))
    for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        out.extend(_spanning(np.unique(fp[at : at + n])))
    a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
    b = np.concatenate([y for _, y in out]) if out else a
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; what a batch ends with waits for the next."""

    def out(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = links(g, f)
        return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], ["a", "b"])

    last_g, last_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        cols = [column(batch, n).to_numpy() for n in ("key", "i", "j")]
        with np.errstate(over="ignore"):  # one number for key, i, j; equal rows are neighbours
            g = cols[0] * np.int64(-7046029254386353131) + cols[1].astype(np.int64) * np.int64(1 << 20) + cols[2]
        g = np.concatenate([last_g, g])
        f = np.concatenate([last_f, column(batch, "fp").to_numpy().view(np.uint64)])
        if not len(g):
            continue
        cut = int(np.flatnonzero(g != g[-1])[-1] + 1) if (g != g[-1]).any() else 0
        if cut:
            yield out(g[:cut], f[:cut])
        last_g, last_f = g[cut:], f[cut:]
    if len(last_g) > 1:
        yield out(last_g, last_f)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct: fp (long), each once. Gives a, b: links that connect all that is connected."""
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    rows = (
        keys.join(shared.hint("merge"), "key")
        .withColumn("s", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(_verify, "a long, b long").distinct()


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp, root and component_id of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints, _ = scratch.write(fingerprints(docs))
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(scratch.keep(link_fingerprints(nodes)), scratch).withColumnRenamed("node", "fp")
    # these tables grow with the documents: none is broadcast
    rooted = nodes.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("fp", "root").join(named.hint("merge"), "root").select("fp", "root", "component_id")
    return prints.join(labels.hint("merge"), "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, fp (long), component_id, the smallest doc_id
    of all documents that links reach from it.

    docs needs doc_id and text; other columns are left out. Null and empty texts, and
    texts of white space, have fingerprint 0 and are linked like any others. Rows that
    repeat stay. component_id is null only where no document of the component has an id."""
    return _labelled(docs).select("doc_id", "fp", "component_id")
