"""Near-duplicate documents by word 5-shingles with a similarity of 0.8 or more: operator 4
with its links verified on the texts.

First the SimHash links of operator 4, over 5-word shingles: Golay-code keys bring together
fingerprints that differ in three bits or fewer. At a Jaccard similarity of 0.8 two
fingerprints differ in some ten bits, though, so that these keys alone miss most of the near
copies that the texts have. Texts that they leave apart therefore also meet by BANDS keys
of ROWS MinHashes each: a pair at similarity s shares none with probability
(1 - s ** ROWS) ** BANDS, 3 in 100,000 at 0.8 and fewer above. Every link, of either
kind, is verified on the two sets of shingles (by 64-bit hashes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Powers, Scratch, Words, _splitmix, chunks, column, mix, signed
from .components import components
from .simhash import link_fingerprints

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Texts of a bucket, and bytes of their sets, that one block holds where all of a bucket is compared.
BLOCK_TEXTS, BLOCK_BYTES = 256, 8 << 20
#: Columns of a block's matrix at once.
COLUMNS = 1 << 15
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[list(UPPER.encode())] = list(LOWER.encode())
_FACTORS = _splitmix(BANDS * ROWS, 0xBA2D) | np.uint64(1)


class Shingles:
    """Hashes of the shingles of many texts: 5 words each, or all words of a shorter text."""

    def __init__(self) -> None:
        self.words, self.powers = Words("space"), Powers(0x9FB21C651E98DF25)

    def split(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles' hashes, and their number up to the end of each text."""
        h, _, _, upto = self.words.split(_LOWERED[data], ends)
        end = np.repeat(upto, np.diff(np.concatenate([[0], upto])))  # of the text of each word
        begin = np.concatenate([[True], end[1:] != end[:-1]]) if len(end) else np.empty(0, bool)
        at = np.arange(len(h))
        starts = at[begin | (at + SHINGLE <= end)]
        stops = np.minimum(starts + SHINGLE, end[starts])
        up, down = self.powers.get(len(h) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
            out = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        return out, np.searchsorted(starts, upto, "left")


def keys_of(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text; all texts without words have the same."""
    sizes = np.diff(np.concatenate([[0], upto]))
    full = np.flatnonzero(sizes)
    begins = upto[full] - sizes[full]
    out = np.zeros((len(upto), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS):
            if len(full):
                out[full, k // ROWS] = mix(out[full, k // ROWS] + np.minimum.reduceat(hashes * factor, begins))
        return mix(out + np.arange(1, BANDS + 1, dtype=np.uint64))


def fingerprints_of(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """SimHash of each text: bits set in over half of its shingles' hashes; 0 without shingles."""
    sizes = np.diff(np.concatenate([[0], upto]))
    full = np.flatnonzero(sizes)
    out = np.zeros(len(upto), np.uint64)
    for at in range(0, len(full), 256):
        part = full[at : at + 256]
        lo = upto[part[0]] - sizes[part[0]]
        bits = np.unpackbits(hashes[lo : upto[part[-1]]].view(np.uint8), bitorder="little").reshape(-1, 64)
        votes = np.add.reduceat(bits, upto[part] - sizes[part] - lo, axis=0, dtype=np.int32)
        out[part] = np.packbits(votes * 2 > sizes[part][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        parts, prints = [], []
        for _, _, data, ends in chunks(column(batch, "text")):
            split = shingles.split(data, ends)
            parts.append(keys_of(*split))
            prints.append(fingerprints_of(*split))
        flat = signed(np.concatenate(parts)).ravel() if parts else np.empty(0, np.int64)
        fp = signed(np.concatenate(prints)) if prints else np.empty(0, np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "th"), pa.array(fp), keys], ["doc_id", "th", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        sets = []
        for _, _, data, ends in chunks(column(batch, "text")):
            h, upto = shingles.split(data, ends)
            sets += [np.unique(x) for x in np.split(h, upto[:-1])]
        yield pa.RecordBatch.from_arrays([column(batch, "th"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["th", "n", "set"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(column(batch, "x"), column(batch, "y"), strict=True)
        ok = [jaccard(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair)) >= SIMILARITY for pair in pairs]
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, value, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n[value] > 1  # what only one set has is shared by none
    value, owner = value[often], owner[often]
    _, value = np.unique(value, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(value.max(initial=-1)) + 1, COLUMNS):
        here = (value >= lo) & (value < lo + COLUMNS)
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[here], value[here] - lo] = 1
        out += m @ m.T
    return out


def block_links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of one block (or pair of blocks) of one bucket: those of different
    blocks only, if there are two; of different components; and only in the first of the
    buckets that both are in, so that no pair is compared twice."""
    th, root, own = (rows[c].to_numpy() for c in ("th", "root", "own"))
    keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(len(th), BANDS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"]]
    x, y = np.triu_indices(len(th), 1)
    fine = root[x] != root[y]
    if (own != own[0]).any():
        fine &= own[x] != own[y]
    size = np.array([len(v) for v in sets])
    fine &= np.minimum(size[x], size[y]) >= SIMILARITY * np.maximum(size[x], size[y])
    x, y = x[fine], y[fine]
    key = rows["key"][0].as_py()
    same = keys[x] == keys[y]
    fine = keys[x, same.argmax(axis=1)] == key if len(x) else np.zeros(0, bool)
    x, y = x[fine], y[fine]
    if not len(x):
        return th[:0], th[:0]
    if len(x) <= 64:
        ok = np.array([jaccard(sets[i], sets[j]) >= SIMILARITY for i, j in zip(x, y, strict=True)])
    else:
        both = shared_counts(sets)[x, y]
        ok = both >= SIMILARITY * (size[x] + size[y] - both)
    return th[x[ok]], th[y[ok]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and blocks; what a batch ends with waits for the next."""
    waiting: pa.Table | None = None

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
        found = [block_links(t.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([waiting, t]) if waiting is not None else t
        group = [t[c].to_numpy() for c in ("key", "i", "j")]
        differs = np.flatnonzero((group[0] != group[0][-1]) | (group[1] != group[1][-1]) | (group[2] != group[2][-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield from out(t.slice(0, cut))
        waiting = t.slice(cut)
    if waiting is not None:
        yield from out(waiting)


def _roots(docs: DataFrame, scratch: Scratch, prints: DataFrame) -> DataFrame:
    """node, root (hashes of texts) of every text with a link.

    In each bucket all texts are first compared with two of them, so that a large group of
    near copies takes no square of comparisons; what is then in one bucket but not yet in
    one component is compared all with all, in blocks. All tables here grow with the documents:
    none is broadcast, whatever its estimated size."""
    one = scratch.keep(prints.groupBy("th").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    nodes = scratch.keep(one.groupBy("fp").agg(F.min("th").alias("first")))
    near = link_fingerprints(nodes)
    a, b = nodes.select(F.col("fp").alias("a"), F.col("first").alias("x")), nodes.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    alike = near.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("x", "y").unionByName(one.join(nodes.hint("merge"), "fp").where("th <> first").select(F.col("first").alias("x"), F.col("th").alias("y")))
    keys = one.select("th", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low < high")
    members = scratch.keep(keys.join(shared.hint("merge"), "key"))
    ends = members.select("th", F.explode(F.array("low", "high")).alias("end")).where("th <> end")
    first = alike.select(F.col("x").alias("th"), F.col("y").alias("end")).unionByName(ends)
    first = scratch.keep(first.select(F.least("th", "end").alias("a"), F.greatest("th", "end").alias("b")).distinct())
    needed = first.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    texts = docs.select(F.xxhash64(docs["text"].cast("string")).alias("th"), docs["text"].cast("string").alias("text"))
    sets = scratch.keep(texts.join(needed.hint("merge"), "th", "left_semi").dropDuplicates(["th"]).mapInArrow(_sets, "th long, n long, set binary"))
    x, y = sets.select(F.col("th").alias("a"), F.col("set").alias("x"), F.col("n").alias("na")), sets.select(F.col("th").alias("b"), F.col("set").alias("y"), F.col("n").alias("nb"))
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * SIMILARITY
    links = scratch.keep(first.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(fit).select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, ok boolean").where("ok").select("a", "b"))
    roots = scratch.keep(components(links, scratch)).withColumnRenamed("node", "th")
    placed = members.join(roots.hint("merge"), "th", "left").select("key", "th", F.coalesce("root", "th").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l < h").select("key")
    placed = scratch.keep(placed.join(several.hint("merge"), "key").join(sets.select("th", "n").hint("merge"), "th"))
    blocks = scratch.keep(placed.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("s")))  # a table, so that the join can split a large bucket
    dealt = placed.join(blocks.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("th"), F.col("s")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "th", "root").join(sets.select("th", "set").hint("merge"), "th").join(one.select("th", "keys").hint("merge"), "th")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "th").select("key", "i", "j", "own", "th", "root", "set", "keys").mapInArrow(_blocks, "a long, b long")
    return components(scratch.keep(links.unionByName(more)), scratch)


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, but of each group of near duplicates only that with the smallest
    doc_id (null last; then by the text's hash; of repeated rows one stays).

    Near duplicates are texts with a Jaccard similarity of SIMILARITY or more over their
    shingles of five words (A-Z lowered), and what such links connect; null and empty
    texts and texts of white space are alike. Very long texts are taken whole; an empty table
    gives an empty one. Extra columns of docs stay; doc_id and text are needed. Of rows that
    share doc_id and text the one stays whose columns come first."""
    scratch = Scratch(docs.sparkSession, "neardup")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = scratch.keep(rows.mapInArrow(_prints, "doc_id long, th long, fp long, keys array<long>"))
    roots = _roots(docs, scratch, prints).withColumnRenamed("node", "th")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    best = prints.groupBy("th").agg(F.min(rank).alias("k")).join(roots.hint("merge"), "th", "left").groupBy(F.coalesce("root", "th").alias("root")).agg(F.min("k").alias("k"))
    # joined and grouped by the same columns, none of them null: the texts move once
    row = F.struct(*docs.columns)
    doc = docs["doc_id"].cast("long")
    keyed = docs.select(F.coalesce(doc, F.lit(0)).alias("_id"), doc.isNull().alias("_no_id"), F.xxhash64(docs["text"].cast("string")).alias("_th"), row.alias("_row"))
    keep = best.select(F.coalesce("k.doc_id", F.lit(0)).alias("_id"), F.col("k.n").alias("_no_id"), F.col("k.th").alias("_th"))
    kept = keyed.join(keep.hint("merge"), ["_id", "_no_id", "_th"], "left_semi").groupBy("_id", "_no_id", "_th").agg(F.min("_row").alias("_row"))
    return kept.select("_row.*")
