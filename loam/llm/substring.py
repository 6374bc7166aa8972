"""Exact substring dedup by seed and extend (operator 6).

Seeds: of every 24 consecutive 12-word hashes in a document the smallest is an
anchor (winnowing), so each window of 35 words has exactly one, and equal windows
have equal anchors at equal offsets. Anchors that occur once end there. Extend: for
every other anchor, each window of 35 words that reaches out from it to the left and
right is hashed, and occurrences of the anchor whose windows agree match over that
window. All matches over one anchor come from counting these, not from pairs.
Overlapping matched windows make up the maximal repeats, whose words go.

A window is known by its anchor's 64-bit hash and its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Scratch, Words, chunks, column, rolling, signed

WINDOW, SEED_WORDS = 35, 12
#: Occurrences of one anchor that one task extends; beyond, windows are counted one by one over all tasks.
GROUP_ROWS = 20_000


class Anchors:
    def __init__(self, window: int, seed_words: int):
        self.window, self.k, self.span = window, seed_words, window - seed_words + 1
        self.words, self.seed, self.whole = Words("space"), Powers(0xC2B2AE3D27D4EB4F), Powers(0x9FB21C651E98DF25)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """h: word hashes of one text. Gives the hash of each anchor, the first window
        that has it, and the number of windows."""
        g = rolling(h, self.k, self.seed)
        m = len(h) - self.window + 1
        if m < 1:
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none
        at, width = np.arange(len(g)), 1  # the leftmost smallest of `width` values from each on
        while width < self.span:
            step = min(width, self.span - width)
            a, b = at[: len(at) - step], at[step:]
            at = np.where(g[b] < g[a], b, a)
            width += step
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return g[at[first]], first, np.diff(np.append(first, m))

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """Row, word hashes, bytes, starts and stops of the words of each text."""
        for lo, hi, data, ends in chunks(texts):
            h, starts, stops, upto = self.words.split(data, ends)
            at = 0
            for row in range(lo, hi):
                to = int(upto[row - lo])
                yield row, h[at:to], data, starts[at:to], stops[at:to]
                at = to


def _seeds(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Anchors(window, seed_words)
        for batch in batches:
            rows, hashes, firsts = [], [], []
            for row, h, *_ in a.texts(column(batch, "text")):
                if len(h) >= window:
                    g, first, _n = a.of(h)
                    rows.append(np.full(len(g), row))
                    hashes.append(g)
                    firsts.append(first)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hashes))), column(batch, "k1").take(take), column(batch, "k2").take(take), pa.array(np.concatenate(firsts).astype(np.int32))], ["h", "k1", "k2", "first"])

    return run


def _extend(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the anchors named in `firsts` (and whether they are hot): the hashes of their windows."""
        a = Anchors(window, seed_words)
        for batch in batches:
            firsts, hot = column(batch, "firsts"), column(batch, "hot")
            rows, hs, fs, hots, blobs = [], [], [], [], []
            for row, h, *_ in a.texts(column(batch, "text")):
                g, first, n = a.of(h)
                wanted, where = np.unique(np.asarray(firsts[row].values), return_index=True)
                at = np.searchsorted(first, wanted)
                w = signed(rolling(h, window, a.whole))
                heat = np.asarray(hot[row].values)[where]
                for i, x in zip(at.tolist(), heat.tolist(), strict=True):
                    rows.append(row)
                    hs.append(g[i])
                    fs.append(first[i])
                    hots.append(x)
                    blobs.append(w[first[i] : first[i] + n[i]].tobytes())
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.array(hs, np.uint64))), column(batch, "k1").take(take), column(batch, "k2").take(take), pa.array(fs, pa.int32()), pa.array(hots, pa.bool_()), pa.array(blobs, pa.binary())],
                    ["h", "k1", "k2", "first", "hot", "windows"],
                )

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor. Gives a mask of the windows that occur again."""

    def out(rows: pa.Table) -> pa.RecordBatch | None:
        h, blobs = rows["h"].to_numpy(), rows["windows"].to_pylist()
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        w, owner = np.frombuffer(b"".join(blobs), np.int64), np.repeat(np.arange(len(blobs)), lengths)
        offset = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((w, h[owner]))
        hh, ww = h[owner][order], w[order]
        same = (hh[1:] == hh[:-1]) & (ww[1:] == ww[:-1])
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        mask = np.zeros(len(blobs), np.int64)
        np.bitwise_or.at(mask, owner[order][again], np.int64(1) << offset[order][again])
        keep = np.flatnonzero(mask)
        if not len(keep):
            return None
        found = rows.select(["k1", "k2", "first"]).take(pa.array(keep)).append_column("mask", pa.array(mask[keep]))
        return found.combine_chunks().to_batches()[0]

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = column(batch, "h").to_numpy()
        differs = np.flatnonzero(h != h[-1])
        if len(differs) or (waiting and column(waiting[-1], "h")[0].as_py() != h[0]):
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if (done := pa.Table.from_batches([*waiting, batch.slice(0, cut)])).num_rows and (r := out(done)) is not None:
                yield r
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting and (r := out(pa.Table.from_batches(waiting))) is not None:
        yield r


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Anchors(window, min(SEED_WORDS, window))
        for batch in batches:
            firsts, masks = column(batch, "firsts"), column(batch, "masks")
            n_words, n_removed, kept = [], [], []
            for row, h, data, starts, stops in words.texts(column(batch, "text")):
                n = len(h)
                gone = np.zeros(n + 1, np.int64)
                if firsts[row].is_valid:
                    f, m = np.asarray(firsts[row].values).astype(np.int64), np.asarray(masks[row].values)
                    r, bit = np.nonzero(m[:, None] >> np.arange(64) & 1)
                    windows = np.unique(f[r] + bit)
                    np.add.at(gone, windows, 1)
                    np.add.at(gone, windows + window, -1)
                stays = np.cumsum(gone[:n]) == 0
                n_words.append(n)
                n_removed.append(int(n - stays.sum()))
                if n:
                    mine = data[starts[0] : stops[-1]].tobytes().split()
                    kept.append(b" ".join(mine if stays.all() else compress(mine, stays.tolist())))
                else:
                    kept.append(b"")
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, with_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and (with_text)
    kept, the words that stay joined by one space.

    A word goes if a run of `window` words that covers it also starts anywhere else in any
    text of the input. docs needs doc_id and text. Null and empty texts have no words;
    rows that repeat are other places, so that all their long runs go."""
    if not 0 < seed_words <= window <= seed_words + 63:
        raise ValueError("an anchor's windows must fit in 64 bits")
    scratch = Scratch(docs.sparkSession, "substring")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("k1"), F.xxhash64(text).alias("k2"))
    seeds, seeds_at = scratch.write(rows.select("k1", "k2", "text").mapInArrow(_seeds(window, seed_words), "h long, k1 long, k2 long, first int"))
    again = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > GROUP_ROWS).alias("hot"))
    again, again_at = scratch.write(again)  # a table, so that the join can split the rows of a frequent anchor
    named = seeds.join(again, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "hot")).alias("a"))
    named, named_at = scratch.write(named.select("k1", "k2", F.col("a.first").alias("firsts"), F.col("a.hot").alias("hot")))
    scratch.drop(seeds_at)
    scratch.drop(again_at)
    windows, windows_at = scratch.write(rows.join(named, ["k1", "k2"]).select("k1", "k2", "text", "firsts", "hot").mapInArrow(_extend(window, seed_words), "h long, k1 long, k2 long, first int, hot boolean, windows binary"))
    scratch.drop(named_at)
    usual = windows.where("not hot").select("h", "k1", "k2", "first", "windows").repartition("h").sortWithinPartitions("h").mapInArrow(_match, "k1 long, k2 long, first int, mask long")
    single = windows.where("hot").mapInArrow(_singles, "h long, k1 long, k2 long, first int, bit int, w long")
    counted = scratch.keep(single.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w"))
    hot = single.join(counted, ["h", "w"]).groupBy("k1", "k2", "first").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    found = usual.unionByName(hot).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "mask")).alias("a")).select("k1", "k2", F.col("a.first").alias("firsts"), F.col("a.mask").alias("masks"))
    found = scratch.keep(found)
    scratch.drop(windows_at)
    out = rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "firsts", "masks").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of an anchor."""
    for batch in batches:
        blobs = column(batch, "windows").to_pylist()
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        if not lengths.sum():
            continue
        take = pa.array(np.repeat(np.arange(len(blobs)), lengths))
        bit = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        yield pa.RecordBatch.from_arrays([*(column(batch, c).take(take) for c in ("h", "k1", "k2", "first")), pa.array(bit.astype(np.int32)), pa.array(np.frombuffer(b"".join(blobs), np.int64))], ["h", "k1", "k2", "first", "bit", "w"])
