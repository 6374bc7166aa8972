"""Language identification of whole, possibly mixed texts (operator 10).

Each word (run of letters) scores for every language by its byte n-grams; the script
of its first letter narrows the candidates. Viterbi over the words, with a penalty
for each switch of language, labels spans. A document gets the language of the spans
that hold most of its letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, column, mix

#: Labelled documents of each language to learn from, about; longest n-gram in bytes.
SAMPLE_DOCS, LONGEST = 1000, 4
#: Buckets that n-grams hash into, and bytes of the largest model; with very many languages there are fewer buckets.
BUCKETS, MODEL_BYTES, LEAST_BUCKETS = 1 << 17, 64 << 20, 1 << 10
#: What a change of language costs, in units of a word's mean log probability an n-gram order.
SWITCH = 12.0
UNDETERMINED = "und"
#: First code points of scripts and of what follows them; other letters are script 0.
SCRIPT_STARTS = (
    (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8),
    (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0),
    (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0), (0x20000, 13), (0x32000, 0),
)
#: A script is a candidate for a language that has this share of its words in it.
SCRIPT_SHARE = 0.01
_NEVER = -1e4


def buckets_for(languages: int) -> int:
    """As many as keep a model of so many languages, in single precision, within MODEL_BYTES."""
    n = BUCKETS
    while n > LEAST_BUCKETS and n * languages * 4 > MODEL_BYTES:
        n //= 2
    return n


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (1 to LONGEST bytes, with a mark at each end) and its word."""
    lengths = stops - starts + 2
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    word = np.repeat(np.arange(len(starts)), lengths)
    within = np.arange(total) - np.repeat(ends - lengths, lengths)
    source = np.repeat(starts, lengths) + within - 1
    mark = (within == 0) | (within == np.repeat(lengths, lengths) - 1)
    b = np.zeros(total, np.uint64)
    b[~mark] = data[source[~mark]]
    b[(~mark) & (b >= 65) & (b <= 90)] += np.uint64(32)
    left = np.repeat(ends, lengths) - np.arange(total)
    code, buckets, owners = np.zeros(total, np.uint64), [], []
    for n in range(1, LONGEST + 1):
        if total < n:
            break
        code = (code[: total - n + 1] << np.uint64(8)) | b[n - 1 :]
        fine = left[: total - n + 1] >= n
        if n == 1:
            fine &= ~mark
        buckets.append((mix(code[fine] + (np.uint64(n) << np.uint64(40))) % np.uint64(n_buckets)).astype(np.int64))
        owners.append(word[: total - n + 1][fine])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.empty(0, np.int64),) * 2


def scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of the first letter of each word."""
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    a, b, c, d = (padded[starts + i] for i in range(4))
    point = np.select(
        [a < 0x80, a < 0xE0, a < 0xF0],
        [a, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63],
        (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63,
    )
    firsts, names = np.array([x for x, _ in SCRIPT_STARTS]), np.array([y for _, y in SCRIPT_STARTS])
    return np.where(point < firsts[0], 0, names[np.maximum(np.searchsorted(firsts, point, "right") - 1, 0)])


@dataclass
class Model:
    """languages in order; weight: bucket x language; allowed: script x language."""

    languages: list[str]
    weight: np.ndarray
    allowed: np.ndarray
    usual: int

    def score(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """word x language: log probabilities less the mean, by the n-gram orders."""
        bucket, owner = features(data, starts, stops, len(self.weight))
        out = np.stack([np.bincount(owner, self.weight[bucket, k], len(starts)) for k in range(len(self.languages))], axis=1) / LONGEST
        allowed = self.allowed[scripts(data, starts)]
        none = ~allowed.any(axis=1)
        out -= np.where(allowed, out, -np.inf).max(axis=1, initial=_NEVER)[:, None]
        out = np.where(allowed, out, _NEVER)
        out[none] = 0.0  # no language writes so: the word says nothing
        return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from text and lang of about sample_docs labelled documents of each language that
    are not held out: those whose hashed ids lie below a threshold set from the language's
    count, so that rare languages are learned whole. What reaches the driver is a count and
    a table of n-grams by language, whatever the size of docs."""
    text = F.col("text").cast("string")
    usable = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    if not counted:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((14, 0), bool), 0)
    buckets, scale = buckets_for(len(counted)), 1 << 30
    below = docs.sparkSession.createDataFrame([(r.lang, math.ceil(scale * min(1.0, sample_docs / r.n))) for r in counted], "lang string, below long")
    # one row a language, as few as the model has columns: broadcast, so that no text moves
    rank = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(scale))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words("letter")
        for batch in batches:
            names, label = np.unique(np.array(column(batch, "lang").to_pylist(), object).astype(str), return_inverse=True)
            for lo, hi, data, ends in chunks(column(batch, "text")):
                _, starts, stops, upto = words.split(data, ends)
                lang_of = np.repeat(label[lo:hi], np.diff(np.concatenate([[0], upto])))
                bucket, owner = features(data, starts, stops, buckets)
                script = scripts(data, starts)
                for k in np.unique(lang_of):
                    n = np.bincount(bucket[lang_of[owner] == k], minlength=buckets)
                    s = np.bincount(script[lang_of == k], minlength=14)
                    at, sat = np.flatnonzero(n), np.flatnonzero(s)
                    both = np.concatenate([at, -1 - sat])
                    yield pa.RecordBatch.from_arrays([pa.array([str(names[k])] * len(both)), pa.array(both), pa.array(np.concatenate([n[at], s[sat]]))], ["lang", "bucket", "n"])

    sample = usable.join(F.broadcast(below), "lang").where(rank < F.col("below")).select("text", "lang")
    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    lang, bucket, n = np.array([number[x] for x in counts["lang"].to_pylist()], np.int64), counts["bucket"].to_numpy(), counts["n"].to_numpy().astype(float)
    gram = bucket >= 0
    table = np.zeros((buckets, len(languages)), np.float64)
    table[bucket[gram], lang[gram]] = n[gram]
    seen = np.zeros((14, len(languages)))
    seen[-1 - bucket[~gram], lang[~gram]] = n[~gram]
    table += 0.5 * (table.sum(axis=1, keepdims=True) > 0)
    weight = np.where(table > 0, np.log(np.maximum(table, 1e-9) / table.sum(axis=0)), 0.0)
    weight -= weight.mean(axis=1, keepdims=True)
    return Model(languages, weight.astype(np.float32), seen >= SCRIPT_SHARE * seen.sum(axis=0), int(seen.sum(axis=0).argmax()))


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on the best path."""
    n, k = score.shape
    best, came = score[0].tolist(), np.zeros((n, k), np.int64)
    rows, langs = score.tolist(), range(k)
    for t in range(1, n):
        top = max(langs, key=best.__getitem__)
        other, now, back = best[top] - switch, rows[t], came[t]
        for j in langs:
            if best[j] >= other:
                back[j] = j
                best[j] += now[j]
            else:
                back[j] = top
                best[j] = other + now[j]
    path = np.empty(n, np.int64)
    path[-1] = max(langs, key=best.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def label(score: np.ndarray, upto: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word; upto: number of words up to the end of each text.

    Where no run of words gains more than half a switch for any other language over the one
    that is best for the whole text, that language throughout is the best path: S segments
    gain S / 2 switches at most and cost S - 1, and one segment alone gains nothing. Only
    other texts go through Viterbi."""
    sizes = np.diff(np.concatenate([[0], upto]))
    full = np.flatnonzero(sizes)
    out = np.zeros(len(score), np.int64)
    if not len(full):
        return out
    begins = upto[full] - sizes[full]
    best = np.add.reduceat(score, begins, axis=0).argmax(axis=1)
    out = np.repeat(best, sizes[full])
    text = np.repeat(np.arange(len(full)), sizes[full])
    mixed = np.zeros(len(full), bool)
    own = score[np.arange(len(score)), out]
    for k in range(score.shape[1]):
        gain = score[:, k] - own
        sums = np.cumsum(gain)
        drop = (np.abs(sums).max() * 2 + 1) * text  # each text lies lower than all before it
        sums = sums - drop
        low = np.minimum.accumulate(sums - gain)  # the least sum before any word of the text so far
        rise = np.maximum.reduceat(sums - low, begins)
        mixed |= rise > switch / 2 * (1 - 1e-9)
    for i in np.flatnonzero(mixed):
        at = slice(begins[i], begins[i] + sizes[full[i]])
        out[at] = viterbi(score[at], switch)
    return out


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """All rows of docs with lang_pred and score, and with spans: array of (start, end, lang),
    in words (runs of letters; end exclusive).

    lang_pred: the language whose spans hold most letters (ties: first in the alphabet), score:
    their share of the letters. Columns of docs that are called so are replaced. A text that is null or has no letter: und, 0. Without any
    language learned, all are und. Words in a script that no language learned is written in
    count for none; a text of such words alone gets the most usual language with score 0."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    kinds = "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
    schema = docs.drop("lang_pred", "score", "spans")
    names = schema.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = shipped.value, Words("letter")
        for batch in batches:
            has = column(batch, "_letters").to_numpy(zero_copy_only=False)
            preds, scores, found = [], [], []
            for lo, hi, data, ends in chunks(column(batch, "_text")):
                h, starts, stops, upto = words.split(data, ends)
                path, size = np.empty(0, np.int64), stops - starts
                if len(h) and m.languages:
                    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # letters, not bytes
                    size = begun[stops] - begun[starts]
                    _, first, back = np.unique(h, return_index=True, return_inverse=True)
                    score = m.score(data, starts[first], stops[first])[back]
                    path = label(score, upto, switch)
                    silent = (score == 0).all(axis=1)
                    size = np.where(silent & (len(m.languages) > 1), 0, size)
                at = 0
                for row in range(lo, hi):
                    to = int(upto[row - lo])
                    mass = np.bincount(path[at:to], size[at:to], len(m.languages)) if len(path) else np.zeros(0)
                    if not has[row] or not m.languages:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        k = int(mass.argmax()) if len(mass) and mass.sum() else m.usual
                        preds.append(m.languages[k])
                        scores.append(float(mass[k] / mass.sum()) if len(mass) and mass.sum() else 0.0)
                    if spans:
                        p = path[at:to]
                        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) else [0]
                        found.append([{"start": a, "end": b, "lang": m.languages[p[a]]} for a, b in pairwise(cuts)])
                    at = to
            extra = [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                extra.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), *extra], [*names, "lang_pred", "score", *["spans"] * spans])

    text = F.col("text").cast("string")
    ready = schema.withColumns({"_text": text, "_letters": F.coalesce(text.rlike(r"\p{L}"), F.lit(False))})
    from pyspark.sql.types import StructType

    out = StructType([*schema.schema.fields, *StructType.fromDDL(kinds).fields[: 2 + spans]])
    return ready.mapInArrow(run, out)


def identify(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Learns from the rows of docs that are not held out and predicts all rows: doc_id,
    held_out, lang_pred, score (and spans). docs needs doc_id, text and lang."""
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model, spans=spans).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *["spans"] * spans)
