"""Benchmark decontamination over a BM25 index of test items (operator 3).

The index holds the test items, not the corpus: those of over 64 tokens by pieces of
their question, of nearly equal length and 64 tokens at most.
Every training passage (128 tokens, a new one every 64) is a query. An item is a hit
if its BM25 score reaches the item's own threshold, set so low that no passage which
would pass the verification can miss it. Impacts are divided by that threshold, so
one bound, 1, serves all items.

Two levels of upper bounds skip work without changing the result. For a segment (a
block of neighbouring passages, as one): of each item, the rarest terms without which
the rest cannot reach the threshold are its essential ones; the segment's essential
impacts, then all its impacts, must reach 1. For each passage of the segments left:
block-max WAND over the postings, by item.

Document frequencies and the mean length are those of the whole benchmark, also where it
is looked up in several parts, so that scores do not depend on the parts.

Hits are verified by the overlap of the question (5-word shingles) and of the answer
(words), both at least 0.8 in the passage, by 64-bit hashes. Pieces only retrieve: each shingle of a long
question is in one piece, so that a text with 0.8 of them has 0.8 of some piece's. A hit is
verified by the whole item, in the passage widened by what the item has before and after
the piece.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Words, chunks, column, rolling

PIECE, PASSAGE, STRIDE, SEGMENT = 64, 128, 64, 256
SHINGLE, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Postings of one block of a list.
BLOCK = 16
#: Text of one index. An index takes about 20 times its text; more items are looked up in several rounds.
SHARD_BYTES = 4 << 20
_POWERS = Powers(0x9FB21C651E98DF25)


def question_and_answer(n_tokens: int, question_tokens: int | None) -> int:
    """Where the answer begins: after the last question mark, or two thirds in."""
    if question_tokens and 0 < question_tokens < n_tokens:
        return question_tokens
    return n_tokens if n_tokens < 3 else -(-2 * n_tokens // 3)


@dataclass
class Piece:
    item: int
    tokens: np.ndarray
    #: Length of its shingles, their hashes (each once, sorted), and the words of the answer (likewise).
    k: int
    question: np.ndarray
    answer: np.ndarray
    #: Of a piece of a long item: the item, and how many of its tokens lie before and after the piece.
    whole: Piece | None = None
    before: int = 0
    after: int = 0
    #: Words that may be missing for each missing shingle.
    words_each: int = 1


def piece_of(item: int, tokens: np.ndarray, cut: int) -> Piece:
    k = min(SHINGLE, cut)
    return Piece(item, tokens, k, np.unique(rolling(tokens[:cut], k, _POWERS)) if k else np.empty(0, np.uint64), np.unique(tokens[cut:]))


def split(whole: Piece, cut: int) -> Iterator[Piece]:
    """Pieces of the question; a shingle that repeats counts for the first piece that has it."""
    q, none = whole.tokens[:cut], np.empty(0, np.uint64)
    h = rolling(q, SHINGLE, _POWERS) if len(q) >= SHINGLE else rolling(q, len(q), _POWERS)
    k = min(SHINGLE, len(q))
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    for part in np.array_split(np.arange(len(h)), -(-len(h) // (PIECE - SHINGLE + 1))):
        a, b = int(part[0]), int(part[-1]) + k
        new = part[first[part]]
        if not len(new):
            continue
        used = np.zeros(b - a, bool)
        for i in range(k):
            used[new - a + i] = True
        words = np.isin(q[a:b], q[a:b][used])
        yield Piece(whole.item, q[a:b][words], k, np.unique(h[new]), none, whole, a, len(whole.tokens) - b, 1 if len(new) == len(part) else SHINGLE)


@dataclass
class Index:
    """Lists by term, one after the other: the pieces in order and their impacts over the threshold."""

    pieces: list[Piece]
    vocabulary: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    threshold: np.ndarray
    essential: tuple[np.ndarray, np.ndarray, np.ndarray]
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    rest: np.ndarray

    def list_of(self, t: int) -> tuple[list[int], list[float], list[float], float]:
        """Of a term: pieces, impacts, maxima by block, maximum."""
        if not hasattr(self, "_list_of"):
            self._list_of = lru_cache(1 << 14)(self._list)
        return self._list_of(t)

    def _list(self, t: int) -> tuple[list[int], list[float], list[float], float]:
        x = self.impacts[self.starts[t] : self.starts[t + 1]]
        return self.docs[self.starts[t] : self.starts[t + 1]].tolist(), x.tolist(), np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)).tolist(), float(x.max())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_list_of"}


def pieces_of(items: list[tuple[int, str]]) -> list[Piece]:
    words, out = Words("alnum"), []
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        tokens, starts, _, _ = words.split(raw, np.array([len(raw)]))
        mark = text.encode().rfind(b"?")
        if not len(tokens):
            continue
        cut = question_and_answer(len(tokens), int(np.searchsorted(starts, mark)) if mark >= 0 else None)
        whole = piece_of(item, tokens, cut)
        out.extend(split(whole, cut) if len(tokens) > PIECE else [whole])
    return out


@dataclass
class Statistics:
    """Of all pieces of a benchmark: the words (sorted), in how many pieces each is, pieces, tokens."""

    words: np.ndarray
    df: np.ndarray
    pieces: int
    tokens: int


def statistics(pieces: list[Piece]) -> Statistics:
    each = [np.unique(p.tokens) for p in pieces]
    words, df = np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return Statistics(words, df, len(pieces), sum(len(p.tokens) for p in pieces))


def added(a: Statistics, b: Statistics) -> Statistics:
    words, back = np.unique(np.concatenate([a.words, b.words]), return_inverse=True)
    return Statistics(words, np.bincount(back, np.concatenate([a.df, b.df])).astype(np.int64), a.pieces + b.pieces, a.tokens + b.tokens)


def build(pieces: list[Piece], whole: Statistics | None = None) -> Index:
    """whole: statistics of the benchmark, if the pieces are a part of it."""
    stats = whole or statistics(pieces)
    terms = np.unique(np.concatenate([p.tokens for p in pieces]))
    df = stats.df[np.searchsorted(stats.words, terms)]
    idf = np.log(1 + (stats.pieces - df + 0.5) / (df + 0.5))
    mean = stats.tokens / max(1, stats.pieces)
    p_term, p_piece, p_impact, p_essential = [], [], [], []
    least, rest = np.zeros(len(pieces)), np.zeros(len(pieces))
    for d, p in enumerate(pieces):
        mine, n = np.unique(p.tokens, return_counts=True)
        t = np.searchsorted(terms, mine)
        impact = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(p.tokens) / mean))
        # a passage that passes misses at most this many of the piece's words: each missing word costs a shingle or an answer word
        missing = p.words_each * math.floor((1 - OVERLAP) * len(p.question) + 1e-9) + math.floor((1 - OVERLAP) * len(p.answer) + 1e-9)
        bound = max((impact.sum() - np.sort(impact)[::-1][:missing].sum()) * (1 - 1e-9), 1e-9)
        x = impact / bound
        order = np.lexsort((t, -impact, df[t]))  # the rarest first
        left = x.sum() - np.concatenate([[0], np.cumsum(x[order])])
        k = int(np.argmax(left < 1 - 1e-6))  # so many, without which the rest cannot reach the threshold
        essential = np.zeros(len(t), bool)
        essential[order[:k]] = True
        least[d], rest[d] = bound, left[k]
        p_term.append(t)
        p_piece.append(np.full(len(t), d))
        p_impact.append(x)
        p_essential.append(essential)
    forward = (np.concatenate([[0], np.cumsum([len(t) for t in p_term])]), np.concatenate(p_term), np.concatenate(p_impact))
    term, piece, impact, essential = (np.concatenate(x) for x in (p_term, p_piece, p_impact, p_essential))
    order = np.lexsort((piece, term))
    term, piece, impact, essential = term[order], piece[order], impact[order], essential[order]
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    return Index(pieces, terms, starts, piece.astype(np.int32), impact, least, (term[essential], piece[essential], impact[essential]), forward, rest)


def wand(index: Index, terms: list[int]) -> list[int]:
    """All pieces whose impacts over these terms reach 1, by block-max WAND."""
    cursors = [[0, index.list_of(t)] for t in terms]
    cursors = [c for c in cursors if c[1][0]]
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[1][0][c[0]])
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c[1][3]
            if bound >= 1:
                pivot = i
                break
        if pivot < 0:
            break
        d = cursors[pivot][1][0][cursors[pivot][0]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == d:
            pivot += 1
        block, until = 0.0, math.inf
        for at, (docs, _, tops, _) in cursors[: pivot + 1]:
            i = bisect_left(docs, d, at)
            if i < len(docs):
                block += tops[i // BLOCK]
                until = min(until, docs[min(len(docs), (i // BLOCK + 1) * BLOCK) - 1])
        if block < 1:  # nothing up to the end of these blocks, or up to the next list
            to = until + 1
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][1][0][cursors[pivot + 1][0]])
            to = max(to, d + 1)
            for c in cursors[: pivot + 1]:
                c[0] = len(c[1][0]) if to == math.inf else bisect_left(c[1][0], to, c[0])
        elif cursors[0][1][0][cursors[0][0]] == d:
            score = 0.0
            for c in cursors[: pivot + 1]:
                score += c[1][1][c[0]]
                c[0] += 1
            if score >= 1 - 1e-9:
                found.append(d)
        else:
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(c[1][0], d, c[0])
        cursors = [c for c in cursors if c[0] < len(c[1][0])]
    return found


class Lookup:
    """Numbers of vocabulary words by hash, or -1."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary  # sorted
        self.bits = np.uint64(max(1, 60 - max(4, (len(vocabulary) * 8).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
        self.seen[(vocabulary >> self.bits).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.seen[(h >> self.bits).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.vocabulary, h[at]), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[i] == h[at]
        out[at[hit]] = i[hit]
        return out


def candidates(index: Index, ids: np.ndarray, upto: np.ndarray) -> list[tuple[int, int]]:
    """Segments (text, number) of which some piece may reach the threshold in some passage.

    Segment k of a text holds its passages that start at tokens SEGMENT * k to
    SEGMENT * (k + 1) - 1; the bound takes all its tokens for one passage."""
    sizes = np.diff(np.concatenate([[0], upto]))
    last = np.maximum(0, -(-(sizes - PASSAGE) // STRIDE)) * STRIDE
    n_segments = last // SEGMENT + 1
    base = np.concatenate([[0], np.cumsum(n_segments)])
    known = np.flatnonzero(ids >= 0)
    text = np.searchsorted(upto, known, "right")
    within = known - (upto - sizes)[text]
    number = np.minimum(within // SEGMENT, n_segments[text] - 1)
    also = (number > 0) & (within - number * SEGMENT < PASSAGE - STRIDE)
    segment = np.concatenate([base[text] + number, (base[text] + number - 1)[also]])
    word = np.concatenate([ids[known], ids[known[also]]])
    width = np.int64(max(1, len(index.vocabulary)))
    pairs = np.unique(segment * width + word)
    segment, word = pairs // width, pairs % width
    terms, pieces, impacts = index.essential
    lo, hi = np.searchsorted(terms, word, "left"), np.searchsorted(terms, word, "right")
    n = hi - lo
    if not n.sum():
        return []
    at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
    key = np.repeat(segment, n) * np.int64(len(index.pieces)) + pieces[at]
    unique, back = np.unique(key, return_inverse=True)
    unique = unique[np.bincount(back, impacts[at]) + index.rest[unique % len(index.pieces)] >= 1 - 1e-6]
    # the others of each remaining piece's terms
    segment_, piece = unique // len(index.pieces), unique % len(index.pieces)
    starts, terms, impacts = index.forward
    out: list[np.ndarray] = []
    rows = max(1, (1 << 25) // int(width))
    for first in range(0, int(base[-1]), rows):
        a, b = np.searchsorted(segment_, [first, first + rows])
        if a == b:
            continue
        has = np.zeros((rows, int(width)), bool)
        c, d = np.searchsorted(segment, [first, first + rows])
        has[segment[c:d] - first, word[c:d]] = True
        n = (starts[1:] - starts[:-1])[piece[a:b]]
        at = np.repeat(starts[piece[a:b] + 1] - np.cumsum(n), n) + np.arange(n.sum())
        sums = np.add.reduceat(np.where(has[np.repeat(segment_[a:b] - first, n), terms[at]], impacts[at], 0.0), np.cumsum(n) - n)
        out.append(np.unique(segment_[a:b][sums >= 1 - 1e-6]))
    hit = np.concatenate(out) if out else np.empty(0, np.int64)
    of = np.searchsorted(base, hit, "right") - 1
    return list(zip(of.tolist(), (hit - base[of]).tolist(), strict=True))


def passages(n: int, segment: int) -> Iterator[tuple[int, int]]:
    """The passages of a segment of a text of n tokens."""
    for a in range(segment * SEGMENT, (segment + 1) * SEGMENT, STRIDE):
        yield a, min(n, a + PASSAGE)
        if a + PASSAGE >= n:
            return


def inspect(index: Index, tokens: np.ndarray, ids: np.ndarray, segments: list[int]) -> list[tuple[int, float, float, float]]:
    """item, BM25 score, overlap of question and of answer: the best passage of one text for each item that passes."""
    best: dict[int, tuple[float, float, float]] = {}
    for a, b in (p for k in segments for p in passages(len(tokens), k)):
        terms = sorted(set(ids[a:b].tolist()) - {-1})
        hits = wand(index, terms) if terms else []
        if not hits:
            continue
        mine = tokens[a:b]
        for d in hits:
            p = index.pieces[d]
            question, answer = overlaps(p.whole or p, tokens[max(0, a - p.before) : b + p.after] if p.whole else mine)
            if question >= OVERLAP and answer >= OVERLAP:
                score = sum(x for t in terms for x in impact_of(index, t, d)) * float(index.threshold[d])
                best[p.item] = max(best.get(p.item, (0.0, 0.0, 0.0)), (score, question, answer))
    return [(item, *v) for item, v in sorted(best.items())]


def overlaps(p: Piece, mine: np.ndarray) -> tuple[float, float]:
    """Of question and answer, in these tokens."""
    question = float(np.isin(p.question, rolling(mine, p.k, _POWERS)).mean()) if len(p.question) else 1.0
    return question, float(np.isin(p.answer, mine).mean()) if len(p.answer) else 1.0


def impact_of(index: Index, term: int, d: int) -> list[float]:
    docs, xs, _, _ = index.list_of(term)
    i = bisect_left(docs, d)
    return [xs[i]] if i < len(docs) and docs[i] == d else []


def _shards(benchmark: DataFrame) -> Iterator[tuple[list[Piece], Statistics | None]]:
    """The pieces, in parts of bounded text, and the statistics of all. Null ids and texts are left out."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / (SHARD_BYTES * 0.8))) if size > SHARD_BYTES else 1

    def read(part: int) -> list[Piece]:
        return pieces_of(sorted((r.item_id, r.text) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()))

    if parts == 1:
        yield read(0), None
        return
    whole = statistics([])
    for part in range(parts):
        whole = added(whole, statistics(read(part)))
    for part in range(parts):
        yield read(part), whole


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every item found in every
    row of docs, with its best passage.

    docs needs doc_id and text, benchmark item_id and text. Tokens are runs of letters and
    digits, A-Z lowered. Null and empty texts hold nothing; items without tokens are in no
    text. Rows that repeat give rows that repeat; very long texts are taken whole; an empty
    table of either kind gives an empty one; other columns are left out, whatever their names."""
    return _found(docs, benchmark).drop("th")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated() with th, the hash of the text."""
    schema = "doc_id long, th long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    for pieces, whole in _shards(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(build(pieces, whole) if pieces else None)  # of SHARD_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index, words = shipped.value, Words("alnum")
            if index is None:
                return
            lookup = Lookup(index.vocabulary)
            for batch in batches:
                found, at = [], []
                for lo, _, data, ends in chunks(column(batch, "text")):
                    h, _, _, upto = words.split(data, ends)
                    ids = lookup.of(h)
                    for t, segments in groupby(candidates(index, ids, upto), itemgetter(0)):
                        a = int(upto[t - 1]) if t else 0
                        for r in inspect(index, h[a : upto[t]], ids[a : upto[t]], [k for _, k in segments]):
                            found.append(r)
                            at.append(lo + t)
                if found:
                    ids_of = (column(batch, c).take(pa.array(at)) for c in ("doc_id", "th"))
                    yield pa.RecordBatch.from_arrays([*ids_of, *(pa.array(list(c)) for c in zip(*found, strict=True))], ["doc_id", "th", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test item is found. Rows go by doc_id and the text's hash, so
    that clean rows stay which have no id or share that of a row with an item."""
    bad = _found(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("th").alias("_th")).distinct()
    th = F.xxhash64(F.col("text").cast("string"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad")) & (th == F.col("_th")), "left_anti")
