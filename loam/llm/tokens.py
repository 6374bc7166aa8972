"""Token counts of sections from one encoding of each whole document (operator 2).

A document is encoded once. The tokens' byte lengths give their offsets, these map to
characters, and an interval join (both sides sorted, by binary search) finds the
section of each token. A token that crosses a boundary goes, whole, to the section
that holds most of its characters; of equal ones, to the earlier.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: How byte-level BPE of this kind splits texts before it merges; belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a vocabulary file, and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, n in ranks.items():
        lengths[n] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def char_spans(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token; a token that holds only
    the rest of a character begun before it has an empty span after that character."""
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = np.cumsum(lengths)
    return begun[ends - lengths], begun[ends]


def allocate(first: np.ndarray, after: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens by section, and how many cross a boundary. bounds: where each section ends (the last: the text)."""
    n = len(bounds)
    empty = after == first
    a = np.minimum(np.searchsorted(bounds, first - empty, "right"), n - 1)
    b = np.minimum(np.searchsorted(bounds, np.maximum(after - 1, first - empty), "right"), n - 1)
    crossing = np.flatnonzero(a != b)
    for t in crossing.tolist():
        at, most, where = int(first[t]), 0, int(a[t])
        for s in range(int(a[t]), int(b[t]) + 1):
            held = min(int(after[t]), int(bounds[s])) - at
            if held > most:
                most, where = held, s
            at = int(bounds[s])
        a[t] = where
    return np.bincount(a, minlength=n), len(crossing)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, separator: str = "\n") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_sections, n_crossing, section_tokens
    (array, in the order of the sections).

    Sections are the parts between separators, each with the separator after it; a text
    that ends with one has no further section. docs needs doc_id and text. A null text
    counts as empty: no token, one section. Rows that repeat stay. The vocabulary file must
    be at the same path on all executors, as an installed library is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sizes = encoder(vocabulary)
        for batch in batches:
            totals, sections, crossings = [], [], []
            for text in column(batch, "text"):
                text = text.as_py() or ""
                ids = np.array(bpe.encode_ordinary(text), np.int64)
                raw = np.frombuffer(text.encode(), np.uint8)
                first, after = char_spans(raw, sizes[ids])
                ends, at = [], text.find(separator)
                while at >= 0:
                    ends.append(at + len(separator))
                    at = text.find(separator, at + len(separator))
                if not ends or ends[-1] < len(text):
                    ends.append(len(text))
                per, crossing = allocate(first, after, np.array(ends, np.int64))
                totals.append(len(ids))
                sections.append(per)
                crossings.append(crossing)
            lengths = np.array([len(s) for s in sections], np.int64)
            flat = pa.array(np.concatenate(sections) if sections else np.empty(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(totals, pa.int64()), pa.array(lengths), pa.array(crossings, pa.int64()), lists], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
