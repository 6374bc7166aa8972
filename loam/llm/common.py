"""Shared pieces: scratch tables, vectorised word splitting and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, and what a word is (also as used inside SQL strings).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    neither that nor a checkpoint folder is set (tests), a folder of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="loam-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        if self.n == 1:  # what the steps did not drop goes with the session
            at = self._path(self.root)
            self._files(at).deleteOnExit(at)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        at = self._path(path)
        self._files(at).delete(at, True)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, at):
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def lower_ascii(c: Column) -> Column:
    """A-Z lowered and nothing else; the quicker lower() where the text is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, self.base)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, self.inverse)]))
        return self.up[:n], self.down[:n]


def rolling(values: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:n])])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


#: Code points from, to (inclusive) that are no letters though beyond ASCII.
SIGNS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x3020), (0xFE00, 0xFE0F), (0xFF01, 0xFF0F), (0x1F000, 0x1FAFF))


def not_letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to one of SIGNS."""
    out = np.zeros(len(data), bool)
    if not len(data) or data.max() < 0xC2:
        return out
    at = np.flatnonzero((data == 0xC2) | (data == 0xC3) | (data == 0xE2) | (data == 0xE3) | (data == 0xEF) | (data == 0xF0))
    a, b, c, d = (np.where(at + i < len(data), data[np.minimum(at + i, len(data) - 1)], 0).astype(np.int64) for i in range(4))
    size = np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4))
    point = np.where(size == 2, (a & 31) << 6 | b & 63, np.where(size == 3, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
    sign = np.zeros(len(at), bool)
    for lo, hi in SIGNS:
        sign |= (point >= lo) & (point <= hi)
    for i in range(4):
        mine = at[sign & (size > i)] + i
        out[mine[mine < len(data)]] = True
    return out


class Words:
    """Splits many texts at once and hashes each word, all in numpy.

    kind "space": words are runs of bytes other than 0x20 and 0x09-0x0D.
    kind "alnum": runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered.
    kind "letter": the same without digits, and without the signs, dashes, quotes, arrows and
    pictures among the non-ASCII characters (see not_letters).
    """

    def __init__(self, kind: str):
        table_ = _splitmix(256, 0x5EED)
        self.kind, b = kind, np.arange(256)
        if kind == "space":
            self.inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        else:
            letters = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
            self.inside = letters | ((b >= 48) & (b <= 57)) if kind == "alnum" else letters
            table_[65:91] = table_[97:123]
        self.table, self.powers = table_, Powers(0xD6E8FEB86659FD93)

    def split(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: the texts' bytes in a row; ends: where each ends. Gives hash, start and
        end byte of each word, and the number of words up to the end of each text.

        A long text, which comes alone, is split in parts that end between words, so that
        the working arrays stay small."""
        if len(ends) > 1 or len(data) <= PART_BYTES:
            return self._split(data, ends)
        at, parts = 0, []
        while at < len(data):
            to = at + PART_BYTES
            while to < len(data) and self.inside[data[to]]:
                gap = np.flatnonzero(~self.inside[data[to : to + PART_BYTES]])
                to += int(gap[0]) if len(gap) else PART_BYTES
            h, starts, stops, _ = self._split(data[at:to], np.array([len(data[at:to])]))
            parts.append((h, starts + at, stops + at))
            at = to
        h, starts, stops = (np.concatenate(x) for x in zip(*parts, strict=True))
        return h, starts, stops, np.array([len(h)])

    def _split(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        inside = self.inside[data]
        if self.kind == "letter":
            inside &= ~not_letters(data)
        if not len(data):
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        cuts = ends[(ends > 0) & (ends < len(data))]  # words end where texts end
        before[cuts] = False
        after[cuts - 1] = False
        starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = self.powers.get(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[data] * up[: len(data)])])
            hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        return hashes, starts, stops, np.searchsorted(starts, ends, "left")


#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Bytes of a long text that are split at once.
PART_BYTES = 1 << 20


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, their bytes in a row, and where each row's text ends. Null: empty."""
    if not len(texts):
        return
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    else:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    nulls = texts.null_count
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, len(texts))
        part = data[offsets[at] : offsets[to]]
        ends = offsets[at + 1 : to + 1] - offsets[at]
        if nulls and len(part):  # a null slot may hold bytes
            valid = np.asarray(texts.slice(at, to - at).is_valid())
            lengths = np.diff(np.concatenate([[0], ends]))
            if (lengths[~valid] > 0).any():
                part, ends = part[np.repeat(valid, lengths)], np.cumsum(np.where(valid, lengths, 0))
        yield at, to, part, ends
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64, copy=False).view(np.int64)
