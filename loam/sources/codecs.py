"""Varints, run streams, bitsets and typed arrays in bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def varints(raw: bytes) -> list[int]:
    """All complete varints; a torn last one is left out."""
    out, value, shift = [], 0, 0
    for b in raw:
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            out.append(value)
            value = shift = 0
    return out


@F.pandas_udf(T.BinaryType())
def encode_runs(runs: pd.Series) -> pd.Series:
    """Runs (array of struct start, length, level, in order) as varints of skip, length and level."""
    def one(rs) -> bytes:
        out, at = b"", 0
        for r in rs:
            out += put_varint(r["start"] - at) + put_varint(r["length"]) + put_varint(r["level"])
            at = r["start"] + r["length"]
        return out

    return runs.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "level")])))
def decode_runs(raw: pd.Series) -> pd.Series:
    def one(b: bytes) -> list[dict]:
        v, at, out = varints(bytes(b)), 0, []
        for i in range(0, len(v) - 2, 3):
            at += v[i]
            out.append({"start": at, "length": v[i + 1], "level": v[i + 2]})
            at += v[i + 1]
        return out

    return raw.map(one)


@F.pandas_udf(T.BinaryType())
def bitset(cells: pd.Series) -> pd.Series:
    """Cell numbers as a bitset."""
    def one(xs) -> bytes:
        out = bytearray(max(xs, default=-1) // 8 + 1)
        for x in xs:
            out[x >> 3] |= 1 << (x & 7)
        return bytes(out)

    return cells.map(one)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bits(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: [8 * i + j for i, x in enumerate(bytes(b)) for j in range(8) if x >> j & 1])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("cell", T.LongType()), T.StructField("pairs", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("species", "sites")])))])))
def decode_count_grid(raw: pd.Series) -> pd.Series:
    """A grid file: magic, n, n cells, n + 1 offsets, then pairs of species and sites, all little-endian."""
    def one(b: bytes) -> list[dict]:
        b = bytes(b)
        _, n = struct.unpack_from("<II", b)
        cells, offsets = struct.unpack_from(f"<{n}I", b, 8), struct.unpack_from(f"<{n + 1}I", b, 8 + 4 * n)
        at = 8 + 4 * (2 * n + 1)
        return [{"cell": c, "pairs": [dict(zip(("species", "sites"), struct.unpack_from("<HH", b, at + 4 * k), strict=True)) for k in range(offsets[i], offsets[i + 1])]} for i, c in enumerate(cells)]

    return raw.map(one)
