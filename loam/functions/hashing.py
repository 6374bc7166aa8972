"""Hashes that other engines can reproduce: integers out of md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(*parts: Column | str, seed: str = "") -> Column:
    """The first 32 bits of md5 over the parts, joined by '|', and the seed, as a bigint."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bucket(*parts: Column | str, n: int, seed: str = "") -> Column:
    """A stable bucket from 0 to n - 1 (split hashes, folds)."""
    return md5_int(*parts, seed=seed) % n


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))
