"""Stable hashes used for fingerprints and traffic splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 32


def signed_hash31(col: Column) -> Column:
    """``h*31 + unit`` over UTF-16 code units, wrapped to a signed 32-bit value."""

    def step(acc, ch):
        cp = F.ascii(ch).cast("bigint")
        pair = cp - 65536
        high = F.lit(55296) + F.floor(pair / 1024)
        low = F.lit(56320) + pair % 1024
        one = (acc * 31 + cp) % _WORD
        two = (((acc * 31 + high) % _WORD) * 31 + low) % _WORD
        return F.when(cp > 65535, two).otherwise(one).cast("bigint")

    raw = F.aggregate(F.split(col, ""), F.lit(0).cast("bigint"), step)
    return F.when(raw >= _WORD // 2, raw - _WORD).otherwise(raw)


def hash31(col: Column) -> Column:
    return F.abs(signed_hash31(col))


def fingerprint(col: Column, algo: str = "sha16") -> Column:
    if algo == "sha16":
        return F.substring(F.sha2(col, 256), 1, 16)
    if algo == "md5":
        return F.md5(col)
    if algo == "base36":
        h = signed_hash31(col)
        return F.concat(F.when(h < 0, "-").otherwise(""), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)))
    raise ValueError(f"unknown fingerprint {algo}")


def bucket(unit: Column, buckets: int = 100) -> Column:
    return (hash31(unit) % buckets).cast("int")
