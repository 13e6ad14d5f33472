"""Digests of rows and frames, and the counter hash behind resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modulus and multipliers of the counter hash.
_M = 2_147_483_647
_A, _B, _C, _D = 104_729, 15_487_469, 48_271, 69_621


def row_sha256(cols: list[str]) -> Column:
    """Digest of the named columns in name order; a null is marked, not skipped."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(cols)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def frame_fingerprint(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Digest of a frame whatever its row order: sums of digest slices, and the count.

    The sums combine before the shuffle, so no row order has to be made.
    """
    mod = F.lit("18446744073709551616").cast("decimal(38,0)")
    hashed = df.select(*(keys or []), row_sha256(cols).alias("_d"))

    def lane(start):
        part = F.conv(F.substring("_d", start, 15), 16, 10).cast("decimal(20,0)")
        return F.pmod(F.sum(part).cast("decimal(38,0)"), mod).cast("decimal(20,0)").cast("string")

    return hashed.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), lane(1).alias("lane1"), lane(16).alias("lane2"))


def counter_hash(a: Column, b: Column, seed: int) -> Column:
    """Integer in [0, 2147483647) that depends only on (a, b, seed)."""
    m = F.lit(_M)
    x = (a.cast("long") * _A + b.cast("long") * _B + F.lit(seed).cast("long")) % m
    return (x * _C) % m * _D % m


COUNTER_RANGE = float(_M)


def counter_hash_of(a: int, b, seed: int):
    """The same for a numpy array of positions."""
    x = (a * _A + b * _B + seed) % _M
    return x * _C % _M * _D % _M


def counter_uniform(a: Column, b: Column, seed: int) -> Column:
    return (counter_hash(a, b, seed).cast("double") + 0.5) / COUNTER_RANGE
