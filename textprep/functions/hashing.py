"""Deterministic randomness (H1, H2).

Every random choice is a function of ``(seed, parts...)`` through MD5, so the result of an
operator does not depend on partitioning, on task retries or on the engine: the same values
come out of DuckDB with ``md5(concat_ws('|', ...))``.

* ``hash_hex(seed, *parts)``    32-char hex digest; ordering rows by it (then by a unique key)
                                 gives a seeded shuffle (H2).
* ``uniform(seed, *parts)``     a double in [0, 1) from the first 52 bits of the digest (H1): every
                                 multiple of 2**-52, so ranges of up to 2**52 rows are hit evenly.
* ``hex_bucket(hex, n)``         ``floor(u * n)`` of a digest: monotone in the digest order, used
                                 to split one hot group into ``n`` ranges without changing order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, str):
        return F.col(x).cast("string")
    return F.lit(str(x))


def hash_hex(seed, *parts) -> Column:
    """md5 of ``seed|part1|part2...``; parts are column names, Columns or literals."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_col(p) for p in parts]))


def hex_u52(hex_col: Column) -> Column:
    return F.conv(F.substring(hex_col, 1, 13), 16, 10).cast("long")


def uniform_from_hex(hex_col: Column) -> Column:
    return hex_u52(hex_col) / F.lit(TWO_POW_52)


def uniform(seed, *parts) -> Column:
    return uniform_from_hex(hash_hex(seed, *parts))


def hex_bucket(hex_col: Column, n: int) -> Column:
    return F.floor(uniform_from_hex(hex_col) * F.lit(n)).cast("int")
