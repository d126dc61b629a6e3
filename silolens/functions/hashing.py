"""Randomness as a function of row keys.

Every draw is an md5 of ``seed:salt:key...``, so it does not depend on how rows
are partitioned or on task retries, and any SQL engine can repeat it. Keys are
integers or short strings; a double's text form may differ between engines.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hash_hex(*parts: int | str | Column) -> Column:
    """32 hex digits for a row: plain values are literals, Columns are key parts. A null part keeps its place."""
    cols = [F.coalesce(p.cast("string"), F.lit("\\N")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def word(hex_col: Column, i: int = 0) -> Column:
    """The i-th 32-bit word of a hash (0..3) as BIGINT."""
    return F.conv(F.substring(hex_col, 1 + 8 * i, 8), 16, 10).cast("bigint")


def order_word(hex_col: Column) -> Column:
    """The leading 60 bits as BIGINT: an order for rows inside one bounded group."""
    return F.conv(F.substring(hex_col, 1, 15), 16, 10).cast("bigint")


def uniform(hex_col: Column, i: int = 0) -> Column:
    return (word(hex_col, i) + F.lit(0.5)) / F.lit(TWO32)


def gaussian(hex_col: Column) -> Column:
    """Box-Muller on the first two words."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(hex_col, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(hex_col, 1))


def _digest(parts: tuple) -> str:
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def uniform_value(*parts: int | str) -> float:
    """The driver-side twin of :func:`uniform`, for parameters and centroids."""
    return (int(_digest(parts)[:8], 16) + 0.5) / TWO32


def gaussian_value(*parts: int | str) -> float:
    digest = _digest(parts)
    u1, u2 = ((int(digest[8 * i : 8 * i + 8], 16) + 0.5) / TWO32 for i in (0, 1))
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)


def stream_seed(*parts: int | str) -> int:
    """A 64-bit seed for a NumPy generator inside one task's bounded group."""
    return int(_digest(parts)[:16], 16)
