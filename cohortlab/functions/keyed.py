"""Randomness as a pure function of (seed, stream, key).

Nothing here depends on partitioning, task retries or row order, so a
re-run task reproduces exactly the rows it lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13
SPAN = float(16**DIGITS)  # 2**52: every value is exact in a double


def keyed_hash(seed: int, stream: str, *keys: Column | str) -> Column:
    """128-bit hash as 32 hex digits; text order equals numeric order."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{stream}"), *parts))


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """A double in [0, 1) with 52 random bits."""
    head = F.substring(keyed_hash(seed, stream, *keys), 1, DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(SPAN)


def pick(seed: int, stream: str, n: Column | int, *keys: Column | str) -> Column:
    """A whole number in [0, n)."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(seed, stream, *keys) * size).cast("bigint")
