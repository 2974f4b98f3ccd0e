"""Exact proportional allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STRATA = 1000


def largest_remainder(weights: Sequence[int], total: int) -> list[int]:
    """Split ``total`` proportionally to whole-number weights.

    Everyone gets the whole part of its share; what is left goes one by one
    to the largest fractions, earlier entries first on a tie. Whole-number
    arithmetic, so no rounding can move a unit.
    """
    mass = sum(weights)
    if mass <= 0:
        raise ValueError("weights must sum to a positive value")
    shares = [divmod(total * w, mass) for w in weights]
    by_fraction = sorted(range(len(weights)), key=lambda i: (-shares[i][1], i))
    winners = set(by_fraction[: total - sum(whole for whole, _ in shares)])
    return [whole + (i in winners) for i, (whole, _) in enumerate(shares)]


def strata_counts(df: DataFrame, keys: Sequence[str]) -> dict[tuple, int]:
    """Rows per stratum, read to the driver; the number of strata is checked."""
    rows = df.groupBy(*keys).count().limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata in {list(keys)}")
    return {tuple(r[k] for k in keys): r["count"] for r in rows}


def allocate(df: DataFrame, keys: Sequence[str], order: Sequence[tuple], total: int) -> DataFrame:
    """Quota per stratum of ``df`` in the given order, as a table."""
    counts = strata_counts(df, keys)
    weights = [counts.get(tuple(k), 0) for k in order]
    quotas = largest_remainder(weights, total)
    types = dict(df.select(*keys).dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", weight bigint, quota bigint"
    rows = [(*key, w, q) for key, w, q in zip(order, weights, quotas)]
    return df.sparkSession.createDataFrame(rows, schema).select(*keys, "weight", F.col("quota"))
