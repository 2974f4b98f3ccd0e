"""Additive feature attribution of single scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortlab.models.boosting import FittedBoosting
from cohortlab.models.histograms import array_sum

#: Features on one path at most; a leaf's table has a row for each of their subsets.
MOST_FEATURES = 14


def linear_attribution(
    df: DataFrame, row_id: str, weights: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """(row, feature, attribution): weight times distance from the mean, exact for a linear score."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("attribution"))
        for c, w in weights.items()
    ])
    return df.select(row_id, F.inline(entries))


@dataclass(frozen=True)
class Leaf:
    """A leaf as its value and, per feature on its path, the interval ``low <= x < high``."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]


def tree_leaves(fitted: FittedBoosting) -> list[Leaf]:
    """All leaves of a boosted model, values on the log-odds scale. A feature met twice on a path narrows its interval."""
    out = []
    for tree in fitted.trees:
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = tree.nodes[at]
            if node.feature < 0:
                out.append(Leaf(node.value, tuple(path), tuple(a for a, _ in path.values()), tuple(b for _, b in path.values())))
                continue
            low, high = path.get(node.feature, (-np.inf, np.inf))
            todo.append((node.left, {**path, node.feature: (low, min(high, node.threshold))}))
            todo.append((node.right, {**path, node.feature: (max(low, node.threshold), high)}))
    wide = max((len(leaf.features) for leaf in out), default=0)
    if wide > MOST_FEATURES:
        raise ValueError(f"a path of {wide} features; {MOST_FEATURES} at most can be explained")
    return out


def patterns(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Per row, the features of the path whose interval holds it, as bits; a byte or two, as their number needs.

    ``x`` should have each feature in one run of memory."""
    kind = np.uint8 if len(leaf.features) <= 8 else np.uint16
    bits = np.zeros(len(x), kind)
    for j, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
        column = x[:, f]
        if low == -np.inf:
            inside = column < high
        else:
            inside = column >= low
            if high < np.inf:
                inside &= column < high
        bits |= inside.view(np.uint8).astype(kind, copy=False) << kind(j)
    return bits


def pattern_table(leaf: Leaf, count: np.ndarray) -> np.ndarray:
    """Attributions of the leaf's value to its features, for every pattern of an explained row.

    ``count``: background rows by pattern. A coalition takes its features from
    the explained row and the others from a background row (Lundberg et al.
    2020); it ends in the leaf exactly if it holds all features that only the explained row
    fulfils and none that only the background row does. So a background row adds
    a!(b-1)!/(a+b)!-like weights that depend on the sizes of these two sets only.
    """
    m = len(leaf.features)
    bits = np.arange(1 << m)
    size = np.array([bin(b).count("1") for b in bits])
    fact = np.array([factorial(i) for i in range(m + 1)], float)
    table, total = np.zeros((1 << m, m)), count.sum()
    for z in np.flatnonzero(count):
        mine, other = bits & ~z, z & ~bits
        reach = (bits | z) == (1 << m) - 1
        a, b = size[mine], size[other]
        share = np.where(reach, leaf.value * count[z] / total, 0.0) / fact[a + b]
        more, less = share * fact[np.maximum(a - 1, 0)] * fact[b], share * fact[a] * fact[np.maximum(b - 1, 0)]
        for j in range(m):
            table[:, j] += np.where(mine >> j & 1, more, 0.0) - np.where(other >> j & 1, less, 0.0)
    return table


def background_counts(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows by pattern, for all leaves end to end."""
    return np.concatenate([np.bincount(patterns(leaf, x), minlength=1 << len(leaf.features)) for leaf in leaves]).astype(float)


def explainer(leaves: Sequence[Leaf], counts: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(base, tables): the mean score of the background rows, and the table of each leaf."""
    base, tables, at = 0.0, [], 0
    for leaf in leaves:
        own = counts[at : at + (1 << len(leaf.features))]
        at += len(own)
        base += leaf.value * own[-1] / own.sum()
        tables.append(pattern_table(leaf, own))
    return base, tables


def shapley(leaves: Sequence[Leaf], tables: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Attributions of every row: one lookup per leaf and feature on its path."""
    phi, found = np.zeros((x.shape[1], len(x))), np.empty(len(x))
    for leaf, table in zip(leaves, tables):
        bits = patterns(leaf, x)
        for f, column in zip(leaf.features, np.ascontiguousarray(table.T)):
            phi[f] += column.take(bits, out=found, mode="clip")  # "raise" would go through a copy
    return phi.T


def tree_attribution(fitted: FittedBoosting, df: DataFrame, row_id: str, background: DataFrame | None = None) -> DataFrame:
    """(row, base, attributions array): base plus the attributions is the model's log-odds.

    Features left out of a coalition take the values of the rows of
    ``background`` (the explained rows themselves, if not given), all of which are counted, by
    pattern and leaf, in one pass. Then every row looks its attributions up;
    rows stay in their partitions, the tables travel with the task.
    """
    leaves, names = tree_leaves(fitted), list(fitted.features)
    values = lambda t, *more: t.select(*more, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    size = sum(1 << len(leaf.features) for leaf in leaves)
    matrix = lambda batch: np.vstack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]).T
    counts = array_sum(values(df if background is None else background), lambda batch: background_counts(leaves, matrix(batch)), size)
    if not counts.any():
        raise ValueError("no background rows")
    base, tables = explainer(leaves, counts)
    start = fitted.start + base

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = shapley(leaves, tables, matrix(batch))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, max(phi.shape[1], 1)), pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(phi), start)), rows], names=[row_id, "base", "attributions"])

    table = values(df, row_id)
    schema = table.select(row_id).schema.add("base", "double").add("attributions", ArrayType(DoubleType()))
    return table.mapInArrow(explain, schema)


def attribution_long(explained: DataFrame, row_id: str, features: Sequence[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.get("attributions", F.lit(i)).alias("attribution"))
        for i, c in enumerate(features)
    ])
    return explained.select(row_id, F.inline(entries))


def attribution_summary(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return long.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )
