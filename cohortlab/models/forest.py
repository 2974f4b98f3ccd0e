"""Random forests on histograms: all trees grow together, a level in a few passes over the rows.

A row is drawn for a tree a Poisson number of times with mean 1, a function of the row's key and the
tree, so the draws are made again in every pass and never kept: a pass holds a block of rows
and one array of counts. A node looks at its own draw of features. Counts are whole numbers, so between the same
borders neither partitions nor retries change a tree. As in MLlib, sibling leaves that predict the same class become one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.boosting import Node, Tree, _pruned, added, reached
from cohortlab.models.histograms import Binned, binned, bins_of, summed
from cohortlab.session import scratch

#: Bins of a feature at most: MLlib's 32, and one for the largest value, which always has its own.
BINS = 33
#: Counts that a task of a pass holds and sends at most (4 MB); a level with more takes more passes, each over other trees.
MOST_COUNTS = 1 << 19
#: Shares of 2**32 below which a Poisson number of mean 1 is 0, at most 1, at most 2 and so on.
_SHARES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
DRAWS = np.array([int(s * 2**32) for s in _SHARES if int(s * 2**32) < 2**32 - 1], np.uint32)
#: Times up to which all rows of a block are compared; the few drawn as often are looked up.
OFTEN = 3


class Draws:
    """How often each row of a block is drawn for a tree; two trees share one hash, 32 bits for each."""

    def __init__(self, key: np.ndarray, seed: int):
        self.key, self.seed, self.pair, self.hash = key.view(np.uint64), seed, -1, None

    def of(self, tree: int) -> np.ndarray:
        if tree // 2 != self.pair:
            self.pair = tree // 2
            x = self.key ^ np.uint64((self.seed * 0x9E3779B97F4A7C15 + self.pair * 0xD6E8FEB86659FD93 + 1) % 2**64)
            for shift in (33, 29):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
            self.hash = (x ^ (x >> np.uint64(32))).view(np.uint32)
        share = np.ascontiguousarray(self.hash[tree % 2 :: 2])
        times = np.zeros(len(share), np.uint8)
        for bound in DRAWS[:OFTEN]:
            times += (share >= bound).view(np.uint8)
        more = np.flatnonzero(times == OFTEN)
        times[more] += np.searchsorted(DRAWS[OFTEN:], share[more], "right").astype(np.uint8)
        return times


@dataclass(frozen=True)
class Asked:
    """Open nodes of a tree, and the features that each of them looks at (a row per node)."""

    tree: int
    nodes: list[int]
    features: np.ndarray


@dataclass(frozen=True)
class FittedForest:
    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...]

    def score(self, df: DataFrame) -> DataFrame:
        cuts, trees = self.cuts, [t.arrays() for t in self.trees]

        @F.pandas_udf("double")
        def share(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for x in columns:
                values = np.column_stack([c.to_numpy(dtype=float) for c in x])
                if not np.isfinite(values).all():
                    raise ValueError("features of a forest must not be missing or infinite")
                yield pd.Series(added(trees, np.asfortranarray(bins_of(values, cuts)), np.zeros(len(values))) / len(trees))

        scored = df.withColumn("_share", share(*[F.col(c).cast("double") for c in self.features]))
        return scored.select(*df.columns, F.when(F.col("_share") > 0.5, 1).otherwise(0).alias("prediction"), F.col("_share").alias("probability"))


@dataclass(frozen=True)
class RandomForest:
    params: Mapping
    seed: int

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedForest:
        """Trees on the rows whose label is 0 or 1; a missing feature is an error. Rows are drawn by ``row_id``."""
        rows = train.filter(F.col(label).isin(0, 1)).count()
        if not rows:
            raise ValueError("training data has no row of class 0 or 1")
        with scratch(train.sparkSession):
            data = binned(train, features, label, row_id, rows, BINS, "forest")
            trees = grown(data, self.params, self.seed)
        return FittedForest(tuple(features), tuple(data.cuts), tuple(trees))


def grown(data: Binned, p: Mapping, seed: int) -> list[Tree]:
    """All trees, level by level."""
    width, take = len(data.cuts), math.ceil(math.sqrt(len(data.cuts)))
    draws = [random.Random(f"{seed}|{t}") for t in range(p["n_estimators"])]
    trees = [Tree([Node(0, np.zeros(2))]) for _ in draws]
    most = max(1, MOST_COUNTS // (take * data.bins * 2))
    level = [[0] for _ in trees]
    for depth in range(p["max_depth"]):
        asked = []
        for t, nodes in enumerate(level):
            chosen = np.array([sorted(draws[t].sample(range(width), take)) for _ in nodes]).reshape(-1, take)
            asked += [Asked(t, nodes[i : i + most], chosen[i : i + most]) for i in range(0, len(nodes), most)]
        level = [[] for _ in trees]
        for some in _groups(asked, most):
            for ask, found in zip(some, counts(data, trees, some, seed)):
                level[ask.tree] += split(trees[ask.tree], ask, found, data.cuts, p["min_samples_leaf"])
        if not any(level):
            break
    return [merged(tree) for tree in trees]


def _groups(asked: list[Asked], most: int) -> Iterator[list[Asked]]:
    """What one pass counts: up to ``most`` nodes."""
    some: list[Asked] = []
    for ask in asked:
        if some and sum(len(a.nodes) for a in some) + len(ask.nodes) > most:
            yield some
            some = []
        some.append(ask)
    if some:
        yield some


def counts(data: Binned, trees: list[Tree], asked: list[Asked], seed: int) -> list[np.ndarray]:
    """Rows drawn, by (place of the feature, node, bin, class), for each of ``asked``; one pass."""
    cells, take = 2 * data.bins, asked[0].features.shape[1]
    ends = np.cumsum([a.features.size * cells for a in asked])
    work = []
    for a, end in zip(asked, ends):
        # rows in other nodes share a last place that is left out of the result
        slot = np.full(len(trees[a.tree].nodes), len(a.nodes))
        slot[a.nodes] = np.arange(len(a.nodes))
        chosen = np.vstack([a.features, a.features[:1]]).T
        work.append((a.tree, trees[a.tree].arrays(), slot, chosen, end - a.features.size * cells))

    def add(x: np.ndarray, y: np.ndarray, margin: np.ndarray, key: np.ndarray) -> np.ndarray:
        n, rows, drawn = len(y), np.arange(len(y)), Draws(key, seed)
        codes = (x.T * 2 + y).ravel()  # bin and class in a byte, feature by feature
        out = np.empty(ends[-1])
        for tree, arrays, slot, chosen, start in work:
            times, at = drawn.of(tree).astype(float), slot.take(reached(arrays, x))
            first, size = at * cells, (len(chosen[0]) - 1) * cells
            for place, feature in enumerate(chosen * n):
                spot = feature.take(at)
                spot += rows
                out[start + place * size : start + (place + 1) * size] = np.bincount(first + codes.take(spot), times, size + cells)[:size]
        return out

    sums = summed(data, add, int(ends[-1]))
    return [sums[end - a.features.size * cells : end].reshape(take, len(a.nodes), data.bins, 2) for a, end in zip(asked, ends)]


def impurity(sums: np.ndarray) -> np.ndarray:
    """Gini impurity of counts by class."""
    share = sums / np.maximum(sums.sum(axis=-1, keepdims=True), 1e-300)
    return 1 - (share**2).sum(axis=-1)


def split(tree: Tree, ask: Asked, found: np.ndarray, cuts: Sequence[np.ndarray], least: int) -> list[int]:
    """Split the nodes asked for where the impurity falls the most, of equal falls at the first feature and border.
    Gives the children that may be split again."""
    total = found[0].sum(axis=1)
    left = found.cumsum(axis=2)[:, :, :-1]
    right = total[None, :, None] - left
    n = total.sum(axis=1)[None, :, None]
    few = np.minimum(left.sum(axis=3), right.sum(axis=3)) < max(least, 1)
    falls = impurity(total)[None, :, None] - (left.sum(axis=3) * impurity(left) + right.sum(axis=3) * impurity(right)) / np.maximum(n, 1)
    falls = np.where(few, -np.inf, falls).transpose(1, 0, 2).reshape(len(ask.nodes), -1)
    open_ = []
    for i, node in enumerate(ask.nodes):
        at = tree.nodes[node]
        at.sums = total[i]
        if not falls.shape[1] or not falls[i].max() > 0:
            continue
        place, border = divmod(int(falls[i].argmax()), left.shape[2])
        at.feature, at.border, at.gain = int(ask.features[i, place]), border, float(falls[i].max())
        at.threshold = float(cuts[at.feature][border])
        at.left, at.right = len(tree.nodes), len(tree.nodes) + 1
        for side in (left[place, i, border], right[place, i, border]):
            if side.all():  # a node of one class is a leaf
                open_.append(len(tree.nodes))
            tree.nodes.append(Node(at.depth + 1, side.copy()))
    return open_


def merged(tree: Tree) -> Tree:
    """The tree without splits whose sides predict the same everywhere; a node's value is its share of class 1."""
    says: list[int | None] = [int(n.sums[1] > n.sums[0]) for n in tree.nodes]
    for i in range(len(tree.nodes) - 1, -1, -1):
        n = tree.nodes[i]
        if n.feature >= 0 and (says[n.left] is None or says[n.left] != says[n.right]):
            says[i] = None  # a split that is kept
        elif n.feature >= 0:
            says[i] = says[n.left]
    out = _pruned(tree, [i for i, s in enumerate(says) if s is None])
    for node in out.nodes:
        node.value = float(node.sums[1] / max(node.sums.sum(), 1.0))
    return out
