"""Second-order boosting on histograms: trees grown by level, by leaf, or symmetric.

A round fits a tree to gradient and curvature of the logistic loss. The
histograms of the nodes asked for come from one pass; of two siblings only the smaller
one is counted, the other is its parent less its sibling. The driver holds
histograms and trees, at most leaves x features x bins numbers.

Growth by level splits all nodes of a level at once. Growth by leaf always splits the
open leaf of the largest gain, up to a number of leaves; a pass counts the
children of all leaves that could still be split, so a tree needs about as many
passes as it is deep. Few rows are held by one task, which grows up to 16 trees a job and counts a
node over its own rows only. A symmetric tree has one split per level, the one whose
gains add up to the most over all its nodes.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import class_totals
from cohortlab.models.histograms import BINS, Binned, Held, advanced, alone, binned, bins_of, few, summed
from cohortlab.session import drop_blocks, scratch

#: Trees that passes add to the written margins before these are written anew: up to 16 if rows are few, so
#: that there are few writes; 4 from a million rows on, where adding trees again in every pass costs more than a write.
STAGE_EVERY, FEWEST_STAGED, STAGED_ROWS = 16, 4, 4_000_000


def staged_every(rows: int) -> int:
    return max(min(FEWEST_STAGED, STAGE_EVERY), min(STAGE_EVERY, STAGED_ROWS // max(rows, 1)))

G, H, N = 0, 1, 2  # rows of a histogram: gradient, curvature, rows


@dataclass
class Node:
    """``feature`` -1: a leaf. Bins up to ``border`` go left, that is values below ``threshold``."""

    depth: int
    sums: np.ndarray  # gradient, curvature, rows
    feature: int = -1
    border: int = 0
    threshold: float = math.nan
    left: int = -1
    right: int = -1
    gain: float = 0.0
    value: float = 0.0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """feature, border, left, right, value by node, as tasks use them."""
        pick = lambda name, kind: np.array([getattr(n, name) for n in self.nodes], kind)
        return pick("feature", np.int32), pick("border", np.int32), pick("left", np.int32), pick("right", np.int32), pick("value", float)


def reached(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node of a tree that each row ends in.

    Bytes are compared and combined, without a gather by row. Of a full tree with one split per level the
    answers are the digits of the node's number; else every node chooses, row by row, between what its two sides
    say. ``bins`` should have each feature in one run of memory.
    """
    feature, border, left, right = (part.tolist() for part in tree[:4])
    kind, signed = (np.uint8, np.int8) if len(feature) <= 256 else (np.uint32, np.int32)
    levels = _levels(feature, border, left, right)
    if levels is not None:
        at = np.zeros(len(bins), kind)
        for f, b in levels:
            at += at
            at += (bins[:, f] > np.uint8(b)).view(np.uint8)
        at += kind((1 << len(levels)) - 1)
        return at
    masks: dict[tuple[int, int], np.ndarray] = {}

    def beyond(node: int) -> np.ndarray:
        """All bits set where a row goes right."""
        key = feature[node], border[node]
        if key not in masks:
            mask = np.negative((bins[:, key[0]] > np.uint8(key[1])).view(np.int8))
            masks[key] = mask.astype(signed, copy=False).view(kind)
        return masks[key]

    ends: list = [kind(node) for node in range(len(feature))]
    for node in range(len(feature) - 1, -1, -1):  # children have higher numbers than their parent
        if feature[node] >= 0:
            low, high = ends[left[node]], ends[right[node]]
            apart = np.bitwise_and(low ^ high, beyond(node))
            ends[node] = np.bitwise_xor(apart, low, out=apart)
            ends[left[node]] = ends[right[node]] = None
    return ends[0] if feature[0] >= 0 else np.zeros(len(bins), kind)


def _levels(feature: list[int], border: list[int], left: list[int], right: list[int]) -> list[tuple[int, int]] | None:
    """The splits of a full tree that has the same one all over a level and is numbered level by level."""
    depth = len(feature).bit_length() - 1
    if len(feature) != (2 << depth) - 1:
        return None
    levels = []
    for d in range(depth):
        first, last = (1 << d) - 1, (2 << d) - 1
        same = feature[first] >= 0 and len(set(feature[first:last])) == len(set(border[first:last])) == 1
        if not same or left[first:last] != list(range(last, 2 * last + 1, 2)) or right[first:last] != list(range(last + 1, 2 * last + 2, 2)):
            return None
        levels.append((feature[first], border[first]))
    return levels


Trees = Sequence[tuple[np.ndarray, ...]]


def added(trees: Trees, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for tree in trees:
        margin = margin + tree[4].take(reached(tree, bins))
    return margin


def cells_of(x: np.ndarray, parts: Sequence[tuple[int, int]]) -> np.ndarray:
    """The cell of each row's combination of some (feature, number of bins)."""
    code = x[:, parts[0][0]]
    for feature, size in parts[1:]:
        code = code * np.uint8(size & 255) + x[:, feature]  # 256 bins only beside features of one bin
    return code


def slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss; takes over the memory of ``margin``."""
    p = np.negative(np.clip(margin, -700, 700, out=margin), out=margin)
    np.exp(p, out=p)
    p += 1
    np.reciprocal(p, out=p)
    return p - y, p * (1 - p)


def joined(sizes: Sequence[int]) -> list[list[int]]:
    """Places of features whose bins together make a byte, so that one count over all their combinations serves them all."""
    groups: list[list[int]] = []
    for i, size in enumerate(sizes):
        room = (g for g in groups if math.prod(sizes[j] for j in g) * size <= 256)
        if (group := next(room, None)) is None:
            groups.append([i])
        else:
            group.append(i)
    return groups


@dataclass(frozen=True)
class Shape:
    """How trees grow: ``growth`` by "level", "leaf" or "symmetric"."""

    rounds: int
    rate: float
    growth: str
    max_depth: int | None = None
    max_leaves: int | None = None
    l2: float = 0.0  # added to the curvature of a leaf
    min_curvature: float = 0.0
    min_rows: int = 1
    prior: bool = True  # start from the log-odds of the classes
    rows: float = 1.0
    columns: float = 1.0
    bins: int = BINS


@dataclass(frozen=True)
class FittedBoosting:
    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    start: float
    trees: tuple[Tree, ...]

    def score(self, df: DataFrame) -> DataFrame:
        cuts, start = self.cuts, self.start
        trees = [t.arrays() for t in self.trees]

        @F.pandas_udf("double")
        def margin(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for x in columns:
                values = np.column_stack([c.to_numpy(dtype=float) for c in x])
                if not np.isfinite(values).all():
                    raise ValueError("features of a boosted model must not be missing or infinite")
                yield pd.Series(added(trees, np.asfortranarray(bins_of(values, cuts)), np.full(len(values), start)))

        scored = df.withColumn("_margin", margin(*[F.col(c).cast("double") for c in self.features]))
        p = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        return scored.select(*df.columns, F.when(F.col("_margin") > 0, 1).otherwise(0).alias("prediction"), p.alias("probability"))

    @property
    def importances(self) -> list[float]:
        """Mean gain of the splits on each feature, as shares of their sum."""
        gains: list[list[float]] = [[] for _ in self.features]
        for tree in self.trees:
            for node in tree.nodes:
                if node.feature >= 0:
                    gains[node.feature].append(node.gain)
        mean = [sum(g) / len(g) if g else 0.0 for g in gains]
        return [m / sum(mean) if sum(mean) else 0.0 for m in mean]

    def node_rows(self) -> list[tuple]:
        """tree, path (0: left, 1: right), depth, feature (null: leaf), threshold, gain, gradient, curvature, rows, value."""
        out = []
        for t, tree in enumerate(self.trees):
            todo = [(0, "")]
            while todo:
                at, path = todo.pop()
                n = tree.nodes[at]
                name, threshold = (self.features[n.feature], n.threshold) if n.feature >= 0 else (None, None)
                out.append((t, path, n.depth, name, threshold, n.gain, float(n.sums[G]), float(n.sums[H]), int(n.sums[N]), n.value))
                if n.feature >= 0:
                    todo += [(n.left, path + "0"), (n.right, path + "1")]
        return out


NODE_SCHEMA = (
    "tree int, path string, depth int, feature string, threshold double, gain double,"
    " gradient double, curvature double, rows long, value double"
)


@dataclass(frozen=True)
class BoostedTrees:
    """``shape(params)`` says how the trees grow."""

    shape: Callable[[Mapping], Shape]
    params: Mapping
    seed: int

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedBoosting:
        """Trees on the rows whose label is 0 or 1; one class alone or a missing feature is an error."""
        shape = self.shape(self.params)
        totals = class_totals(train, label)
        rows, width, seed = sum(totals.values()), len(features), self.seed
        start = math.log(totals[1] / totals[0]) if shape.prior else 0.0
        with scratch(train.sparkSession):
            data = binned(train, features, label, row_id, rows, shape.bins, keyed=shape.rows < 1)
            trees, every = [], staged_every(rows)
            for first in range(0, shape.rounds, every):
                some = range(first, min(first + every, shape.rounds))
                if few(rows, width):
                    done = alone(data, lambda held, some=some: grown(held, shape, some, start, width, seed))
                else:
                    done = grown(data, shape, some, start, width, seed)
                trees += done
                if some.stop < shape.rounds:
                    new, old = [tree.arrays() for tree in done], data
                    data = advanced(data, lambda bins, y, margin, key, new=new: added(new, bins, margin))
                    drop_blocks(train.sparkSession, old.blocks)
        return FittedBoosting(tuple(features), tuple(data.cuts), start, tuple(trees))


def grown(data: Binned | Held, shape: Shape, rounds: Iterable[int], start: float, width: int, seed: int) -> list[Tree]:
    """The trees of some rounds. Passes add the trees since the last written margins; held rows get new margins after each tree."""
    trees, pending = [], []
    for k in rounds:
        draw = random.Random(f"{seed}|{k}")
        columns = sorted(draw.sample(range(width), max(1, round(shape.columns * width))))
        tree = Grower(data, shape, columns, [start, *pending], k, seed).grow()
        trees.append(tree)
        pending.append(tree.arrays())
        if isinstance(data, Held):
            new, pending = pending, []
            data = advanced(data, lambda bins, y, margin, key, new=new: added(new, bins, margin))
    return trees


def _drawn(key: np.ndarray, share: float, k: int, seed: int) -> np.ndarray:
    """Which rows take part in round k: a function of the row's key, so a task run again draws the same."""
    x = key.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93 + 1) % 2**64)
    for shift in (33, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < share


class Grower:
    """Grows one tree. Histograms of nodes are (3, columns, bins)."""

    def __init__(self, data: Binned | Held, shape: Shape, columns: list[int], before: list, round_: int, seed: int):
        self.data, self.shape, self.columns = data, shape, columns
        self.start, self.pending, self.round, self.seed = before[0], before[1:], round_, seed
        self.tree = Tree()
        self.held: dict[int, np.ndarray] = {}
        # a feature has as many cells as bins, and features of few bins share the cells of their combinations
        self.widths = [len(data.cuts[f]) + 1 for f in columns]
        self.groups = joined(self.widths)
        self.parts = [[(columns[i], self.widths[i]) for i in group] for group in self.groups]
        # places of the borders that there are among (column, border)
        self.borders = np.flatnonzero(np.arange(data.bins - 1) < np.array(self.widths)[:, None] - 1)
        self.rows: dict[int, np.ndarray] = {}  # of open nodes, if the task holds the rows
        if isinstance(data, Held):
            self.slopes = slopes(added(self.pending, data.x, data.margin + self.start), data.y)
            self.codes = [cells_of(data.x, part) for part in self.parts]

    def apart(self, sums: np.ndarray, nodes: list[int]) -> None:
        """Keep the nodes' histograms by feature; ``sums`` are by group, node and cell."""
        found, at = np.zeros((3, len(self.columns), len(nodes), self.data.bins)), 0
        for group in self.groups:
            own = [self.widths[i] for i in group]
            size = len(nodes) * math.prod(own)
            cells = sums[:, at : at + size].reshape(3, len(nodes), *own)
            at += size
            for axis, i in enumerate(group, 2):
                found[:, i, :, : self.widths[i]] = cells.sum(axis=tuple(a for a in range(2, cells.ndim) if a != axis)) if len(group) > 1 else cells
        for i, node in enumerate(nodes):
            self.held[node] = found[:, :, i]

    def count_held(self, nodes: list[int]) -> None:
        """``count`` where the task holds the rows: it looks at those of the nodes only."""
        data, (gradient, curvature) = self.data, self.slopes
        if nodes == [0]:
            drawn = _drawn(data.key, self.shape.rows, self.round, self.seed) if self.shape.rows < 1 else np.ones(len(data.y), bool)
            self.rows[0] = np.flatnonzero(drawn)
        for node in nodes:
            rows = self.rows[node]
            g, h, parts = gradient.take(rows), curvature.take(rows), []
            for group, code in zip(self.groups, self.codes):
                cell, size = code.take(rows), math.prod(self.widths[i] for i in group)
                parts.append([np.bincount(cell, g, size), np.bincount(cell, h, size), np.bincount(cell, minlength=size)])
            self.apart(np.concatenate(parts, axis=1), [node])

    def count(self, nodes: list[int]) -> None:
        """Histograms of the nodes, by one pass."""
        if isinstance(self.data, Held):
            return self.count_held(nodes)
        shape, parts = self.shape, self.parts
        trees, start, k, seed = self.pending, self.start, self.round, self.seed
        tree = self.tree.arrays() if self.tree.nodes else None
        slot = np.full(max(len(self.tree.nodes), 1), -1)
        slot[nodes] = np.arange(len(nodes))
        cells = [math.prod(size for _, size in part) for part in parts]
        ends = np.cumsum([len(nodes) * size for size in cells])
        places = [slice(end - len(nodes) * size, end) for size, end in zip(cells, ends)]

        def add(x: np.ndarray, y: np.ndarray, margin: np.ndarray, key: np.ndarray) -> np.ndarray:
            at = slot.take(reached(tree, x)) if tree is not None else np.zeros(len(y), np.int64)
            take = at >= 0
            if shape.rows < 1:
                take &= _drawn(key, shape.rows, k, seed)
            rows = np.flatnonzero(take)
            if len(rows) < len(y):
                own = np.empty((x.shape[1], len(rows)), np.uint8)
                for f, column in enumerate(own):
                    x[:, f].take(rows, out=column, mode="clip")  # as "raise" would, but without a copy in between
                x, y, margin, at = own.T, y.take(rows), margin.take(rows), at.take(rows)
            gradient, curvature = slopes(added(trees, x, margin + start), y)
            out = np.empty((3, ends[-1]))
            for part, size, place in zip(parts, cells, places):
                cell = at * size + cells_of(x, part)
                total = place.stop - place.start
                out[G, place] = np.bincount(cell, gradient, total)
                out[H, place] = np.bincount(cell, curvature, total)
                out[N, place] = np.bincount(cell, minlength=total)
            return out.ravel()

        self.apart(summed(self.data, add, 3 * int(ends[-1])).reshape(3, -1), nodes)

    def splits(self, node: int) -> np.ndarray:
        """Gain of every border in ``borders``, minus infinity where a side is too small."""
        left = np.cumsum(self.held[node], axis=2)[:, :, :-1].reshape(3, -1).take(self.borders, axis=1)
        total = self.tree.nodes[node].sums[:, None]
        right = total - left
        s = self.shape
        score = lambda x: x[G] ** 2 / np.maximum(x[H] + s.l2, 1e-300)
        gain = 0.5 * (score(left) + score(right) - score(total))
        small = (np.minimum(left[N], right[N]) < max(s.min_rows, 1)) | (np.minimum(left[H], right[H]) < s.min_curvature)
        return np.where(small, -np.inf, gain)

    def best(self, node: int) -> tuple[float, int, int] | None:
        """Gain, column and border of the best split; of equal gains the first column and border."""
        gain = self.splits(node)
        if not gain.size:
            return None
        i = int(gain.argmax())
        return (float(gain[i]), *self.place(i)) if gain[i] > 1e-12 else None

    def place(self, border: int) -> tuple[int, int]:
        """Column and border of a place in ``borders``."""
        column, at = divmod(int(self.borders[border]), self.data.bins - 1)
        return column, at

    def split(self, node: int, gain: float, column: int, border: int) -> None:
        """Make two children; their sums are known from the node's histogram."""
        at = self.tree.nodes[node]
        left = self.held[node][:, column, : border + 1].sum(axis=1)
        at.feature, at.border, at.gain = self.columns[column], border, gain
        at.threshold = float(self.data.cuts[at.feature][border])
        at.left, at.right = len(self.tree.nodes), len(self.tree.nodes) + 1
        self.tree.nodes += [Node(at.depth + 1, left), Node(at.depth + 1, at.sums - left)]
        if node in self.rows:
            rows = self.rows.pop(node)
            beyond = self.data.x[:, at.feature].take(rows) > border
            self.rows[at.left], self.rows[at.right] = rows[~beyond], rows[beyond]

    def count_children(self, parents: list[int]) -> None:
        """Histograms of the children: the smaller ones by a pass, their siblings by subtraction."""
        nodes = self.tree.nodes
        pairs = [(nodes[p].left, nodes[p].right, p) for p in parents]
        small = {p: min(a, b, key=lambda c: nodes[c].sums[N]) for a, b, p in pairs}
        self.count(list(small.values()))
        for a, b, p in pairs:
            self.held[a + b - small[p]] = self.held[p] - self.held[small[p]]

    def grow(self) -> Tree:
        self.count([0])
        self.tree.nodes.append(Node(0, self.held[0][:, 0].sum(axis=1)))
        {"level": self.by_level, "leaf": self.by_leaf, "symmetric": self.symmetric}[self.shape.growth]()
        for node in self.tree.nodes:
            if node.feature < 0:
                node.value = float(-self.shape.rate * node.sums[G] / max(node.sums[H] + self.shape.l2, 1e-300))
        return self.tree

    def by_level(self) -> None:
        level, depth = [0], 0
        while level and depth < (self.shape.max_depth or 64):
            parents = []
            for node in level:
                found = self.best(node)
                if found:
                    self.split(node, *found)
                    parents.append(node)
            depth += 1
            if not parents:
                return
            level = [c for p in parents for c in (self.tree.nodes[p].left, self.tree.nodes[p].right)]
            if depth < (self.shape.max_depth or 64):
                self.count_children(parents)

    def by_leaf(self) -> None:
        """The order of splits is that of the largest gain first; gains are counted ahead for all leaves that may come up."""
        most, deepest = self.shape.max_leaves or 31, self.shape.max_depth or 64
        ahead = Tree(self.tree.nodes)  # a tree grown further than needed, from which the splits are then taken in order
        gains = {0: self.best(0)}
        while True:
            taken, open_, unknown = [], {0}, set()
            while len(open_) < most:
                ready = [n for n in open_ if n in gains]
                unknown |= open_ - set(ready)
                able = [n for n in ready if gains[n]]
                if unknown or not able:
                    break
                node = max(able, key=lambda n: (gains[n][0], -n))
                if ahead.nodes[node].feature < 0:
                    self.split(node, *gains[node])
                taken.append(node)
                open_ = open_ - {node} | {ahead.nodes[node].left, ahead.nodes[node].right}
                for child in (ahead.nodes[node].left, ahead.nodes[node].right):
                    if ahead.nodes[child].depth >= deepest:
                        gains[child] = None
            if not unknown:
                break
            # one pass for the children of every leaf that could still be reached
            left = most - len(open_)
            known = sorted((n for n in open_ if gains.get(n)), key=lambda n: -gains[n][0])[:left]
            for n in known:
                if ahead.nodes[n].feature < 0 and ahead.nodes[n].depth < deepest:
                    self.split(n, *gains[n])
            parents = [i for i, n in enumerate(ahead.nodes) if n.feature >= 0 and n.left not in self.held and n.left not in gains]
            if parents:
                self.count_children(parents)
            for p in parents:
                for child in (ahead.nodes[p].left, ahead.nodes[p].right):
                    gains[child] = self.best(child) if ahead.nodes[child].depth < deepest else None
        self.tree = _pruned(ahead, taken)

    def symmetric(self) -> None:
        level = [0]
        for depth in range(self.shape.max_depth or 6):
            total = np.zeros(len(self.borders))
            for node in level:  # a side without rows adds nothing; a node all of whose rows go one way keeps its score
                total += np.where(np.isfinite(gain := self.splits(node)), gain, 0.0)
            if not total.size or total.max() <= 1e-12:
                return
            column, border = self.place(int(total.argmax()))
            for node in level:
                self.split(node, float(total.max()), column, border)  # the gain of the whole level
            parents, level = level, [c for p in level for c in (self.tree.nodes[p].left, self.tree.nodes[p].right)]
            if depth + 1 < (self.shape.max_depth or 6):
                self.count_children(parents)


def _pruned(tree: Tree, splits: list[int]) -> Tree:
    """The tree with only these splits, its nodes numbered in the order in which they were made."""
    kept, number = [0], {0: 0}
    for node in splits:
        for child in (tree.nodes[node].left, tree.nodes[node].right):
            number[child] = len(kept)
            kept.append(child)
    out = Tree()
    for old in kept:
        n = tree.nodes[old]
        if old in splits:
            out.nodes.append(Node(n.depth, n.sums, n.feature, n.border, n.threshold, number[n.left], number[n.right], n.gain))
        else:
            out.nodes.append(Node(n.depth, n.sums))
    return out


# Settings of the three kinds that callers cannot change.
def by_level(p: Mapping) -> Shape:
    return Shape(p["n_estimators"], p["learning_rate"], "level", p["max_depth"], l2=1.0, min_curvature=1.0, rows=p["subsample"], columns=p["colsample_bytree"], bins=p.get("max_bin", BINS))


def by_leaf(p: Mapping) -> Shape:
    depth = p["max_depth"] if p["max_depth"] > 0 else None
    return Shape(
        p["n_estimators"], p["learning_rate"], "leaf", depth, p["num_leaves"], min_curvature=1e-3, min_rows=p["min_child_samples"],
        rows=p["subsample"], columns=p["colsample_bytree"], bins=p.get("max_bin", BINS),
    )


def symmetric(p: Mapping) -> Shape:
    return Shape(p["iterations"], p["learning_rate"], "symmetric", p["depth"], l2=p["l2_leaf_reg"], prior=False, bins=p.get("max_bin", BINS))
