"""AdaBoost over one-split trees.

Features are cut into bins once. A round is then one pass that adds up class
weight per (feature, bin), from which the driver reads the best split and its error.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import class_totals, sigmoid
from cohortlab.models.histograms import BINS, Binned, Held, advanced, alone, binned, few, summed
from cohortlab.session import scratch

STAGE_EVERY = 16


@dataclass(frozen=True)
class Stump:
    """``value < threshold`` predicts ``low``, everything else ``high``."""

    feature: int
    last_bin: int
    threshold: float
    low: int
    high: int
    alpha: float


@dataclass(frozen=True)
class FittedAdaBoost:
    features: tuple[str, ...]
    stumps: tuple[Stump, ...]

    def score(self, df: DataFrame) -> DataFrame:
        total = sum(s.alpha for s in self.stumps)
        margin = F.lit(0.0)
        for s in self.stumps:
            side = F.col(self.features[s.feature]) < s.threshold
            margin = margin + F.when(side, s.alpha * (2 * s.low - 1)).otherwise(s.alpha * (2 * s.high - 1))
        scored = df.withColumn("_margin", 2.0 * margin / F.lit(total))
        return scored.select(
            *df.columns,
            F.when(F.col("_margin") > 0, 1).otherwise(0).alias("prediction"),
            sigmoid(F.col("_margin")).alias("probability"),
        )


@dataclass(frozen=True)
class AdaBoost:
    """``bins``: bins of a feature at most; with as many as it has values, every split is tried."""

    params: Mapping
    bins: int = BINS

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedAdaBoost:
        rows = sum(class_totals(train, label).values())
        rate, rounds = self.params["learning_rate"], self.params["n_estimators"]
        with scratch(train.sparkSession):
            data = binned(train, features, label, row_id, rows, self.bins, "adaboost", keyed=False)
            grow = lambda where: _stumps(where, rows, rounds, rate)
            stumps = alone(data, grow) if few(rows, len(features)) else grow(data)
        if not stumps:
            raise ValueError("no split is better than chance")
        return FittedAdaBoost(tuple(features), tuple(stumps))


def _stumps(data: Binned | Held, rows: int, rounds: int, rate: float) -> list[Stump]:
    stumps: list[Stump] = []
    pending: list[Stump] = []  # not yet part of the written weights
    shift = math.log(rows)  # keeps the weights adding up to one
    for _ in range(rounds):
        best, error, total = _best_split(data, pending, shift)
        if error >= 0.5:
            break
        perfect = error <= 0
        alpha = 1.0 if perfect else rate * math.log((1 - error) / error)
        stump = Stump(*best, alpha)
        stumps.append(stump)
        if perfect:
            break
        pending.append(stump)
        shift += math.log(total * (1 - error + error * math.exp(alpha)))
        if len(pending) == STAGE_EVERY and len(stumps) < rounds:
            done, by = tuple(pending), shift
            data = advanced(data, lambda bins, y, margin, key, done=done, by=by: _log_weight(done, bins, y, margin) - by, "adaboost")
            pending, shift = [], 0.0
    return stumps


def _log_weight(stumps: Sequence[Stump], bins: np.ndarray, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for s in stumps:
        predicted = np.where(bins[:, s.feature] <= s.last_bin, s.low, s.high)
        margin = margin + np.where(predicted != y, s.alpha, 0.0)
    return margin


def _best_split(data: Binned | Held, pending: Sequence[Stump], shift: float) -> tuple[tuple, float, float]:
    """The split with the least weighted Gini impurity, its error rate, the total weight. Of equal splits the first."""
    stumps, width, bins = tuple(pending), len(data.cuts), data.bins

    def add(x: np.ndarray, y: np.ndarray, margin: np.ndarray, key: np.ndarray) -> np.ndarray:
        weight = np.exp(_log_weight(stumps, x, y, margin) - shift)
        out = np.empty((width, 2 * bins))
        for f in range(width):
            out[f] = np.bincount(x[:, f] + bins * y.astype(np.int64), weight, 2 * bins)
        return out.ravel()

    found = summed(data, add, width * 2 * bins).reshape(width, 2, bins)
    low = np.cumsum(found, axis=2)[:, :, :-1]
    high = np.cumsum(found[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:]  # added from above, so that nothing stays exactly nothing
    seen = np.cumsum(found.sum(axis=1) > 0, axis=1)  # bins with rows: a split has some on either side
    able = (seen[:, :-1] > 0) & (seen[:, :-1] < seen[:, -1:])
    if not able.any():
        raise ValueError("all features are constant")
    impurity = np.where(able, _gini(low) + _gini(high), np.inf)
    feature, border = divmod(int(np.argmax(impurity <= impurity.min() + 1e-15)), impurity.shape[1])
    (low0, low1), (high0, high1) = low[feature, :, border], high[feature, :, border]
    left, right = int(low1 > low0), int(high1 > high0)
    wrong = (low0 if left else low1) + (high0 if right else high1)
    total = float(found[feature].sum())
    return (feature, border, float(data.cuts[feature][border]), left, right), float(max(wrong, 0.0) / total), total


def _gini(sides: np.ndarray) -> np.ndarray:
    a, b = np.maximum(sides[:, 0], 0.0), np.maximum(sides[:, 1], 0.0)
    return 2 * a * b / np.maximum(a + b, 1e-300)
