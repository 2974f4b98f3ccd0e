"""Logistic regression with a quadratic penalty on all weights, the intercept included."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import class_totals, sigmoid

TOLERANCE = 1e-8  # of the gradient, per row


@dataclass(frozen=True)
class FittedLogistic:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, df: DataFrame) -> DataFrame:
        margin = F.lit(self.intercept)
        for name, w in zip(self.features, self.weights):
            margin = margin + F.lit(w) * F.col(name)
        scored = df.withColumn("_margin", margin)
        return scored.select(
            *df.columns, F.when(F.col("_margin") > 0, 1).otherwise(0).alias("prediction"),
            sigmoid(F.col("_margin")).alias("probability"),
        )


@dataclass(frozen=True)
class LogisticRegression:
    """Newton's method on the sum of losses plus half the squared weights over C.

    A step is one pass: every task sums loss, gradient and curvature of its
    rows, and the sums are added before they reach the driver, (features + 1)
    squared numbers however many rows there are. A step that does not lower the
    loss is halved.
    """

    params: Mapping
    seed: int = 42

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedLogistic:
        rows = sum(class_totals(train, label).values())
        table = train.filter(F.col(label).isin(0, 1)).select(
            *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")
        )
        width, penalty = len(features) + 1, 1.0 / self.params["C"]
        weights, step = np.zeros(width), np.zeros(width)
        best = np.inf
        for _ in range(self.params["max_iter"]):
            loss, gradient, curvature = _sums(table, weights + step, penalty)
            if not loss <= best:
                step = step / 2
                if np.abs(step).max() < 1e-12:
                    break
                continue
            weights, best = weights + step, loss
            if np.abs(gradient).max() <= TOLERANCE * rows:
                break
            step = -np.linalg.solve(curvature, gradient)
        return FittedLogistic(tuple(features), tuple(weights[:-1].tolist()), float(weights[-1]))


def _sums(table: DataFrame, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised loss, gradient and curvature at ``weights``, whose last is the intercept."""
    width = len(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
            x, y = np.column_stack([*columns[:-1], np.ones(batch.num_rows)]), columns[-1]
            margin = x @ weights
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            loss = np.logaddexp(0, margin) - y * margin
            total += np.concatenate([[loss.sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = table.mapInArrow(add, "part array<double>").select(F.posexplode("part").alias("i", "v"))
    sums = np.zeros(1 + width + width * width)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    if not np.isfinite(sums).all():
        raise ValueError("features of a logistic regression must not be missing or infinite")
    loss = sums[0] + 0.5 * penalty * weights @ weights
    return loss, sums[1 : width + 1] + penalty * weights, sums[width + 1 :].reshape(width, width) + penalty * np.eye(width)
