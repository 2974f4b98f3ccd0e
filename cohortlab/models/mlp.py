"""A multilayer perceptron: ReLU layers, logistic loss, Adam over keyed mini-batches.

Rows are dealt into mini-batches by a hash of their key and written by batch, so
a step reads its own rows only. A step is one job: every task sums the gradients of
its rows, the sums are added, and the driver takes the step; its size depends on the layers, never on
the rows. The result does not depend on how rows are partitioned. A tenth of the rows is held
back; training ends when their accuracy has not risen for a number of epochs, and the best weights are kept.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import class_totals
from cohortlab.models.histograms import array_sum, tasks
from cohortlab.session import scratch, stage

# Adam's decay rates and its small constant; the rise of accuracy that counts; the share held back.
DECAY, SECOND_DECAY, EPSILON, RISE, HELD = 0.9, 0.999, 1e-8, 1e-4, 0.1
#: Rows of a mini-batch at least, and mini-batches of an epoch at most; more rows make larger batches.
BATCH_ROWS, BATCHES = 200, 8

Layers = list[tuple[np.ndarray, np.ndarray]]


def unpacked(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    """Weights (inputs x outputs) and biases of each layer from one vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """What every layer puts out, the input first, the margin last."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return out


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the rows: rows, log-loss, rows predicted right, then the gradient of the loss in the order of ``unpacked``."""
    seen = forward(layers, x)
    margin = seen[-1][:, 0]
    loss = np.logaddexp(0, margin) - y * margin
    back = (1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y)[:, None]
    parts = []
    for (w, _), before in zip(reversed(layers), reversed(seen[:-1])):
        parts = [(before.T @ back).ravel(), back.sum(0), *parts]
        back = (back @ w.T) * (before > 0)
    return np.concatenate([[len(y), loss.sum(), ((margin > 0) == (y > 0.5)).sum()], *parts])


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)])
    if not np.isfinite(x).all():
        raise ValueError("features of a perceptron must not be missing or infinite")
    return x, batch.column("y").to_numpy(zero_copy_only=False)


def gradient_sums(table: DataFrame, flat: np.ndarray, sizes: Sequence[int], parts: int | None = None) -> np.ndarray:
    """``gradient`` over a table with columns x0, x1, ... and y."""
    return array_sum(table, lambda batch: gradient(unpacked(flat, sizes), *_matrix(batch, sizes[0])), 3 + len(flat), parts)


def penalty(flat: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """The weights where they are penalised, zero for biases."""
    mask = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:])])
    return flat * mask


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Uniform within the square root of six over a layer's inputs and outputs."""
    draw = np.random.default_rng(seed)
    parts = [draw.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return np.concatenate(parts)


@dataclass(frozen=True)
class FittedMLP:
    features: tuple[str, ...]
    sizes: tuple[int, ...]
    weights: np.ndarray
    epochs: int  # run in all
    best_epoch: int  # whose weights were kept
    held_accuracy: tuple[float, ...]

    def score(self, df: DataFrame) -> DataFrame:
        layers = unpacked(self.weights, self.sizes)

        @F.pandas_udf("double")
        def margin(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for x in columns:
                yield pd.Series(forward(layers, np.column_stack([c.to_numpy(dtype=float) for c in x]))[-1][:, 0])

        scored = df.withColumn("_margin", margin(*[F.col(c).cast("double") for c in self.features]))
        p = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        return scored.select(*df.columns, F.when(F.col("_margin") > 0, 1).otherwise(0).alias("prediction"), p.alias("probability"))


@dataclass(frozen=True)
class MLP:
    params: Mapping
    seed: int = 42

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedMLP:
        """Rows whose label is 0 or 1 take part; one class alone or a missing feature is an error.

        Without ``early_stopping`` the loss of the training rows takes the place of the held rows' accuracy.
        """
        p = self.params
        rows = sum(class_totals(train, label).values())
        sizes = (len(features), *p["hidden_layer_sizes"], 1)
        key = F.col(row_id) if row_id in train.columns else F.struct(*features)
        count = max(1, min(BATCHES, rows // BATCH_ROWS))
        held = F.pmod(F.xxhash64(key, F.lit(f"held{self.seed}")), F.lit(1000)) < (1000 * HELD if p["early_stopping"] and rows >= 20 else 0)
        batch = F.when(held, -1).otherwise(F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(count)).cast("int"))
        table = train.filter(F.col(label).isin(0, 1)).select(
            *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"), batch.alias("batch")
        )
        with scratch(train.sparkSession):
            parts = tasks(train, rows)
            table = stage(table.repartition(parts), "mlp", by="batch")
            batches = [table.filter(F.col("batch") == i) for i in range(count)]
            return self._descend(batches, table.filter("batch = -1"), tuple(features), sizes, parts)

    def _descend(self, batches: list[DataFrame], held: DataFrame, features: tuple[str, ...], sizes: tuple[int, ...], parts: int) -> FittedMLP:
        p, order = self.params, list(range(len(batches)))
        weights = first_weights(sizes, self.seed)
        first, second, steps = np.zeros_like(weights), np.zeros_like(weights), 0
        best, kept, since, seen = -np.inf, weights, 0, []
        for epoch in range(1, p["max_iter"] + 1):
            random.Random(f"{self.seed}|{epoch}").shuffle(order)
            loss = np.zeros(2)
            for i in order:
                sums = gradient_sums(batches[i], weights, sizes, parts)
                if not sums[0]:
                    continue
                slope = (sums[3:] + p["alpha"] * penalty(weights, sizes)) / sums[0]
                steps += 1
                first, second = DECAY * first + (1 - DECAY) * slope, SECOND_DECAY * second + (1 - SECOND_DECAY) * slope**2
                rate = p["learning_rate_init"] * np.sqrt(1 - SECOND_DECAY**steps) / (1 - DECAY**steps)
                weights = weights - rate * first / (np.sqrt(second) + EPSILON)
                loss += sums[:2]
            if p["early_stopping"]:
                sums = gradient_sums(held, weights, sizes, parts)
                score = sums[2] / sums[0] if sums[0] else -loss[1] / loss[0]
            else:
                score = -loss[1] / loss[0]
            seen.append(float(score))
            since = 0 if score > best + RISE else since + 1
            if score > best:
                best, kept, best_epoch = score, weights, epoch
            if since >= p["n_iter_no_change"]:
                break
        return FittedMLP(features, sizes, kept if p["early_stopping"] else weights, epoch, best_epoch, tuple(seen))
