"""Linear SVM on mapped rows that are never kept.

MLlib's ``LinearSVC`` keeps every mapped row for its iterations, 2 KB each. Here a pass maps the rows again,
a slice at a time in a core's cache, and leaves loss and gradient. The steps are those of
``LinearSVC`` (features standardised and centred, orthant-wise quasi-Newton steps with a backtracking search), so
the fit is the same up to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.histograms import BLOCK_ROWS, FAN_IN, tasks
from cohortlab.session import stage_blocks

#: Corrections that the quasi-Newton step remembers, and values among which the last must be new for it to go on.
MEMORY, VALUES = 10, 20
ROWS_PER_TASK = 500_000  # 60 bytes a row: a file of a task stays within one split


def packed(train: DataFrame, features: Sequence[str], label: str, rows: int, name: str = "svm-rows") -> RDD:
    """Features (a row per row) and label of ``train`` as bytes, in blocks."""
    wide = train.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)])
                if not np.isfinite(x).all():
                    raise ValueError("features and labels of an SVM must not be missing or infinite")
                held = np.ascontiguousarray(x[:, :-1]), np.ascontiguousarray(x[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()) for h in held], names=["x", "y"])

    blocks = wide.repartition(tasks(train, rows, ROWS_PER_TASK)).mapInArrow(run, "x binary, y binary")
    return stage_blocks(train.sparkSession, blocks.rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))), name)


def passed(blocks: RDD, add: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, size: int) -> np.ndarray:
    """The sum of ``add(x, y)`` over all blocks; a task gives one array of ``size`` numbers."""

    def total(arrays: Iterator[np.ndarray]) -> Iterator[bytes]:
        out = np.zeros(size)
        for a in arrays:
            out += a
        yield out.tobytes()

    found = blocks.mapPartitions(
        lambda part: total(add(np.frombuffer(x).reshape(-1, width), np.frombuffer(y)) for x, y in part)
    )
    parts = blocks.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapPartitions(lambda sums: total(np.frombuffer(s) for s in sums))
    out = np.zeros(size)
    for s in found.collect():
        out += np.frombuffer(s)
    return out


@dataclass(frozen=True)
class Hinge:
    """Mean hinge loss with a squared penalty, of weights of standardised columns and, last, the intercept at their means."""

    blocks: RDD
    width: int
    columns: int
    mapped: Callable[[np.ndarray], Iterator[tuple[slice, np.ndarray]]]
    penalty: float
    rows: float
    mean: np.ndarray
    scale: np.ndarray  # one over the deviation, 0 for a constant column

    @classmethod
    def over(cls, blocks: RDD, width: int, columns: int, mapped: Callable, penalty: float) -> Hinge:
        def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros((2, columns))
            for _, z in mapped(x):
                out[0] += z.sum(axis=0)
                out[1] += np.einsum("ij,ij->j", z, z)
            return np.append(out.ravel(), len(y))

        sums = passed(blocks, add, width, 2 * columns + 1)
        n = sums[-1]
        mean = sums[:columns] / n
        spread = np.sqrt(np.maximum(sums[columns:-1] - n * mean * mean, 0.0) / max(n - 1, 1))
        with np.errstate(divide="ignore"):
            return cls(blocks, width, columns, mapped, penalty, n, mean, np.where(spread > 0, 1.0 / spread, 0.0))

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient, by one pass."""
        columns, mapped = self.columns, self.mapped
        weights, offset = self.weights(w)

        def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            sign = 2.0 * y - 1.0
            out = np.zeros(columns + 2)
            for part, z in mapped(x):
                left = 1.0 - sign[part] * (z @ weights + offset)
                pull = np.where(left > 0, -sign[part], 0.0)
                out[:columns] += pull @ z
                out[columns] += pull.sum()
                out[columns + 1] += np.maximum(left, 0.0).sum()
            return out

        s = passed(self.blocks, add, self.width, columns + 2) / self.rows
        bare = w[:-1] * self.scale * self.scale
        slope = (s[:columns] - self.mean * s[columns]) * self.scale + self.penalty * bare
        return float(s[-1] + 0.5 * self.penalty * (w[:-1] @ bare)), np.append(slope, s[columns])

    def weights(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and intercept for columns as they are."""
        plain = w[:-1] * self.scale
        return plain, float(w[-1] - self.mean @ plain)


class _Stuck(Exception):
    """No step length will do."""


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, most: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """The last point and the value at each; as Breeze's OWLQN without a penalty on absolute values, which ``LinearSVC`` uses."""
    x = start
    value, grad = loss(x)
    first, values, seen = value, [value], [math.inf]
    history: list[tuple[np.ndarray, np.ndarray]] = []
    failed = False
    while len(values) <= most:
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8) or (len(seen) > 1 and abs(value - max(seen)) <= tolerance * first):
            break
        try:
            to, found, slope = _step(loss, x, value, grad, _direction(history, grad), len(values) == 1)
        except _Stuck:
            if failed:
                break
            history, failed = [], True
            continue
        failed = False
        history = [(to - x, slope - grad), *history][:MEMORY]
        x, value, grad = to, found, slope
        values.append(value)
        seen = [*seen, value][-VALUES:]
    return x, values


def _direction(history: Sequence[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    out, shares = grad.copy(), []
    for step, change in history:
        shares.append((step @ out) / (step @ change))
        out -= shares[-1] * change
    if history:
        step, change = history[0]
        if not step @ change >= 0:
            raise _Stuck
        out *= (step @ change) / (change @ change)
    for (step, change), share in zip(reversed(history), reversed(shares)):
        out += (share - (change @ out) / (step @ change)) * step
    if not np.isfinite(out).all():
        raise _Stuck
    return np.where(-out * grad < 0, -out, 0.0)  # only where it goes down by itself


def _step(loss: Callable, x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, first: bool) -> tuple[np.ndarray, float, np.ndarray]:
    """Where the search along ``way`` ends, with value and gradient there."""
    down, shrink = float(way @ grad), 0.1 if first else 0.5
    if not down < 0:
        raise _Stuck
    side = np.where(x != 0, np.sign(x), np.sign(-grad))
    # the search takes the value at its first length for the one at the start, so it always shortens that once, unasked here
    length = (0.5 / np.linalg.norm(grad) if first else 1.0) * shrink
    for _ in range(20):
        moved = x + way * length
        point = np.where(np.sign(moved) == side, moved, 0.0)  # no weight changes its sign within a step
        found, slope = loss(point)
        rise = float(slope @ way)
        if found > value + length * down * 1e-4:
            length *= shrink
        elif rise < 0.9 * down:
            length *= 2.1
        elif rise > -0.9 * down:
            length *= shrink
        else:
            return point, found, slope
        if not 1e-10 <= length <= 1e10:
            raise _Stuck
    raise _Stuck
