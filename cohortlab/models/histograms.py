"""Rows in bins, and sums over them: what all models grown from histograms share.

A table is binned once and written in blocks of rows, one run of bytes per feature. A
pass then is one job: each task sums its rows into arrays of (slot, feature, bin), and
the arrays are added on their way to the driver. Their size depends on the
model's shape, never on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import stage_blocks

#: Bins of a feature at most (one byte each), rank error of their borders, and arrays that the driver adds itself.
BINS, RANK_ERROR, FAN_IN = 256, 1e-3, 64
#: Rows below which a task of a pass is not worth its start, rows of a task at most, and rounds of tasks up to which the last one is filled.
LEAST_ROWS, MOST_ROWS, FILLED_ROUNDS = 20_000, 2_000_000, 8
#: Rows up to which a pass is less work for one task than the start of a job, so that the task that holds them does passes on its own (fewer of over 16 features).
ALONE_ROWS = 500_000
#: Rows of a block: few enough that the columns a pass works on stay in a core's cache.
BLOCK_ROWS = 32_768

A = TypeVar("A")


def tasks(train: DataFrame, rows: int, most: int = MOST_ROWS) -> int:
    """Tasks of a pass over so many rows: as many as there are cores, if each has enough to do; more for very many rows,
    and then a whole multiple of the cores if that is a few times as many, so that no core waits in the last round."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, min(rows // LEAST_ROWS, cores), rows // most)
    return -(-wanted // cores) * cores if cores < wanted <= FILLED_ROUNDS * cores else wanted


def cuts(train: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending borders per feature; a value's bin is the number of borders up to it.

    Of a feature with at most ``bins`` values, all but the smallest are borders; else quantiles, and always the largest.
    """
    few = _values(train, features, bins)
    many = [c for c in features if c not in few]
    steps = [i / (bins - 1) for i in range(bins)]
    found = dict(zip(many, train.approxQuantile(many, steps, RANK_ERROR) if many else []))
    return [np.array(sorted(few[c])[1:] if c in few else sorted({v for v in found[c] if v > found[c][0]})) for c in features]


def _values(train: DataFrame, features: Sequence[str], most: int) -> dict[str, list[float]]:
    """All values of the features that have at most ``most``. A task gives up on a feature at the first value too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0) for _ in features]
        for batch in batches:
            for i in range(len(features)):
                if len(seen[i]) <= most:
                    seen[i] = np.unique(np.concatenate([seen[i], batch.column(i).drop_null().to_numpy()]))[: most + 1]
        place = np.concatenate([np.full(1 if len(v) > most else len(v), i) for i, v in enumerate(seen)])
        value = np.concatenate([np.array([np.nan]) if len(v) > most else v for v in seen])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(value)], names=["place", "value"])

    found = train.select(*features).mapInArrow(run, "place int, value double").distinct()
    sizes = found.groupBy("place").agg(F.count("*").alias("n"), F.bool_or(F.isnan("value")).alias("over"))
    small = [r["place"] for r in sizes.collect() if r["n"] <= most and not r["over"]]
    out: dict[str, list[float]] = {features[i]: [] for i in small}
    for r in found.filter(F.col("place").isin(small)).collect() if small else []:
        out[features[r["place"]]].append(r["value"])
    return out


@dataclass(frozen=True)
class Binned:
    """``blocks``: bins (one byte each, feature by feature), y, margin, key of up to BLOCK_ROWS rows, as bytes; ``cuts`` as above."""

    spark: SparkSession
    blocks: RDD
    cuts: list[np.ndarray]
    parts: int

    @property
    def bins(self) -> int:
        return max((len(c) + 1 for c in self.cuts), default=1)

    @classmethod
    def written(cls, spark: SparkSession, blocks: RDD, cuts: list[np.ndarray], name: str) -> Binned:
        staged = stage_blocks(spark, blocks, name)
        return cls(spark, staged, cuts, staged.getNumPartitions())


@dataclass(frozen=True)
class Held:
    """The same in the memory of a task, which then does passes without a job: ``x`` has bins by row, each feature in one run of memory."""

    x: np.ndarray
    y: np.ndarray
    margin: np.ndarray
    key: np.ndarray
    cuts: list[np.ndarray]

    @property
    def bins(self) -> int:
        return max((len(c) + 1 for c in self.cuts), default=1)


def few(rows: int, width: int) -> bool:
    """Whether one task may hold so many rows and features."""
    return rows * max(width, 16) <= 16 * ALONE_ROWS


def alone(data: Binned, work: Callable[[Held], A]) -> A:
    """``work`` on all rows, in one task; for as ``few`` as it may hold."""
    cuts = data.cuts

    def run(blocks: Iterator[tuple[bytes, ...]]) -> Iterator[A]:
        x, y, margin, key = zip(*(_columns(b, len(cuts)) for b in blocks), strict=True)
        yield work(Held(np.concatenate([part.T for part in x], axis=1).T, np.concatenate(y), np.concatenate(margin), np.concatenate(key), cuts))

    return data.blocks.coalesce(1).mapPartitions(run).first()


def binned(
    train: DataFrame, features: Sequence[str], label: str, row_id: str, rows: int, bins: int = BINS, name: str = "binned", keyed: bool = True
) -> Binned:
    """``train``, of about so many ``rows``, cut into bins and written, margins 0; rows with another label than 0 or 1 take no part.
    Keys are left out if not ``keyed``: models that draw no rows need none."""
    wide = train.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"),
        (F.xxhash64(F.col(row_id)) if row_id in train.columns else F.xxhash64(*[F.col(c) for c in features])).alias("key"),
    ).filter("y IN (0, 1)")
    columns = [f"x{i}" for i in range(len(features))]
    borders = cuts(wide, columns, bins)

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, key = (np.concatenate(part) for part in zip(*held, strict=True))
        parts = [np.ascontiguousarray(x.T), y.astype(np.uint8), np.zeros(len(y)), key if keyed else key[:0]]
        return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], names=["bins", "y", "margin", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            if not np.isfinite(x).all():
                raise ValueError("features of a model grown on histograms must not be missing or infinite")
            whole = bins_of(x, borders), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "key"))
            at = 0
            while at < len(x):
                more = min(len(x) - at, BLOCK_ROWS - n)
                held.append(tuple(part[at : at + more] for part in whole))
                at, n = at + more, n + more
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    packed = wide.repartition(tasks(train, rows)).mapInArrow(run, "bins binary, y binary, margin binary, key binary")
    return Binned.written(train.sparkSession, packed.rdd.map(lambda r: tuple(bytes(part) for part in r)), borders, name)


def bins_of(x: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of values, one byte each."""
    return np.column_stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(borders)]).astype(np.uint8)


def _columns(block: tuple[bytes, ...], width: int) -> tuple[np.ndarray, ...]:
    """Bins (a row per row, but each feature in one run of memory), y, margin, key."""
    bins, y, margin, key = block
    return np.frombuffer(bins, np.uint8).reshape(width, -1).T, np.frombuffer(y, np.uint8), np.frombuffer(margin), np.frombuffer(key, np.int64)


def array_sum(table: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], size: int, parts: int | None = None) -> np.ndarray:
    """The sum of ``add(batch)`` over all rows. A task gives one array of ``size`` numbers; of more than FAN_IN
    tasks (``parts``, many if not known) the arrays are added in the cluster first."""

    def total(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for a in arrays:
            out += a
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(add(batch) for batch in batches if batch.num_rows)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(part.as_buffer()) for batch in batches for part in batch.column("part"))

    found, parts = table.mapInArrow(run, "part binary"), parts or FAN_IN**2
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapInArrow(fold, "part binary")
    out = np.zeros(size)
    for r in found.collect():
        out += np.frombuffer(r["part"])
    return out


def summed(data: Binned | Held, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``add(bins, y, margin, key)`` over all rows; as in ``array_sum``, a task gives one array."""
    width = len(data.cuts)
    if isinstance(data, Held):
        return add(data.x, data.y, data.margin, data.key)

    def total(arrays: Iterator[np.ndarray]) -> Iterator[bytes]:
        out = np.zeros(size)
        for a in arrays:
            out += a
        yield out.tobytes()

    found, parts = data.blocks.mapPartitions(lambda blocks: total(add(*_columns(b, width)) for b in blocks)), data.parts
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapPartitions(lambda sums: total(np.frombuffer(s) for s in sums))
    out = np.zeros(size)
    for s in found.collect():
        out += np.frombuffer(s)
    return out


def advanced(
    data: Binned | Held, margin: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], name: str = "binned"
) -> Binned | Held:
    """The rows with ``margin(bins, y, margin, key)`` as new margins, written unless held, so later passes start from there."""
    width = len(data.cuts)

    def run(block: tuple[bytes, ...]) -> tuple[bytes, ...]:
        return block[0], block[1], np.ascontiguousarray(margin(*_columns(block, width)), float).tobytes(), block[3]

    if isinstance(data, Held):
        return replace(data, margin=margin(data.x, data.y, data.margin, data.key))
    return Binned.written(data.spark, data.blocks.map(run), data.cuts, name)
