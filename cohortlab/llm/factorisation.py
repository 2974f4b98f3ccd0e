"""Operator 10: quality classifier, a factorisation machine over hashed words, structure and metadata.

A text's features are its words, hashed into a fixed number of places and
weighted to unit length, and a few statistics of its structure and its declared
length. Score: a bias, a weight per feature and low-rank interactions of all
pairs, computed in linear time as half of (square of the sum less sum of the
squares) per factor; then the logistic function. The model is fitted by one
task on a bounded sample of labelled rows and has a fixed size; every row of
the corpus is scored, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import bounded_batches, packed, slices, table
from cohortlab.llm.words import hashes, mix, spans

#: Places of hashed words, factors, labelled rows of the fit at most (smallest hashes of doc_id first).
PLACES, RANK, FIT_ROWS = 1 << 16, 8, 10_000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.05, 1e-5
#: Rows with this remainder of crc32(doc_id) are never fitted on.
FOLDS, HELD_OUT = 5, 0
#: A score from here on predicts label 1.
CUT = 0.3
STATS = 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KINDS = np.zeros((4, 256), np.float64)  # upper case, digits, symbols, other punctuation
_KINDS[0, ord("A") : ord("Z") + 1] = 1
_KINDS[1, ord("0") : ord("9") + 1] = 1
_KINDS[2, list(b"#*$%&|<>")] = 1
_KINDS[3, list(b"!?.,;:")] = 1


def fold(column: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[off[1:]] - sums[off[:-1]]


def features(flat: np.ndarray, off: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, value, offset per text) of the features of texts laid end to end. Statistics stand first, words behind."""
    rows = len(off) - 1
    start, end, first = spans(~_SPACE[flat], off)
    word = hashes(flat, start, end)
    n, size = np.diff(first), np.maximum(np.diff(off), 1)
    row = np.repeat(np.arange(rows), n)
    key, tf = np.unique(row * PLACES + (word % np.uint64(PLACES)).astype(np.int64), return_counts=True)
    of = key // PLACES
    value = np.log1p(tf)
    count = np.bincount(of, minlength=rows)
    norm = np.sqrt(np.maximum(np.bincount(of, value**2, rows), 1e-12))
    same = np.zeros(len(word))
    if len(word) > 1:
        same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    some = np.maximum(n, 1)
    stats = np.empty((rows, STATS))
    for i, kind in enumerate(_KINDS):
        stats[:, i] = np.minimum(per_text(kind[flat], off) / size * (3 if i == 0 else 5), 3)
    stats[:, 4] = np.minimum(per_text((flat == 10).astype(float), off) / size * 20, 3)
    stats[:, 5] = per_text(same, first) / some * 3
    stats[:, 6] = count / some
    stats[:, 7] = np.minimum(per_text((end - start).astype(float), first) / some / 10, 3)
    stats[:, 8] = np.log1p(n) / 8
    stats[:, 9] = n < 50
    stats[:, 10] = np.log1p(np.maximum(declared, 0)) / 10  # metadata: the declared length
    stats[:, 11] = 1
    place = np.empty(rows * STATS + len(key), np.int64)
    weight = np.empty(len(place), np.float32)
    to = np.concatenate([[0], np.cumsum(count + STATS)])
    head = (to[:-1, None] + np.arange(STATS)).ravel()
    place[head], weight[head] = np.tile(np.arange(STATS), rows), stats.ravel()
    began = np.concatenate([[0], np.cumsum(count)])[:-1]
    tail = np.arange(len(key)) - began[of] + to[of] + STATS
    place[tail], weight[tail] = key % PLACES + STATS, value / norm[of]
    return place, weight, to


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, place: np.ndarray, value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the sums of the factors, of rows that each have a feature."""
        terms = self.factors[place] * value[:, None]
        sums = np.add.reduceat(terms, off[:-1])
        squares = np.add.reduceat((terms**2).sum(1), off[:-1])
        flat = np.add.reduceat(self.linear[place] * value, off[:-1])
        return self.bias + flat + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, place: np.ndarray, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(place, value, off)[0].astype(np.float64), -30, 30)))


def blank() -> Machine:
    """A machine that knows nothing; factors start from hashes, so that a fit can be repeated."""
    n = STATS + PLACES
    noise = mix(np.arange(1, n * RANK + 1).astype(np.uint64)) >> np.uint64(11)
    return Machine(0.0, np.zeros(n, np.float32), ((noise / 2**53 - 0.5) * 0.1).astype(np.float32).reshape(n, RANK))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """Adagrad over the logistic loss; rows in a shuffled order that is the same for the same rows."""
    model = blank()
    labels = np.array([y for *_, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        model.bias = float(np.log((labels.sum() + 1) / (len(rows) - labels.sum() + 1))) if len(rows) else 0.0
        model.factors[:] = 0
        return model
    seen_w, seen_v, seen_b = np.full(len(model.linear), 1e-3, np.float32), np.full(model.factors.shape, 1e-3, np.float32), 1e-3
    for epoch in range(EPOCHS):
        order = np.argsort(mix(np.arange(len(rows)).astype(np.uint64) + np.uint64(1000003 * (epoch + 1))))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            place = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick])
            off = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            margin, sums = model.margins(place, value, off)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
            row = np.repeat(np.arange(len(pick)), np.diff(off))
            used, which = np.unique(place, return_inverse=True)
            push = (error[row] * value)[:, None]
            inner = push * (sums[row] - model.factors[place] * value[:, None])
            grad_w = np.bincount(which, push[:, 0], len(used)) + DECAY * model.linear[used]
            grad_v = np.stack([np.bincount(which, inner[:, f], len(used)) for f in range(RANK)], 1) + DECAY * model.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += float(error.sum()) ** 2
            model.linear[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            model.factors[used] -= RATE * grad_v / np.sqrt(seen_v[used])
            model.bias -= RATE * float(error.sum()) / seen_b**0.5
    return model


def sources(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    declared = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(declared, F.length(text).cast("double")).alias("declared"),
    )


def _parts(batches: Iterator[pa.RecordBatch]):
    for part in slices(batches, "text"):
        flat, off = packed(part.column("text"))
        yield part, features(flat, off, part.column("declared").to_numpy(zero_copy_only=False))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Machine:
    """Fit on at most ``limit`` labelled rows outside the held-out fold. The model, of fixed size, comes to the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    usable = usable.filter((fold() != HELD_OUT) & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = sources(docs).join(F.broadcast(usable), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (place, value, off) in _parts(batches):
            cut = list(zip(off.tolist(), off[1:].tolist(), strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("y"),
                    pa.array([place[a:b].astype("<i4").tobytes() for a, b in cut], pa.binary()),
                    pa.array([value[a:b].astype("<f4").tobytes() for a, b in cut], pa.binary()),
                ],
                names=["doc_id", "y", "place", "value"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (np.frombuffer(p, "<i4"), np.frombuffer(v, "<f4"), y)
            for batch in batches
            for y, p, v in zip(*(batch.column(c).to_pylist() for c in ("y", "place", "value")), strict=True)
        ]
        m = fit(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), pa.array([m.linear.tobytes()]), pa.array([m.factors.tobytes()])], names=["bias", "linear", "factors"]
        )

    drawn = sample.mapInArrow(extract, "doc_id long, y int, place binary, value binary")
    one = drawn.repartition(1).sortWithinPartitions("doc_id", "place", "value")
    got = one.mapInArrow(learn, "bias double, linear binary, factors binary").first()
    if got is None:
        return fit([])
    return Machine(got["bias"], np.frombuffer(got["linear"], np.float32), np.frombuffer(got["factors"], np.float32).reshape(-1, RANK))


def classify(docs: DataFrame, model: Machine) -> DataFrame:
    """Every row's doc_id, held_out, score (0 to 1) and predicted.

    A null text counts as empty and is scored from its statistics; a null
    n_chars counts as the text's length; a null doc_id is hashed as empty;
    repeated rows are scored alike; an empty table gives no rows; columns
    other than doc_id, text and n_chars are ignored. Without labels of both kinds the score
    is the share of the one that there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(*found))], names=["doc_id", "score"])

    scored = sources(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
