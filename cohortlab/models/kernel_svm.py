"""RBF-kernel SVM through random Fourier features and a linear SVM.

The inner product of the mapped rows approximates the kernel (Rahimi and
Recht, 2007), so the quadratic kernel matrix is never formed. Mapped rows are
made in each pass and never kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.base import class_totals
from cohortlab.models.hinge import Hinge, minimised, packed
from cohortlab.models.mllib import VECTOR
from cohortlab.session import scratch, stage

WIDTH = 256
ITERATIONS = 100
TOLERANCE = 1e-6
SLICE = 256  # rows mapped at a time, which stay in a core's cache
DECISION = "_decision"


def _numbers(features: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in features])


@dataclass(frozen=True)
class _Plane:
    coefficients: DenseVector
    intercept: float


def _rows(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sine(terms: int) -> np.ndarray:
    """Coefficients by powers of t squared of sin(2 pi t) / t for t up to a quarter."""
    at = (np.cos((np.arange(400) + 0.5) * math.pi / 400) + 1) / 32
    t = np.sqrt(at)
    fit = np.polynomial.Chebyshev.fit(at, np.sin(2 * math.pi * t) / t, terms - 1, domain=[0, 1 / 16])
    return fit.convert(kind=np.polynomial.Polynomial).coef


SINE = _sine(8)  # errors below 1e-14


@dataclass(frozen=True)
class _Map:
    weights: np.ndarray
    offsets: np.ndarray

    def slices(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Mapped rows, a slice at a time, in memory that the next slice takes over.

        The cosine of an angle in turns is the sine of a quarter less its distance to the nearest whole turn: a
        few sums and products, where the library's cosine takes four times as long.
        """
        turns = np.vstack([self.weights, self.offsets]) / (2 * math.pi)
        terms = SINE * math.sqrt(2.0 / len(self.offsets))
        x = np.column_stack([x, np.ones(len(x))])
        held = [np.empty((SLICE, len(self.offsets))) for _ in range(3)]
        for at in range(0, len(x), SLICE):
            part = slice(at, min(at + SLICE, len(x)))
            z, square, factor = (h[: part.stop - at] for h in held)
            np.matmul(x[part], turns, out=z)
            z -= np.rint(z, out=square)
            np.subtract(0.25, np.abs(z, out=z), out=z)
            np.multiply(z, z, out=square)
            np.multiply(square, terms[-1], out=factor)
            for term in terms[-2:0:-1]:
                factor += term
                factor *= square
            factor += terms[0]
            z *= factor
            yield part, z

    def apply(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        @F.arrow_udf("array<double>")
        def mapped(x: pa.Array) -> pa.Array:
            out = np.empty((len(x), len(self.offsets)))
            for part, z in self.slices(_rows(x)):
                out[part] = z
            # one run of numbers for the batch: a Python object per row would cost more than all the cosines
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))

        return df.withColumn(VECTOR, array_to_vector(mapped(_numbers(features))))

    def decided(self, df: DataFrame, features: Sequence[str], svm: _Plane) -> DataFrame:
        """``df`` with its decision value, one number per row: mapped rows stay in the task."""
        weights, intercept = svm.coefficients.toArray(), float(svm.intercept)

        @F.arrow_udf("double")
        def decision(x: pa.Array) -> pa.Array:
            out = np.empty(len(x))
            for part, z in self.slices(_rows(x)):
                out[part] = z @ weights + intercept
            return pa.array(out)

        return df.withColumn(DECISION, decision(_numbers(features)))

    def fit(self, train: DataFrame, features: Sequence[str], label: str, penalty: float, rows: int) -> _Plane:
        blocks = packed(train, features, label, rows)
        loss = Hinge.over(blocks, len(features), len(self.offsets), self.slices, penalty)
        found, _ = minimised(loss.at, np.zeros(len(self.offsets) + 1), ITERATIONS, TOLERANCE)
        weights, intercept = loss.weights(found)
        return _Plane(Vectors.dense(weights), intercept)


@dataclass(frozen=True)
class _Plain:
    def apply(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error").transform(df)

    def fit(self, train: DataFrame, features: Sequence[str], label: str, penalty: float, rows: int):
        table = self.apply(train, features).select(F.col(label).cast("double").alias("label"), VECTOR)
        svm = LinearSVC(regParam=penalty, maxIter=ITERATIONS, tol=TOLERANCE, standardization=False, featuresCol=VECTOR, labelCol="label")
        return svm.fit(table)

    def decided(self, df: DataFrame, features: Sequence[str], svm) -> DataFrame:
        return svm.transform(self.apply(df, features)).withColumn(DECISION, vector_to_array("rawPrediction")[1])


@dataclass(frozen=True)
class FittedSVM:
    features: tuple[str, ...]
    mapping: object
    svm: object
    slope: float
    intercept: float

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.mapping.decided(df, self.features, self.svm)
        decision = F.col(DECISION)
        p = 1.0 / (1.0 + F.exp(-(self.slope * decision + self.intercept)))
        above = (decision > 0) & ~F.isnan(decision)
        return scored.select(*df.columns, F.when(above, 1).otherwise(0).alias("prediction"), p.alias("probability"))


@dataclass(frozen=True)
class KernelSVM:
    params: Mapping
    seed: int

    def fit(self, train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> FittedSVM:
        with scratch(train.sparkSession):
            return self._fit(train, features, label)

    def _fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedSVM:
        rows = sum(class_totals(train, label).values())
        mapping = _Plain() if self.params["kernel"] == "linear" else self._fourier(train, features)
        svm = mapping.fit(train, features, label, 1.0 / (self.params["C"] * rows), rows)
        # logistic curve from decision value to probability; its passes read two numbers per row
        columns = F.col(label).cast("double").alias("label"), F.col(DECISION).alias("d")
        decided = stage(mapping.decided(train, features, svm).select(*columns), "svm-decided")
        curve = LogisticRegression(featuresCol="x", labelCol="label").fit(
            VectorAssembler(inputCols=["d"], outputCol="x").transform(decided)
        )
        return FittedSVM(tuple(features), mapping, svm, float(curve.coefficients[0]), float(curve.intercept))

    def _fourier(self, train: DataFrame, features: Sequence[str]) -> _Map:
        width = len(features)
        gamma = 1.0 / width
        if self.params["gamma"] == "scale":
            cells = F.explode(_numbers(features))
            spread = train.select(cells.alias("v")).agg(F.var_pop("v")).first()[0]
            gamma = 1.0 / (width * spread) if spread else 1.0
        rng = np.random.default_rng(self.seed)
        return _Map(
            rng.normal(0.0, math.sqrt(2.0 * gamma), (width, WIDTH)), rng.uniform(0.0, 2.0 * math.pi, WIDTH)
        )
